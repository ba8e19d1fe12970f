"""Batch twins of the streaming operators (ST*); tests hold the streams against them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.catalog import epoch, scratch, table
from newsloom.operators.curation import sliding_counts
from newsloom.operators.ingest import keep_first
from newsloom.streaming import timed
from newsloom.streaming.posts import posts

from .registry import query


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("s", epoch("ts"))


@query("SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def st1_tumbling(spark, sf_dir):
    return _events(spark, sf_dir).groupBy((F.floor(F.col("s") / 3600) * 3600).alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
    SELECT event_id, count(*) OVER w AS used, count(*) OVER w <= 20 AS allowed, min(s) OVER w + 86400 AS reset_at FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)""")
def st3_sliding_quota(spark, sf_dir):
    return sliding_counts(_events(spark, sf_dir), "user_id", "s", 86400, 20).select("event_id", "used", "allowed", "reset_at")


@query("""WITH e AS (SELECT event_type, unnest([CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT), CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) - 21600]) AS bucket FROM events) SELECT bucket, event_type, count(*) AS n FROM e GROUP BY ALL""")
def st4_sliding_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("at", "12 hours", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("bucket"), "event_type", "n")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def st7_first_sight(spark, sf_dir):
    return keep_first(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT user_id, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS minute, count(*) AS n, count(*) > 1 AS limited FROM events GROUP BY ALL""")
def st9_rate_limit(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("user_id", (F.floor(F.col("s") / 60) * 60).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("limited", F.col("n") > 1)


#: Hours at which a source's counts change, up to the watermark, and its tier there.
TICKS = """e AS (SELECT user_id AS key, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS hour FROM events), w AS (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) - 7200 AS mark FROM events),
    ticks AS (SELECT DISTINCT key, hour + d AS s FROM e, (VALUES (3600), (90000), (608400)) v(d), w WHERE hour + d <= mark),
    n AS (SELECT t.key, t.s, count(e.hour) FILTER (WHERE e.hour >= t.s - 86400) AS day, count(e.hour) AS week FROM ticks t LEFT JOIN e ON e.key = t.key AND e.hour < t.s AND e.hour >= t.s - 604800 GROUP BY ALL),
    r AS (SELECT key, s, CASE WHEN week = 0 THEN 'hibernate' WHEN day >= 20 THEN 'hot' WHEN day >= 3 THEN 'normal' ELSE 'cold' END AS after FROM n)"""


@query(f"""WITH {TICKS}, b AS (SELECT key, s, coalesce(lag(after) OVER (PARTITION BY key ORDER BY s), 'hibernate') AS before, after FROM r) SELECT * FROM b WHERE before <> after""")
def st6_tier_stream(spark, sf_dir):
    """Users as sources: all changes of tier that the watermark, two hours behind, has passed."""
    return timed.once(spark, lambda: timed.tier_stream(timed.table_stream(spark, f"{sf_dir}/events.parquet"), "user_id", "ts", "2 hours"))


@query()
def st5_cluster_stream(spark, sf_dir):
    """Documents as articles, an hour apart, clustered within their language. No SQL for the fold; ``test_cluster_stream_by_timers`` holds it against the batch form."""

    def stream():
        e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("vec"))
        d = timed.table_stream(spark, f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("article_id"), "lang", F.concat_ws(" ", "source", "lang").alias("title"), ((F.col("doc_id") + 1) * 3600.0).alias("seconds"))
        return timed.cluster_stream(d.join(e, "article_id"), "lang", "2 hours")

    return timed.once(spark, stream)


@query("""SELECT conv_id AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS number, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'""")
def t37_posts(spark, sf_dir):
    """Replies with an assistant's turns as posts, cut into pieces that come in two batches."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    post = F.struct("turn", F.struct(F.coalesce("text", F.lit("")).alias("text"), F.lit("a {b} \"c\"").alias("angle")).alias("post"))
    reply = c.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(post)).alias("p"))
    reply = reply.select("id", F.concat(F.lit('{"intro": "\\"posts\\"", "posts" : '), F.to_json(F.transform("p", lambda x: x["post"])), F.lit(', "summary": "{"}')).alias("text"))
    # cut anew every 37 code points; the second half comes a day later
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 37).cast("int")), lambda i: F.struct(i.cast("long").alias("seq"), F.substring(F.col("text"), i * 37 + 1, F.lit(37)).alias("piece")))
    pieces = reply.select("id", F.inline(cut), F.floor(F.length("text") / 74).alias("half")).withColumn("later", F.col("seq") > F.col("half"))
    pieces = pieces.select("id", "seq", "piece", F.timestamp_seconds(F.when(F.col("later"), 172_800).otherwise(86_400)).alias("at"), "later")
    folder = f"{scratch(spark)}/pieces-{uuid.uuid4().hex}"
    for later in (False, True):
        pieces.where(F.col("later") == later).drop("later").write.mode("append").parquet(f"{folder}/in")
        found = timed.run_to_table(posts(timed.table_stream(spark, f"{folder}/in"), "2 days", 2 * 86_400), folder)
    return found.select("id", "number", F.get_json_object("post", "$.text").alias("text"))
