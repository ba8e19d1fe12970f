"""Drill-downs and upkeep: trend and supply detail, retention, backfill, subscriptions, samples, candidates, conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.catalog import MENTIONS_SQL, NOW, WINDOW_DAYS, epoch, mentions, scratch, table
from newsloom.functions.text import kebab
from newsloom.operators import curation, entities, ingest, retrieval
from newsloom.operators import trends as op
from newsloom.sources import folders

from .curation import BUCKET, SPLIT
from .registry import query
from .text import REDACTED_SQL
from .trends import AGG, CLUSTERS_SQL, CUR, R4, SCORED, SPARK

#: A brand's first digit is its canonical group, its type the spelling.
GROUPED_SQL = f"""{MENTIONS_SQL}, g AS (SELECT substr(entity_norm, 1, 7) AS subject, * FROM mentions WHERE {CUR})"""


def _grouped(spark, sf_dir):
    aliases = table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity_norm"), F.substring("p_brand", 1, 7).alias("canonical")).distinct()
    return op.grouped_mentions(mentions(spark, sf_dir), aliases)


@query(f"""WITH {GROUPED_SQL}, a AS (SELECT DISTINCT subject, article_id, published_at, source_id FROM g)
    SELECT subject, article_id, published_at, source_id, row_number() OVER (PARTITION BY subject ORDER BY published_at DESC, article_id, source_id) AS rank FROM a QUALIFY rank <= 50""")
def tr10_detail_articles(spark, sf_dir):
    a = op.newest_articles(_grouped(spark, sf_dir), NOW, WINDOW_DAYS, ("subject",))
    return a.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query(f"WITH {GROUPED_SQL} SELECT subject, source_id, count(DISTINCT article_id) AS articles FROM g GROUP BY ALL")
def tr10_detail_sources(spark, sf_dir):
    return op.source_shares(_grouped(spark, sf_dir), NOW, WINDOW_DAYS, ("subject",))


@query(f"""WITH {GROUPED_SQL}, s AS (SELECT subject, entity_norm, entity_type AS surface, count(*) AS n FROM g GROUP BY ALL), m AS (SELECT subject, entity_norm, surface FROM s QUALIFY row_number() OVER (PARTITION BY subject, entity_norm ORDER BY n DESC, surface) = 1)
    SELECT subject, entity_norm, surface, articles FROM (SELECT subject, entity_norm, count(DISTINCT article_id) AS articles FROM g GROUP BY ALL) JOIN m USING (subject, entity_norm)""")
def tr10_detail_variants(spark, sf_dir):
    return op.variants(_grouped(spark, sf_dir), NOW, WINDOW_DAYS, ("subject",), "entity_type").select("subject", "entity_norm", "surface", "articles")


@query(f"""WITH {GROUPED_SQL}, s AS (SELECT subject, greatest(0, least(9, CAST(floor(date_diff('second', TIMESTAMP '1998-07-02 00:00:00', published_at) / 259200.0) AS INTEGER))) AS b, count(DISTINCT article_id) AS n FROM g GROUP BY ALL)
    SELECT f.subject, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY i) AS sparkline FROM (SELECT DISTINCT subject FROM g) f CROSS JOIN range(10) r(i) LEFT JOIN s ON s.subject = f.subject AND b = i GROUP BY 1""")
def tr10_detail_sparklines(spark, sf_dir):
    line = op.sparklines(_grouped(spark, sf_dir), NOW, WINDOW_DAYS, 10, ("subject",))
    return line.select("subject", F.array_join(F.transform("sparkline", lambda x: x.cast("string")), ",").alias("sparkline"))


KEYED_SQL = f"""{MENTIONS_SQL}, g AS (SELECT trim(regexp_replace(lower(entity_norm || ' ' || entity_type), '[^a-z0-9]+', '-', 'g'), '-') AS cluster_key, * FROM mentions WHERE {CUR})"""


@query(f"""WITH {KEYED_SQL}, a AS (SELECT DISTINCT cluster_key, article_id, published_at, source_id FROM g), n AS (SELECT cluster_key, article_id, source_id, row_number() OVER (PARTITION BY cluster_key ORDER BY published_at DESC, article_id, source_id) AS rank FROM a QUALIFY rank <= 20),
      s AS (SELECT cluster_key, source_id, count(DISTINCT article_id) AS articles FROM g GROUP BY ALL)
    SELECT cluster_key, rank, article_id, source_id, articles AS of_source FROM n JOIN s USING (cluster_key, source_id)""")
def tr13_supply_detail(spark, sf_dir):
    """The newest articles of each cluster key, each with what its source supplies; ``tr11_cluster_trends`` has the metrics and sparklines."""
    m = mentions(spark, sf_dir).withColumn("cluster_key", kebab(F.concat_ws(" ", "entity_norm", "entity_type")))
    newest, shares = op.newest_articles(m, NOW, WINDOW_DAYS, ("cluster_key",), 20), op.source_shares(m, NOW, WINDOW_DAYS, ("cluster_key",))
    return newest.join(shares, ["cluster_key", "source_id"]).select("cluster_key", "rank", "article_id", "source_id", F.col("articles").alias("of_source"))


@query("""SELECT o_orderpriority AS subject, CAST(floor(epoch(o_orderdate) / 86400) * 86400 AS BIGINT) AS bucket, count(*) AS n FROM orders WHERE CAST(floor(epoch(o_orderdate) / 86400) * 86400 AS BIGINT) >= epoch(TIMESTAMP '1998-08-01') - 180 * 86400 GROUP BY ALL""")
def tr16_retention(spark, sf_dir):
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("subject"), (F.floor(epoch("o_orderdate") / 86400) * 86400).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return op.retained(b, NOW)


@query("""SELECT event_type AS subject, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bucket, count(*) FILTER (WHERE event_id % 10 <> 0 OR ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20') AS n FROM events
    GROUP BY ALL HAVING n > 0""")
def st2_backfill(spark, sf_dir):
    """Buckets closed without the late events (every tenth), mended by counting a half-open range again and upserting it, twice over."""
    e = table(spark, sf_dir, "events")
    count = lambda df: df.groupBy(F.col("event_type").alias("subject"), (F.floor(epoch("ts") / 3600) * 3600).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    again = count(e.where((F.col("ts") >= at("2024-01-10")) & (F.col("ts") < at("2024-01-20"))))
    once = ingest.upsert(count(e.where("event_id % 10 <> 0")), again, ["subject", "bucket"])
    return ingest.upsert(once, again, ["subject", "bucket"])


@query(f"""WITH {CLUSTERS_SQL}, {AGG}, {SCORED}, {SPARK}, u AS (SELECT p_partkey % 7 AS user_id, trim(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS cluster_key, max(p_partkey) AS subscribed_at FROM part WHERE p_size > 5 GROUP BY ALL)
    SELECT user_id, cluster_key, subscribed_at, row_number() OVER (PARTITION BY user_id ORDER BY subscribed_at DESC, cluster_key) AS rank, coalesce(cur, 0) AS cur, round(rel, 4) AS rel_momentum, coalesce(state, 'quiet') AS state
    FROM u LEFT JOIN stated ON entity_norm = cluster_key QUALIFY rank <= 200""")
def tr18_my_clusters(spark, sf_dir):
    from .trends import tr11_cluster_trends

    key = kebab(F.concat_ws(" ", "p_brand", "p_type")).alias("cluster_key")
    subs = table(spark, sf_dir, "part").where("p_size > 5").groupBy((F.col("p_partkey") % 7).alias("user_id"), key).agg(F.max("p_partkey").alias("subscribed_at"))
    f = op.followed(subs.withColumn("ended", F.lit(False)), tr11_cluster_trends(spark, sf_dir))
    return f.select("user_id", "cluster_key", "subscribed_at", "rank", "cur", "rel_momentum", "state")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey FROM orders) WHERE o_custkey IS NOT NULL)")
def j4_not_in(spark, sf_dir):
    """NOT IN over a side without its nulls is the anti join."""
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(o.where("c_custkey is not null"), "c_custkey", "left_anti")


ANSWERS_SQL = """a AS (SELECT conv_id * 1000 + turn AS message_id, conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations),
    b AS (SELECT message_id, question, text AS answer, turn % 3 <> 0 AS eligible, turn % 2 = 1 AS rejected, CASE WHEN conv_id % 3 = 0 THEN 'better: ' || text END AS chosen FROM a WHERE role = 'assistant' AND question IS NOT NULL AND conv_id % 10 <> 0)"""


SAMPLES_SQL = f"""WITH {ANSWERS_SQL}, r0 AS (SELECT b.*, concat_ws(chr(10), question, coalesce(answer, ''), chosen) AS text FROM b WHERE eligible OR rejected), {REDACTED_SQL},
    h AS (SELECT *, email + iban + uuid + ip + tc > 0 OR regexp_matches(' ' || text, '[^0-9](\\+90|0)?[\\s\\-]*\\(?[0-9]{{3}}\\)?[\\s\\-]*[0-9]{{3}}[\\s\\-]*[0-9]{{2}}[\\s\\-]*[0-9]{{2}}([^0-9]|$)') AS pii FROM r5),
    k AS (SELECT message_id, 'excluded' AS sample_type, NULL AS output FROM h WHERE pii UNION ALL SELECT message_id, 'sft', answer FROM h WHERE NOT pii AND eligible UNION ALL SELECT message_id, 'dpo_rejected', answer FROM h WHERE NOT pii AND rejected
      UNION ALL SELECT message_id, 'dpo_chosen', chosen FROM h WHERE NOT pii AND rejected AND coalesce(chosen, '') <> ''),
    s AS (SELECT *, {BUCKET.replace('conv_id', 'message_id')} AS b FROM k) SELECT message_id, {SPLIT} AS split, sample_type, sha256(output) AS output FROM s"""


@query(SAMPLES_SQL)
def d3_samples(spark, sf_dir):
    """Answers of every tenth conversation are curated already."""
    a = curation.with_question(table(spark, sf_dir, "conversations")).withColumn("message_id", F.col("conv_id") * 1000 + F.col("turn"))
    a = a.withColumns({"eligible": F.col("turn") % 3 != 0, "rejected": F.col("turn") % 2 == 1, "edited": F.lit(None).cast("string"), "chosen": F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("better: "), "text"))})
    done = table(spark, sf_dir, "conversations").where("conv_id % 10 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"))
    return curation.samples(a, done).select("message_id", "split", "sample_type", F.sha2("output", 256).alias("output"))


@query(SAMPLES_SQL)
def sc11_export(spark, sf_dir):
    """The same samples, exported as JSON lines by split and read back."""
    folders.register(spark)
    folder = f"{scratch(spark)}/samples-{uuid.uuid4().hex}"
    d3_samples(spark, sf_dir).write.format("newsloom_samples").mode("append").save(folder)
    return spark.read.schema("message_id long, sample_type string, output string, split string").json(folder).select("message_id", "split", "sample_type", "output")


@query("""WITH r AS (SELECT conv_id AS artifact_id, conv_id * 1000 + turn AS revision_id, row_number() OVER w AS seq, lag(conv_id * 1000 + turn) OVER w AS parent_id, CASE turn % 3 WHEN 0 THEN 'edit' WHEN 1 THEN 'freetext' ELSE 'initial' END AS intent, 'query ' || conv_id AS query
      FROM conversations WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    a AS (SELECT artifact_id, max(revision_id) AS head_id, artifact_id % 30 AS age_days, count(*) AS revisions FROM r GROUP BY ALL),
    d AS (SELECT artifact_id, seq, 'sft' AS sample_type, revision_id % 4 = 1 AS applicable FROM r WHERE artifact_id % 2 = 0 UNION ALL SELECT artifact_id, seq, 'dpo_chosen', NULL FROM r WHERE artifact_id % 6 = 0)
    SELECT a.artifact_id, h.seq AS head_seq, p.seq AS parent_seq, 'query ' || a.artifact_id AS effective_query, revisions, NOT EXISTS (SELECT 1 FROM d WHERE d.artifact_id = a.artifact_id AND d.seq = h.seq AND sample_type = 'sft') AS fresh, age_days
    FROM a JOIN r h ON h.revision_id = head_id LEFT JOIN r p ON p.revision_id = h.parent_id WHERE a.artifact_id % 7 <> 0 AND age_days > 7 AND (NOT EXISTS (SELECT 1 FROM d WHERE d.artifact_id = a.artifact_id AND d.seq = h.seq AND sample_type = 'sft')
      OR h.intent IN ('edit', 'freetext') AND EXISTS (SELECT 1 FROM d WHERE d.artifact_id = a.artifact_id AND d.seq = h.seq AND sample_type = 'sft' AND applicable) AND NOT EXISTS (SELECT 1 FROM d WHERE d.artifact_id = a.artifact_id AND d.seq = h.seq AND sample_type = 'dpo_chosen'))""")
def d4_candidates(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rid = F.col("conv_id") * 1000 + F.col("turn")
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    intent = F.element_at(F.array(*map(F.lit, ("edit", "freetext", "initial"))), (F.col("turn") % 3 + 1).cast("int"))
    r = c.select(rid.alias("revision_id"), F.col("conv_id").alias("artifact_id"), F.row_number().over(w).alias("seq"), F.lag(rid).over(w).alias("parent_id"), intent.alias("intent"), F.concat(F.lit("query "), "conv_id").alias("query"))
    a = r.groupBy("artifact_id").agg(F.max("revision_id").alias("head_id")).withColumns({"consented": F.col("artifact_id") % 7 != 0, "age_days": F.col("artifact_id") % 30})
    sample = lambda df, kind, ok: df.select("artifact_id", "seq", F.lit(kind).alias("sample_type"), ok.alias("applicable"))
    done = sample(r.where("artifact_id % 2 = 0"), "sft", F.col("revision_id") % 4 == 1).unionAll(sample(r.where("artifact_id % 6 = 0"), "dpo_chosen", F.lit(None).cast("boolean")))
    return curation.artifact_candidates(a, r, done, 10_000)


@query(f"""WITH {MENTIONS_SQL}, f AS (SELECT entity_norm AS alias, entity_type AS type, count(DISTINCT article_id) AS articles FROM mentions GROUP BY ALL HAVING articles >= 2), s AS (SELECT DISTINCT p_brand AS alias, p_type AS type, substr(p_brand, 1, 7) AS canonical FROM part WHERE p_size < 40),
    o AS (SELECT DISTINCT substr(p_brand, 1, 7) AS canonical, p_type AS type, CASE WHEN length(p_type) % 3 = 0 THEN 'admin' ELSE 'wikidata' END AS source FROM part WHERE length(p_type) % 2 = 0)
    SELECT alias, type, canonical, coalesce(source, 'seed') AS source, articles FROM f JOIN s USING (alias, type) LEFT JOIN o USING (canonical, type)""")
def e5_builder(spark, sf_dir):
    p, n = table(spark, sf_dir, "part"), F.length("p_type")
    group = F.substring("p_brand", 1, 7).alias("canonical")
    seeds = p.where("p_size < 40").select(F.col("p_brand").alias("alias"), F.col("p_type").alias("type"), group).distinct()
    owned = p.where(n % 2 == 0).select(group, F.col("p_type").alias("type"), F.when(n % 3 == 0, "admin").otherwise("wikidata").alias("source")).distinct()
    return entities.build_canonicals(mentions(spark, sf_dir), seeds, owned)


@query("""WITH m AS (SELECT user_id, event_id, user_id * 1000 + event_id // 1000 AS conv_id, date_diff('second', ts, TIMESTAMP '2024-01-31') / 3600.0 AS age, value > 30 AS ok FROM events), t AS (
      SELECT h, m.*, row_number() OVER (PARTITION BY h, user_id ORDER BY age, event_id) AS n FROM m JOIN (VALUES (6), (24), (72)) w(h) ON age <= h),
    a AS (SELECT user_id, event_id AS anchor, conv_id FROM t WHERE n <= 8 AND ok QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY h, n) = 1)
    SELECT a.user_id, anchor, m.event_id AS id, row_number() OVER (PARTITION BY a.user_id ORDER BY m.age DESC, m.event_id) AS place FROM a JOIN m USING (conv_id)""")
def r24_conversation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    conv = F.col("user_id") * 1000 + F.floor(F.col("event_id") / 1000)
    m = e.select("user_id", F.col("event_id").alias("id"), conv.alias("conv_id"), op.hours_since("ts", "2024-01-31").alias("age_hours"), "value")
    return retrieval.anchored_conversation(m, retrieval.context_anchor(m, F.col("value") > 30))
