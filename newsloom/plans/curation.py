"""Curation, telemetry and evaluation queries (D*, V*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import epoch, table
from newsloom.operators import curation as op

from .registry import query

PAIRS = """p AS (SELECT conv_id, turn, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question, role FROM conversations)"""
SPLIT = "CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END"
BUCKET = "(('0x' || substr(sha256(conv_id::VARCHAR), 1, 8))::BIGINT % 100)"


@query("""WITH x AS (SELECT c_custkey, c_custkey % 5 <> 0 AS consent, c_custkey % 11 = 0 AS deleted, CAST(c_custkey % 3 AS INTEGER) - 1 AS feedback, c_custkey % 30 AS age, c_custkey % 40 / 400.0 AS edit, length(c_name) + CAST(c_custkey % 10 AS INTEGER) AS len, CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS pii FROM customer)
    SELECT c_custkey, CASE WHEN NOT consent THEN 'no_consent' WHEN deleted THEN 'deleted' WHEN feedback < 0 THEN 'negative_feedback' WHEN age < 7 THEN 'too_recent' WHEN edit >= 0.05 THEN 'edited' WHEN len < 20 THEN 'too_short' WHEN pii > 0 THEN 'pii' ELSE 'eligible' END AS reason FROM x""")
def d1_eligibility(spark, sf_dir):
    k = F.col("c_custkey")
    reason = op.eligibility(k % 5 != 0, k % 11 == 0, k % 3 - 1, k % 30, (k % 40) / 400.0, F.length("c_name") + k % 10, F.when(k % 13 == 0, 1).otherwise(0))
    return table(spark, sf_dir, "customer").select("c_custkey", reason.alias("reason"))


@query(f"WITH c AS (SELECT DISTINCT conv_id, {BUCKET} AS b FROM conversations) SELECT conv_id, {SPLIT} AS split FROM c")
def d2_splits(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", op.split_of(F.col("conv_id")).alias("split"))


EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


@query(f"""WITH {PAIRS}, q AS (SELECT conv_id, turn, {BUCKET} AS b, len(regexp_extract_all(question, '{EMAIL}')) + len(regexp_extract_all(coalesce(text, ''), '{EMAIL}')) AS emails, regexp_replace(question, '{EMAIL}', '[email_redacted]', 'g') AS input
      FROM p WHERE role = 'assistant' AND question IS NOT NULL) SELECT conv_id, turn, {SPLIT} AS split, length(input) AS input_chars FROM q""")
def d3_curate(spark, sf_dir):
    c = op.curate(table(spark, sf_dir, "conversations"))
    return c.select("conv_id", "turn", "split", F.length("input").cast("long").alias("input_chars"))


@query(f"""WITH {PAIRS}, q AS (SELECT {BUCKET} AS b, length(text) AS n FROM p WHERE role = 'assistant' AND question IS NOT NULL), s AS (SELECT {SPLIT} AS split, n FROM q) SELECT split, count(*) AS samples, round(quantile_cont(n, 0.5), 4) AS median_chars FROM s GROUP BY 1""")
def d5_curation_stats(spark, sf_dir):
    p = op.with_question(table(spark, sf_dir, "conversations")).where("question is not null")
    return p.groupBy(op.split_of(F.col("conv_id")).alias("split")).agg(F.count(F.lit(1)).alias("samples"), F.round(F.percentile(F.length("text"), 0.5), 4).alias("median_chars"))


@query("""WITH a AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations)
    SELECT conv_id, turn, CAST(to_json({'messages': [{'role': 'user', 'content': question}, {'role': 'assistant', 'content': text}], 'sources': list_transform(range(1, 11), lambda i: i::VARCHAR)}) AS VARCHAR) AS payload FROM a WHERE role = 'assistant' AND question IS NOT NULL""")
def d6_payload(spark, sf_dir):
    p = op.with_question(table(spark, sf_dir, "conversations")).where("question is not null")
    return p.select("conv_id", "turn", op.chat_payload(F.col("question"), F.col("text"), F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: i.cast("string"))).alias("payload"))


@query("""WITH p AS (SELECT CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 'b' ELSE 'a' END AS period, value FROM events), g AS (SELECT period, count(*) AS n, avg(value) AS mean, quantile_disc(value, 0.95) AS p95 FROM p GROUP BY 1)
    SELECT max(n) FILTER (WHERE period = 'a') AS n_a, max(n) FILTER (WHERE period = 'b') AS n_b, round(max(mean) FILTER (WHERE period = 'a'), 4) AS mean_a, round(max(mean) FILTER (WHERE period = 'b'), 4) AS mean_b,
      max(p95) FILTER (WHERE period = 'a') AS p95_a, max(p95) FILTER (WHERE period = 'b') AS p95_b, round((max(mean) FILTER (WHERE period = 'b') - max(mean) FILTER (WHERE period = 'a')) * 100 / max(mean) FILTER (WHERE period = 'a'), 4) AS change_pct FROM g""")
def v1_period_comparison(spark, sf_dir):
    p = op.periods(table(spark, sf_dir, "events"), "ts", F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"), "value")
    return p.select(*(F.round(c, 4).alias(c) if c.startswith(("mean", "change")) else F.col(c) for c in p.columns))


@query("""WITH c AS (SELECT event_type AS call_type, count(*) AS calls, count(*) FILTER (WHERE user_id % 2 = 0) AS hits, round(avg(value), 4) AS latency FROM events GROUP BY 1) SELECT *, round(hits::DOUBLE / calls, 6) AS hit_rate FROM c""")
def v2_cache_telemetry(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("call_type")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("user_id") % 2 == 0).alias("hits"), F.round(F.avg("value"), 4).alias("latency"))
    return c.withColumn("hit_rate", F.round(F.col("hits") / F.col("calls"), 6))


@query("""SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def v4_hourly_dashboard(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.floor(epoch("ts") / 3600) * 3600).alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE text IS NULL OR text = '') AS empty, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS unlabelled""")
def v5_health(spark, sf_dir):
    d, e, lab = (table(spark, sf_dir, n) for n in ("documents", "embeddings", "labels"))
    a = d.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce(F.col("text"), F.lit("")) == "").alias("empty"))
    return a.crossJoin(e.agg(F.count(F.lit(1)).alias("vectors"))).crossJoin(d.join(lab, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("unlabelled")))  # one row each


@query("""SELECT event_type AS queue, count(*) AS items, count(*) FILTER (WHERE value > 90) AS failed, count(*) FILTER (WHERE value > 90 AND ts >= TIMESTAMP '2024-01-29') AS failed_24h, min(ts) AS oldest FROM events GROUP BY 1""")
def v6_queues(spark, sf_dir):
    bad = F.col("value") > 90
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("queue")).agg(F.count(F.lit(1)).alias("items"), F.count_if(bad).alias("failed"), F.count_if(bad & (F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz"))).alias("failed_24h"), F.min("ts").alias("oldest"))


@query("SELECT event_id, round((user_id * 0.15 + value * 0.6) / 1000000, 6) AS cost FROM events")
def v7_cost(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", op.cost(F.col("user_id"), F.col("value"), F.lit(0.15), F.lit(0.6)).alias("cost"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS top FROM c) SELECT user_id, CASE WHEN count(*) > 1 THEN 'inferred' ELSE min(event_type) END AS verdict, max(n) AS votes FROM m WHERE n = top GROUP BY 1""")
def v9_votes(spark, sf_dir):
    return op.vote(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""SELECT quality, count(*) AS n, count(*) FILTER (WHERE toxic = 0) AS passed, round(count(*) FILTER (WHERE toxic = 0)::DOUBLE / count(*), 6) AS rate FROM labels GROUP BY 1""")
def v10_pass_rate(spark, sf_dir):
    r = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 0).alias("passed"))
    return r.withColumn("rate", F.round(F.col("passed") / F.col("n"), 6))
