"""Trend queries (TR*) on the mention mapping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.catalog import MENTIONS_SQL, NOW, WINDOW_DAYS, epoch, mentions, table
from newsloom.functions import trend as k
from newsloom.functions.text import kebab
from newsloom.operators import trends as op

from .registry import query

START, BEFORE = "1998-07-02 00:00:00", "1998-06-02 00:00:00"
CUR = f"published_at >= TIMESTAMP '{START}' AND published_at < TIMESTAMP '{NOW}'"
PREV = f"published_at >= TIMESTAMP '{BEFORE}' AND published_at < TIMESTAMP '{START}'"
AGG = f"""agg AS (
    SELECT entity_norm, entity_type, count(DISTINCT article_id) FILTER (WHERE {CUR}) AS cur, count(DISTINCT article_id) FILTER (WHERE {PREV}) AS prev,
           count(DISTINCT source_id) FILTER (WHERE {CUR}) AS sources, avg(reliability) FILTER (WHERE {CUR}) AS reliability,
           max(published_at) FILTER (WHERE {CUR}) AS last_seen_at, min(published_at) AS first_seen_at
    FROM mentions WHERE published_at >= TIMESTAMP '{BEFORE}' AND published_at < TIMESTAMP '{NOW}' GROUP BY ALL
    HAVING count(DISTINCT article_id) FILTER (WHERE {CUR}) >= 2 AND count(DISTINCT source_id) FILTER (WHERE {CUR}) >= 2),
corpus AS (SELECT count(DISTINCT article_id) FILTER (WHERE {CUR}) AS corpus_cur, count(DISTINCT article_id) FILTER (WHERE {PREV}) AS corpus_prev FROM mentions)"""
SCORED = f"""scored AS (
    SELECT *, CASE WHEN prev > 0 THEN (cur - prev) / prev::DOUBLE WHEN cur > 0 THEN NULL ELSE 0.0 END AS momentum,
      CASE WHEN prev <= 0 THEN NULL WHEN corpus_prev > 0 AND corpus_cur > 0 THEN (cur::DOUBLE / prev) / (corpus_cur::DOUBLE / corpus_prev) - 1 ELSE cur::DOUBLE / prev - 1 END AS rel,
      pow(0.5, greatest(0, date_diff('second', first_seen_at, TIMESTAMP '{NOW}') / 3600.0) / 12.0) AS novelty,
      pow(0.5, greatest(0, date_diff('second', last_seen_at, TIMESTAMP '{NOW}') / 3600.0) / 12.0) AS recency,
      least(1.0, sources::DOUBLE / cur) AS diversity
    FROM agg, corpus),
final AS (
    SELECT *, round(0.40 * least(1.0, ln(1 + cur) / ln(51.0)) + 0.25 * (CASE WHEN rel IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, rel)) END)
      + 0.20 * least(1.0, ln(1 + sources) / ln(16.0)) + 0.10 * recency + 0.05 * coalesce(reliability, 0.5), 4) AS score FROM scored)"""
SPARK = f"""slots AS (
    SELECT entity_norm, entity_type, greatest(0, least(9, CAST(floor(date_diff('second', TIMESTAMP '{START}', published_at) / 259200.0) AS INTEGER))) AS b, count(DISTINCT article_id) AS n
    FROM mentions WHERE {CUR} GROUP BY ALL),
lines AS (
    SELECT f.entity_norm, f.entity_type, list(coalesce(n, 0) ORDER BY i) AS sparkline
    FROM (SELECT entity_norm, entity_type FROM final) f CROSS JOIN range(10) r(i)
    LEFT JOIN slots s ON s.entity_norm = f.entity_norm AND s.entity_type = f.entity_type AND s.b = i GROUP BY ALL),
burst AS (
    SELECT *, (list_avg(sparkline[8:10]) - list_avg(sparkline[1:7])) / greatest(list_stddev_pop(sparkline[1:7]), 1.0) AS burst FROM lines),
stated AS (
    SELECT f.*, sparkline, burst,
      CASE WHEN cur = 0 THEN CASE WHEN prev > 0 THEN 'fading' ELSE 'stable' END
           WHEN cur < 3 THEN CASE WHEN burst > 0.3 THEN 'developing' ELSE 'stable' END
           WHEN burst <= -0.5 THEN 'fading' WHEN burst >= 1.0 AND (rel IS NULL OR rel >= 0.25) THEN 'breaking'
           WHEN burst >= 0.3 OR coalesce(rel > 0, false) THEN 'developing' ELSE 'stable' END AS state
    FROM final f JOIN burst USING (entity_norm, entity_type))"""
ALL_SQL = f"WITH {MENTIONS_SQL}, {AGG}, {SCORED}, {SPARK}"
R4 = lambda c: F.round(c, 4).alias(c)


def _trends(spark, sf_dir, limit=None):
    return op.entity_trends(mentions(spark, sf_dir), NOW, WINDOW_DAYS, limit=limit)


@query(f"""{ALL_SQL} SELECT entity_norm, entity_type, cur, prev, sources, round(momentum, 4) AS momentum, round(rel, 4) AS rel_momentum, round(novelty, 4) AS novelty,
    round(diversity, 4) AS diversity, score, array_to_string(sparkline, ',') AS sparkline, round(burst, 4) AS burst, state
    FROM stated ORDER BY score DESC, stated.novelty DESC, entity_norm, entity_type LIMIT 50""")
def tr9_entity_trends(spark, sf_dir):
    t = _trends(spark, sf_dir, 50)
    line = F.array_join(F.transform("sparkline", lambda x: x.cast("string")), ",").alias("sparkline")
    return t.select("entity_norm", "entity_type", "cur", "prev", "sources", *map(R4, ("momentum", "rel_momentum", "novelty", "diversity")), "score", line, R4("burst"), "state")


@query(f"""{ALL_SQL} SELECT entity_norm, entity_type, state, score FROM stated WHERE state IN ('breaking', 'developing')
    ORDER BY CASE state WHEN 'breaking' THEN 0 ELSE 1 END, score DESC, entity_norm, entity_type LIMIT 20""")
def tr12_rising_entities(spark, sf_dir):
    return op.rising(_trends(spark, sf_dir)).select("entity_norm", "entity_type", "state", "score")


CLUSTERS_SQL = MENTIONS_SQL.replace("mentions AS", "plain AS", 1) + """, mentions AS (SELECT article_id, published_at, trim(regexp_replace(lower(entity_norm || ' ' || entity_type), '[^a-z0-9]+', '-', 'g'), '-') AS entity_norm,
    'cluster' AS entity_type, source_id, reliability, mention_count FROM plain)"""


@query(f"""WITH {CLUSTERS_SQL}, {AGG}, {SCORED}, {SPARK} SELECT entity_norm AS cluster_key, cur, prev, sources, round(rel, 4) AS rel_momentum, score, array_to_string(sparkline, ',') AS sparkline, state FROM stated""")
def tr11_cluster_trends(spark, sf_dir):
    """The metrics of TR9 for cluster keys."""
    m = mentions(spark, sf_dir)
    keyed = m.withColumn("entity_norm", kebab(F.concat_ws(" ", "entity_norm", "entity_type"))).withColumn("entity_type", F.lit("cluster"))
    t = op.entity_trends(keyed, NOW, WINDOW_DAYS, limit=None)
    return t.select(F.col("entity_norm").alias("cluster_key"), "cur", "prev", "sources", R4("rel_momentum"), "score", F.array_join(F.transform("sparkline", lambda x: x.cast("string")), ",").alias("sparkline"), "state")


@query(f"{ALL_SQL} SELECT state, count(*) AS n, sum(cur)::BIGINT AS articles FROM stated GROUP BY state")
def tr7_states(spark, sf_dir):
    return _trends(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("cur").alias("articles"))


@query(f"WITH {MENTIONS_SQL}, {AGG} SELECT corpus_cur, corpus_prev, round((corpus_cur - corpus_prev) / nullif(corpus_prev, 0)::DOUBLE, 4) AS growth FROM corpus")
def tr10_corpus_baseline(spark, sf_dir):
    c = op.corpus_counts(mentions(spark, sf_dir), NOW, WINDOW_DAYS)
    return c.select("corpus_cur", "corpus_prev", F.round(k.momentum(F.col("corpus_cur"), F.col("corpus_prev")), 4).alias("growth"))


@query(f"""WITH {MENTIONS_SQL}, c AS (SELECT trim(regexp_replace(lower(entity_type || ' ' || entity_norm), '[^a-z0-9]+', '-', 'g'), '-') AS cluster_key, source_id, count(DISTINCT article_id) AS n
      FROM mentions WHERE {CUR} GROUP BY ALL)
    SELECT cluster_key, source_id, n, row_number() OVER (PARTITION BY cluster_key ORDER BY n DESC, source_id) AS rank FROM c
    QUALIFY row_number() OVER (PARTITION BY cluster_key ORDER BY n DESC, source_id) <= 5""")
def tr13_coverage_sources(spark, sf_dir):
    from newsloom.functions.text import kebab

    _, start, end = op.bounds(NOW, WINDOW_DAYS)
    c = mentions(spark, sf_dir).where(op.between(start, end)).groupBy(kebab(F.concat_ws(" ", "entity_type", "entity_norm")).alias("cluster_key"), "source_id").agg(F.countDistinct("article_id").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_key").orderBy(F.desc("n"), "source_id"))).where("rank <= 5")


@query(f"""{ALL_SQL}, demand AS (SELECT p_brand AS entity_norm, p_type AS entity_type, count(*) AS wanted FROM part GROUP BY ALL ORDER BY wanted DESC, 1, 2 LIMIT 60)
    SELECT entity_norm, entity_type, wanted FROM demand d WHERE NOT EXISTS (SELECT 1 FROM stated s WHERE s.entity_norm = d.entity_norm AND s.entity_type = d.entity_type AND s.state IN ('breaking', 'developing'))""")
def tr14_demand_without_supply(spark, sf_dir):
    demand = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("entity_norm"), F.col("p_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("wanted"))
    demand = demand.orderBy(F.desc("wanted"), "entity_norm", "entity_type").limit(60)
    up = _trends(spark, sf_dir).where(F.col("state").isin("breaking", "developing"))
    return demand.join(up, ["entity_norm", "entity_type"], "left_anti")


SNAP = """WITH c AS (SELECT event_type AS subject, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bucket, count(*) AS n, count(DISTINCT user_id) AS sources FROM events GROUP BY ALL),
    s AS (SELECT c.*, CAST(sum(n) OVER (PARTITION BY subject ORDER BY bucket) AS BIGINT) AS cumulative, list(n) OVER (PARTITION BY subject ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS base FROM c),
    v AS (SELECT s.*, (s.n - a.n)::DOUBLE AS velocity_1h, (s.n - b.n)::DOUBLE AS velocity_6h, (s.n - d.n)::DOUBLE AS velocity_24h,
      CASE WHEN coalesce(len(base), 0) < 1 THEN 0.0 ELSE (s.n - list_avg(base)) / greatest(list_stddev_pop(base), 1.0) END AS burst
      FROM s LEFT JOIN c a ON a.subject = s.subject AND a.bucket = s.bucket - 3600 LEFT JOIN c b ON b.subject = s.subject AND b.bucket = s.bucket - 21600
      LEFT JOIN c d ON d.subject = s.subject AND d.bucket = s.bucket - 86400)
    SELECT v.subject, v.bucket, v.n, v.sources, v.cumulative, v.velocity_1h, v.velocity_6h, v.velocity_24h, round(v.burst, 4) AS burst, v.velocity_1h - w.velocity_1h AS acceleration, v.burst >= 2.0 AS signal
    FROM v LEFT JOIN v w ON w.subject = v.subject AND w.bucket = v.bucket - 3600"""


@query(SNAP)
def tr15_hourly_snapshots(spark, sf_dir):
    return op.snapshots(table(spark, sf_dir, "events"), "event_type", "ts", "user_id").withColumn("burst", F.round("burst", 4))


@query("""WITH c AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS dedupe_key FROM events)
    SELECT user_id, day, dedupe_key, row_number() OVER (PARTITION BY user_id, day ORDER BY dedupe_key) AS rank FROM c QUALIFY rank <= 2""")
def tr17_capped_alerts(spark, sf_dir):
    c = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("day"), F.col("event_type").alias("dedupe_key"))
    return op.capped_alerts(c, "user_id", "day", [F.col("dedupe_key")], 2)


@query("""WITH s AS (SELECT user_id AS source_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR) AS n_24h, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) AS n_7d,
      date_diff('second', min(ts), TIMESTAMP '2024-01-30') / 3600.0 AS age_hours, CASE user_id % 4 WHEN 0 THEN 'hot' WHEN 1 THEN 'normal' WHEN 2 THEN 'cold' ELSE 'hibernate' END AS tier, user_id % 30 AS minutes_in_tier
      FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY user_id),
    w AS (SELECT *, CASE WHEN n_7d = 0 THEN 'hibernate' WHEN n_24h >= 20 THEN 'hot' WHEN n_24h >= 3 THEN 'normal' ELSE 'cold' END AS wanted FROM s)
    SELECT source_id, n_24h, n_7d, tier, wanted, CASE WHEN age_hours < 24 THEN 'normal' WHEN minutes_in_tier < 15 AND wanted <> 'hibernate' AND tier <> 'hibernate' THEN tier ELSE wanted END AS next_tier FROM w""")
def tr19_polling_tiers(spark, sf_dir):
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").where(F.col("ts") < now)
    s = e.groupBy(F.col("user_id").alias("source_id")).agg(
        F.count_if(F.col("ts") >= now - F.expr("INTERVAL 24 HOUR")).alias("n_24h"),
        F.count_if(F.col("ts") >= now - F.expr("INTERVAL 7 DAY")).alias("n_7d"),
        op.hours_since(F.min("ts"), "2024-01-30").alias("age_hours"),
    )
    tier = F.element_at(F.array(*map(F.lit, ("hot", "normal", "cold", "hibernate"))), (F.col("source_id") % 4 + 1).cast("int"))
    s = s.withColumn("tier", tier).withColumn("minutes_in_tier", F.col("source_id") % 30)
    return op.polling_tier(s).select("source_id", "n_24h", "n_7d", "tier", "wanted", "next_tier")


@query("""WITH s AS (SELECT user_id AS source_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS good FROM events GROUP BY 1)
    SELECT source_id, n, good, round(good::DOUBLE / n, 6) AS rate, CASE WHEN n < 5 THEN 'unknown' WHEN good::DOUBLE / n < 0.70 THEN 'red' WHEN good::DOUBLE / n < 0.85 THEN 'yellow' ELSE 'green' END AS health FROM s""")
def tr20_source_health(spark, sf_dir):
    return op.source_health(table(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error").withColumn("rate", F.round("rate", 6))


@query("""WITH c AS (SELECT l_suppkey AS event_id, count(DISTINCT l_orderkey) AS articles, count(DISTINCT l_partkey) AS sources, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1),
    a AS (SELECT *, date_diff('second', last_seen, TIMESTAMP '2001-10-01') / 3600.0 AS age FROM c)
    SELECT event_id, articles, sources, round(greatest(0.0, least(1.0, (log10(greatest(sources, 1) + 1) * 0.5 + log10(greatest(articles, 1) + 1) * 0.5) / log10(11.0))), 6) AS importance,
      CASE WHEN age > 720 THEN 'archived' WHEN age > 168 THEN 'stale' WHEN age > 72 THEN 'cooling' WHEN articles >= 2 THEN 'active' ELSE 'developing' END AS status,
      round(least(1.0, pow(0.5, greatest(age, 0) / 24.0)), 6) AS freshness FROM a""")
def c3_cluster_refresh(spark, sf_dir):
    """Counters, importance, status and freshness of event clusters."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("event_id")).agg(F.countDistinct("l_orderkey").alias("articles"), F.countDistinct("l_partkey").alias("sources"), F.max("l_shipdate").alias("last_seen"))
    age = op.hours_since("last_seen", "2001-10-01")
    return c.select("event_id", "articles", "sources", F.round(k.importance(F.col("sources"), F.col("articles")), 6).alias("importance"), k.cluster_status(age, F.col("articles")).alias("status"), F.round(k.freshness(age), 6).alias("freshness"))


@query("""WITH e AS (SELECT user_id, CAST(epoch(ts) AS BIGINT) AS s FROM events),
    hours AS (SELECT unnest(range(min(s) // 86400 * 86400, max(s) + 1, 86400)) AS bucket FROM e)
    SELECT bucket, count(s) AS n FROM hours LEFT JOIN e ON s // 86400 * 86400 = bucket GROUP BY bucket""")
def tr16_daily_backfill(spark, sf_dir):
    """G9 and TR16: a zero-filled calendar of buckets over the whole range."""
    e = table(spark, sf_dir, "events").select((F.floor(epoch("ts") / 86400) * 86400).alias("bucket"))
    days = e.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(F.explode(F.sequence("a", "b", F.lit(86400).cast("long"))).alias("bucket"))
    return days.join(e.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
