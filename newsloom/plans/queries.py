"""Query-understanding and further retrieval and entity queries (of T14–T40, R5–R27, E1–E6, C5, TR18)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.catalog import MENTIONS_SQL, mentions, spread, table
from newsloom.functions import query as qf
from newsloom.functions import trend
from newsloom.operators import entities, retrieval as op

from .registry import query
from .retrieval import ASKED_SQL, DENSE, asked_of, dense

#: Questions in the table's place: a verb, a place, a mark.
ASK = "CASE c_custkey % 4 WHEN 0 THEN 'kim ' || lower(c_mktsegment) WHEN 1 THEN lower(c_mktsegment) || ' haber' WHEN 2 THEN 'bu hafta ' || c_mktsegment || ' ve yeni plan' ELSE 'peki ' || lower(c_mktsegment) || ' 2024' END"


def asks(spark, sf_dir):
    k, low = F.col("c_custkey") % 4, F.lower("c_mktsegment")
    text = F.when(k == 0, F.concat(F.lit("kim "), low)).when(k == 1, F.concat(low, F.lit(" haber"))).when(k == 2, F.concat(F.lit("bu hafta "), "c_mktsegment", F.lit(" ve yeni plan"))).otherwise(F.concat(F.lit("peki "), low, F.lit(" 2024")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))


MARKS = " OR ".join(f"contains(trim(lower(text)), '{m}')" for m in qf.QUESTION_MARKERS)


@query(f"WITH a AS (SELECT c_custkey, {ASK} AS text FROM customer) SELECT c_custkey, {MARKS} AS question FROM a")
def t32_question_test(spark, sf_dir):
    return asks(spark, sf_dir).select("c_custkey", qf.is_question(F.col("text")).alias("question"))


@query(f"""WITH a AS (SELECT c_custkey, {ASK} AS text, c_custkey % 4 AS k, lower(c_mktsegment) AS low FROM customer)
    SELECT c_custkey, CASE k WHEN 1 THEN low WHEN 3 THEN low || ',peki' END AS entities FROM a""")
def t33_planner_bypass(spark, sf_dir):
    return asks(spark, sf_dir).select("c_custkey", F.array_join(qf.planner_bypass(F.col("text")), ",").alias("entities"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN false WHEN 0 THEN false WHEN 1 THEN false ELSE true END AS standalone FROM customer")
def t30_standalone(spark, sf_dir):
    return asks(spark, sf_dir).select("c_custkey", qf.is_standalone(F.col("text")).alias("standalone"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 THEN 'bu hafta ' || c_mktsegment || '|yeni plan' ELSE '' END AS parts FROM customer")
def t31_decompose(spark, sf_dir):
    return asks(spark, sf_dir).select("c_custkey", F.array_join(qf.decompose(F.col("text")), "|").alias("parts"))


@query(f"WITH a AS (SELECT c_custkey, {ASK} AS text FROM customer), t AS (SELECT c_custkey, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zı0-9][a-zı0-9-]*'), lambda w: length(w) >= 5)) AS t FROM a) SELECT c_custkey, array_to_string(list_sort(t), ',') AS candidates FROM t")
def t18_candidates(spark, sf_dir):
    return asks(spark, sf_dir).select("c_custkey", F.array_join(F.array_sort(qf.entity_candidates(F.col("text"))), ",").alias("candidates"))


FILLERS_SQL = ", ".join(f"'{f}'" for f in qf.FILLERS)
PHRASES_SQL = " UNION ALL ".join(f"SELECT c_custkey, {n} * 1000 + i AS pos, array_to_string(w[i:i + {n - 1}], ' ') AS g, w[i:i + {n - 1}] AS ws FROM (SELECT c_custkey, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w WHERE len(w) >= {n})" for n in (2, 3, 4))


@query(f"""WITH w AS (SELECT c_custkey, list_filter(string_split_regex(lower({ASK}), '\\s+'), lambda x: x <> '') AS w FROM customer), g AS ({PHRASES_SQL}),
    k AS (SELECT c_custkey, g, min(pos) AS pos FROM g WHERE length(g) >= 5 AND len(list_filter(ws, lambda x: x NOT IN ({FILLERS_SQL}))) > 0 GROUP BY ALL), j AS (SELECT c_custkey, string_agg(g, '|' ORDER BY pos) AS phrases FROM k GROUP BY 1)
    SELECT c_custkey, coalesce(phrases, '') AS phrases FROM customer LEFT JOIN j USING (c_custkey)""")
def t16_phrases(spark, sf_dir):
    return asks(spark, sf_dir).select("c_custkey", F.array_join(qf.phrases(F.lower("text")), "|").alias("phrases"))


@query("SELECT o_orderkey, CAST(greatest(6, least(2160, ceil(date_diff('second', o_orderdate, TIMESTAMP '1998-08-01') / 3600.0))) AS INTEGER) AS hours FROM orders WHERE o_orderdate < TIMESTAMP '1998-08-01'")
def t35_since_hours(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1998-08-01").cast("timestamp_ntz"))
    return o.select("o_orderkey", qf.since_hours(F.col("o_orderdate").cast("timestamp"), F.lit("1998-08-01").cast("timestamp"), 2160).alias("hours"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS tier, n_nationkey % 2 = 0 AS noise, n_nationkey % 5 = 0 AS generic FROM nation""")
def t36_title_tiers(spark, sf_dir):
    """T21, T36 and T40."""
    k = F.col("n_nationkey")
    title = F.when(k % 3 == 0, F.upper("n_name")).when(k % 3 == 1, F.concat("n_name", F.lit(" (film)"))).otherwise(F.concat("n_name", F.lit(" x")))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", qf.title_tier(title, F.lower("n_name")).alias("tier"), qf.is_noise(F.when(k % 2 == 0, "Bugün").otherwise(F.col("n_name"))).alias("noise"), qf.is_generic(F.when(k % 5 == 0, "maçı haber").otherwise(F.lit("süper lig"))).alias("generic")
    )


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE CASE p_partkey % 3 WHEN 1 THEN p_brand ELSE '2. Lig' END END AS base, CASE p_partkey % 3 WHEN 0 THEN '2024' END AS edition FROM part WHERE contains(p_name, ' ')")
def e6_event_edition(spark, sf_dir):
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat(F.lit("2024 "), "p_name")).when(k == 1, F.col("p_brand")).otherwise("2. Lig")
    return table(spark, sf_dir, "part").where(F.contains("p_name", F.lit(" "))).select("p_partkey", qf.event_edition(t).alias("x")).select("p_partkey", "x.base", "x.edition")


ASKED = "asked(query_id, entity) AS (VALUES (1, 'Brand#11'), (1, 'Brand#22'), (2, 'Brand#31'), (3, 'no brand'))"


def asked(spark):
    return spark.createDataFrame([(1, "Brand#11"), (1, "Brand#22"), (2, "Brand#31"), (3, "no brand")], "query_id int, entity string")


def named(spark, sf_dir):
    return mentions(spark, sf_dir).select(F.col("entity_norm").alias("entity"), "article_id", "published_at")


@query(f"""WITH {MENTIONS_SQL}, {ASKED}, n AS (SELECT query_id, count(DISTINCT entity) AS need FROM asked GROUP BY 1), g AS (SELECT query_id, article_id AS id, count(DISTINCT entity) AS got, max(published_at) AS seen FROM asked JOIN mentions ON entity_norm = entity GROUP BY ALL)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY seen DESC, id) AS rank FROM g JOIN n USING (query_id) WHERE got = need QUALIFY rank <= 30""")
def r9_rescue(spark, sf_dir):
    return op.rescue(asked(spark), named(spark, sf_dir), 30).select("query_id", "id", "rank")


@query(f"""WITH {MENTIONS_SQL}, {DENSE}, l AS (SELECT DISTINCT article_id AS id FROM mentions WHERE entity_norm = 'Brand#11'), b AS (SELECT query_id, dense.id, score + CASE WHEN l.id IS NOT NULL THEN 0.05 ELSE 0 END AS score, rank AS before FROM dense LEFT JOIN l ON l.id = dense.id)
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, id) AS rank FROM b""")
def r15_affinity(spark, sf_dir):
    liked = asked_of(table(spark, sf_dir, "embeddings"), "vec_id").select(F.col("vec_id").alias("query_id"), F.lit("Brand#11").alias("entity"))
    return op.affinity_boost(dense(spark, sf_dir), liked, named(spark, sf_dir)).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {DENSE}, c AS (SELECT id // 5 AS article_id, min(id) AS chunk FROM (SELECT vec_id AS id FROM embeddings) GROUP BY 1), n AS (SELECT DISTINCT query_id, id AS article_id FROM dense WHERE rank <= 10)
    SELECT query_id, chunk AS id, c.article_id, row_number() OVER (PARTITION BY query_id ORDER BY c.article_id) AS rank FROM n JOIN c USING (article_id)""")
def r5_summary_stream(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = asked_of(e, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    chunks = e.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 5).alias("article_id"), (F.col("vec_id") % 5).alias("chunk_index"))
    return op.summary_stream(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), chunks, 10)


@query(f"""WITH {DENSE}, s AS (SELECT q.vec_id AS answer_id, x.vec_id AS claim_id, e.vec_id AS source_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), 6) AS cos
      FROM embeddings q JOIN embeddings x ON x.vec_id // 20 = q.vec_id // 20 AND x.vec_id % 20 BETWEEN 1 AND 3 JOIN embeddings e ON e.vec_id // 20 = q.vec_id // 20 AND e.vec_id % 20 > 3 WHERE {ASKED_SQL.format('q.vec_id')})
    SELECT answer_id, claim_id, source_id, cos, cos >= 0.25 AS supported FROM s QUALIFY row_number() OVER (PARTITION BY answer_id, claim_id ORDER BY cos DESC, source_id) = 1""")
def r22_citations(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    own, answer = F.col("vec_id") % 20, (F.col("vec_id") - F.col("vec_id") % 20).alias("answer_id")  # an answer, its three claims and its sources follow one another
    claims = e.where(own.between(1, 3)).select(answer, F.col("vec_id").alias("claim_id"), "vec")
    sources = e.where(own > 3).select(answer, F.col("vec_id").alias("source_id"), "vec")
    return op.supported(claims, sources, 0.25)


@query("""WITH m AS (SELECT user_id, event_id, date_diff('second', ts, TIMESTAMP '2024-01-31') / 3600.0 AS age, value > 30 AS ok FROM events), t AS (
      SELECT h, m.*, row_number() OVER (PARTITION BY h, user_id ORDER BY age, event_id) AS n FROM m JOIN (VALUES (6), (24), (72)) w(h) ON age <= h)
    SELECT user_id, event_id AS id, h AS hours FROM t WHERE n <= 8 AND ok QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY h, n) = 1""")
def r24_context_anchor(spark, sf_dir):
    from newsloom.operators.trends import hours_since

    m = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.lit(0).alias("conv_id"), hours_since("ts", "2024-01-31").alias("age_hours"), "value")
    return op.context_anchor(m, F.col("value") > 30).select("user_id", "id", "hours")


@query("""WITH n AS (SELECT user_id AS query_id, event_id AS id, ts AS at FROM events WHERE event_type = 'error' AND value > 80), w AS (SELECT user_id AS query_id, event_id AS id, ts AS at FROM events WHERE value > 80)
    SELECT query_id, id, false AS fallback FROM n UNION ALL SELECT query_id, id, true FROM w WHERE query_id NOT IN (SELECT query_id FROM n)""")
def r20_fallback_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 80").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("ts").alias("at"), "event_type")
    narrow = e.where("event_type = 'error'").drop("event_type").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    return op.with_fallback(narrow.select("query_id", "id", "rank"), e.drop("event_type")).select("query_id", "id", "fallback")


@query("SELECT event_id, sha1(lower(event_type) || '|' || user_id) AS key FROM events")
def r27_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", qf.cache_key(F.col("event_type"), F.col("user_id")).alias("key"))


@query("""SELECT s_suppkey, round(pow(0.5, (s_suppkey % 72) / 24.0), 6) AS freshness, round(0.5 * (s_suppkey % 10) / 10.0 + 0.25 * (s_suppkey % 7) / 7.0 + 0.15 * pow(0.5, (s_suppkey % 72) / 24.0) + 0.1 * 0.8, 6) AS score FROM supplier""")
def r14_final_score(spark, sf_dir):
    """R13 and R14."""
    k = F.col("s_suppkey")
    f = trend.freshness((k % 72).cast("double"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(f, 6).alias("freshness"), F.round(trend.final_score(k % 10 / 10.0, k % 7 / 7.0, f, F.lit(0.8)), 6).alias("score"))


@query("""WITH c AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS kw, [lower(p_type), lower(p_name)] AS qs FROM part), q(query_id, phrase, ws) AS (VALUES (1, 'red steel', ['red', 'steel']), (2, 'small copper', ['small', 'copper', 'plated'])),
    j AS (SELECT query_id, id, len(list_filter(qs, lambda x: contains(x, phrase))) > 0 AS q_match, len(list_filter(ws, lambda w: contains(qs[1], w) OR contains(qs[2], w))) AS overlap, len(list_filter(kw, lambda k: list_contains(ws, k))) AS kw_match FROM c, q
      WHERE list_has_any(kw, ws) OR list_has_any(list_concat(string_split(qs[1], ' '), string_split(qs[2], ' ')), ws))
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY q_match DESC, overlap DESC, kw_match DESC, id) AS rank, CASE WHEN q_match THEN 15 WHEN overlap >= 3 THEN 18 WHEN kw_match >= 2 THEN 20 WHEN overlap >= 2 THEN 22 ELSE 30 END AS k FROM j QUALIFY rank <= 30""")
def r7_keyword_stream(spark, sf_dir):
    q = spark.createDataFrame([(1, "red steel", ["red", "steel"]), (2, "small copper", ["small", "copper", "plated"])], "query_id int, phrase string, words array<string>")
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), " ").alias("keywords"), F.array(F.lower("p_type"), F.lower("p_name")).alias("questions"))
    return op.keyword_stream(q, c, 30).select("query_id", "id", "rank", "k")


@query(f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents), n AS (SELECT *, regexp_extract_all(text, '([A-Z][a-z]+)', 1)[1:40] AS n, lower(concat_ws(' ', title, source, substr(text, length(title) + 2))) AS whole FROM d),
    i AS (SELECT *, unnest(n) AS name FROM n), e AS (SELECT DISTINCT doc_id, title, source, whole, lower(name) AS norm, CASE length(name) % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'misc' ELSE 'org' END AS type FROM i)
    SELECT doc_id AS article_id, type AS entity_type, norm AS entity_norm, CASE WHEN contains(lower(title), norm) THEN 'title' WHEN contains(lower(source), norm) THEN 'subtitle' ELSE 'body' END AS first_position,
      least(999, greatest(1, (length(whole) - length(replace(whole, norm, ''))) // length(norm)))::INTEGER AS mention_count FROM e WHERE length(norm) BETWEEN 2 AND 200 AND norm NOT IN ({", ".join(f"'{x}'" for x in qf.NOISE)})""")
def e1_extraction(spark, sf_dir):
    """Capitalised words of every document as an extractor's reply, of kinds that it knows, writes in capitals, or makes up."""
    text = F.coalesce("text", F.lit(""))
    kind = lambda w: F.when(F.length(w) % 3 == 0, "PERSON").when(F.length(w) % 3 == 1, "city").otherwise("org")
    j = F.to_json(F.transform(F.regexp_extract_all(text, F.lit("([A-Z][a-z]+)"), F.lit(1)), lambda w: F.struct(w.alias("text"), kind(w).alias("type"))))
    title = F.substring_index(text, "\n", 1)
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(F.col("doc_id").alias("article_id"), title.alias("title"), F.col("source").alias("subtitle"), F.substr(text, F.length(title) + 2).alias("body"), j.alias("json"))
    return entities.from_extraction(d).select("article_id", "entity_type", "entity_norm", "first_position", "mention_count")


@query("""WITH l AS (SELECT l_suppkey, l_shipdate, l_quantity FROM lineitem), c AS (SELECT l_suppkey AS cluster, count(*) AS articles, max(l_quantity) AS q FROM l GROUP BY 1)
    SELECT cluster, articles, (SELECT min(l_orderkey) FROM lineitem x WHERE x.l_suppkey = cluster AND x.l_quantity = q) AS representative FROM c ORDER BY articles DESC, cluster LIMIT 8""")
def c5_weekly_cards(spark, sf_dir):
    """The largest groups with their representative member."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cluster")).agg(F.count(F.lit(1)).alias("articles"), F.max_by("l_orderkey", F.struct("l_quantity", (-F.col("l_orderkey")).alias("k"))).alias("representative"))
    return c.orderBy(F.desc("articles"), "cluster").limit(8)


@query("""WITH d AS (SELECT doc_id AS id, source || ' ' || lang AS g, doc_id % 9 AS n, CASE WHEN doc_id % 11 > 0 THEN lang || (doc_id % 10 < 8)::INTEGER END AS country, text FROM documents),
    s AS (SELECT g, count(*) AS cards, arg_max(id, n * 1000000000 - id) AS representative, arg_min(text, id) AS text FROM d GROUP BY 1), f AS (SELECT * FROM s ORDER BY cards DESC, g LIMIT 8),
    w AS (SELECT g, country, sum(greatest(1, n)) AS w FROM d WHERE country IS NOT NULL GROUP BY ALL), v AS (SELECT g, country FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY w DESC, country) = 1 AND w::DOUBLE / sum(w) OVER (PARTITION BY g) >= 0.6)
    SELECT f.g AS "group", cards, representative, country, f.g AS title, substr(text, 1, 2000) AS summary, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda p: p <> '')[1:6], lambda p: substr(p, 1, 200)), '|') AS points, 0.5::DOUBLE AS importance
    FROM f LEFT JOIN v ON v.g = f.g WHERE coalesce(text, '') <> ''""")
def c5_weekly_build(spark, sf_dir):
    """Documents as daily cards of their source and language; what a model would say is the text of the group's first one."""
    from newsloom.operators import clusters

    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(F.concat_ws(" ", "source", "lang").alias("group"), k.alias("id"), (k % 9).alias("article_count"), F.when(k % 11 > 0, F.concat("lang", (k % 10 < 8).cast("int").cast("string"))).alias("country"), "text")
    first = d.groupBy("group").agg(F.min_by("text", "id").alias("text"))
    said = F.to_json(F.struct(F.col("group").alias("title"), F.col("text").alias("summary"), F.split("text", "\n").alias("key_points"), F.lit("").alias("importance")))
    replies = first.select("group", F.when(F.length("group") % 2 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(said).alias("reply"))
    return clusters.weekly_cards(d, replies).select("group", "cards", "representative", "country", "title", "summary", F.array_join("key_points", "|").alias("points"), "importance")


@query(f"WITH {MENTIONS_SQL} SELECT entity_norm, count(*) AS n FROM mentions WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_brand = entity_norm AND p_size = 50 AND p_partkey % 3 = 0) GROUP BY 1 ORDER BY n DESC, entity_norm LIMIT 10")
def tr18_discover(spark, sf_dir):
    """What a user does not follow yet, most mentioned first."""
    followed = table(spark, sf_dir, "part").where("p_size = 50 and p_partkey % 3 = 0").select(F.col("p_brand").alias("entity_norm"))
    return mentions(spark, sf_dir).join(followed, "entity_norm", "left_anti").groupBy("entity_norm").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_norm").limit(10)
