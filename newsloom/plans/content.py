"""Content queries (T13–T41, H7, H9, of R16–R27, C9–C11, E8, D4, V11)."""

from __future__ import annotations

from string import ascii_lowercase

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.catalog import table
from newsloom.functions import content as c
from newsloom.functions import text as t
from newsloom.functions import vector
from newsloom.operators import curation, entities
from newsloom.operators import retrieval as op

from .registry import query
from .retrieval import DENSE, dense
from .text import SPACE, docs


@query(rf"""WITH a AS (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), i AS (SELECT id, a, unnest(range(len(a))) AS line FROM a),
    l AS (SELECT id, line, CASE line % 3 WHEN 0 THEN a[line + 1] WHEN 1 THEN regexp_replace(a[line + 1], '[.]$', ':') ELSE translate(regexp_replace(a[line + 1], '[.]$', ''), '{ascii_lowercase}', '{ascii_lowercase.upper()}') END AS said FROM i), s AS (SELECT *, trim(said) AS s FROM l)
    SELECT id, line, length(s) BETWEEN 3 AND 80 AND len(list_filter(regexp_split_to_array(s, '{SPACE}+'), lambda w: w <> '')) <= 10 AND NOT regexp_matches(s, '[.!?…]$')
        AND (regexp_matches(s, '\p{{L}}') AND NOT regexp_matches(s, '\p{{Ll}}') OR ends_with(s, ':') OR starts_with(s, '#')) AS heading,
      length(s) >= 120 AS substantive, CASE WHEN length(said) <= 3 THEN 0.05 WHEN length(said) <= 6 THEN 0.10 ELSE 0.15 END::DOUBLE AS threshold FROM s""")
def t13_headings(spark, sf_dir):
    """T13, T15 and T29 of every line of every document; a third of the lines end in a colon, and a third are in capitals but for accented letters."""
    d = docs(spark, sf_dir).select("id", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    k, bare = F.col("line") % 3, lambda end: F.regexp_replace("said", "[.]$", end)
    d = d.withColumn("said", F.when(k == 0, F.col("said")).when(k == 1, bare(":")).otherwise(F.translate(bare(""), ascii_lowercase, ascii_lowercase.upper())))
    said = F.col("said")
    return d.select("id", F.col("line").cast("long").alias("line"), c.is_heading(said).alias("heading"), c.is_substantive(said).alias("substantive"), t.phrase_threshold(F.length(said)).cast("double").alias("threshold"))


@query(r"SELECT c_custkey, trim(substr(trim(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-'), 1, 20), '-') AS slug FROM customer")
def t20_slugs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", t.slug(F.concat_ws(" ", "c_name", "c_mktsegment"), 20).alias("slug"))


@query()
def t24_similarity_ratio(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", c.ratio(F.col("p_name"), F.col("p_type")).alias("ratio"))


@query("""WITH x AS (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: length(w) >= 3)) AS a, list_distinct(list_filter(regexp_extract_all(lower(p_type), '[a-z0-9]+'), lambda w: length(w) >= 3)) AS b, lower(p_name) AS n, p_size FROM part)
    SELECT p_partkey, round(coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 0) + CASE WHEN contains(n, 'red') THEN 0.20 ELSE 0 END, 6) AS score FROM x""")
def t25_image_scores(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(c.image_score(F.col("p_name"), F.col("p_type"), F.array(F.lit("RED"))), 6).alias("score"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.7f', x::DOUBLE + sign(x) * 1e-16)), ',') || ']' AS literal, true AS read_back FROM embeddings")
def t38_vector_literals(spark, sf_dir):
    """Written with seven decimals, halves away from zero, and read again, each component to the last decimal."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", vector.to_literal(F.col("embedding")).alias("literal"))
    near = F.zip_with(vector.parse(F.col("literal")), "embedding", lambda a, b: F.abs(a - b) < 1e-6)
    return e.select("vec_id", "literal", F.forall(near, lambda x: F.coalesce(x, F.lit(False))).alias("read_back"))


#: A turn's text without what JSON is made of.
SAID_SQL = "translate(coalesce(text, ''), '[]{}', '')"
WORDS_SQL = f"list_filter(regexp_split_to_array({{}}, '{SPACE.replace('{', '{{').replace('}', '}}')}+'), lambda w: w <> '')"


def _said() -> F.Column:
    return F.translate(F.coalesce("text", F.lit("")), "[]{}", "")


@query(f"""WITH x AS (SELECT conv_id, turn, {SAID_SQL} AS text FROM conversations), w AS (SELECT *, {WORDS_SQL.format("text")} AS w FROM x),
    p AS (SELECT *, substr(coalesce(nullif(CASE WHEN turn % 2 = 0 THEN trim(string_split(text, chr(10))[1]) ELSE '' END, ''), trim(text)), 1, 200) AS topic, list_transform(list_append(w[2:6], 'no such word'), lambda e: lower(e)) AS e FROM w)
    SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'meta_query' ELSE 'news_query' END AS query_class, topic AS topic_query, array_to_string((CASE WHEN turn % 4 = 0 AND len(w) > 0 THEN w[1:7] ELSE {WORDS_SQL.format("lower(topic)")} END)[1:5], ',') AS keywords,
      greatest(1, least(10, length(text) % 20))::INTEGER AS "count", array_to_string(list_transform(list_filter(range(1, len(e) + 1), lambda i: length(e[i]) BETWEEN 3 AND 30 AND contains(lower(text), e[i]) AND list_position(e, e[i]) = i)[1:3], lambda i: e[i]), ',') AS critical, len(w) <= 2 AS short FROM p""")
def t39_plans(spark, sf_dir):
    """Every turn's text as a request, and a model's plan for it out of its first line and words, in part useless."""
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", _said().alias("text")).withColumn("w", t.words(F.col("text")))
    given = F.struct(
        F.when(F.col("turn") % 3 == 0, "meta_query").otherwise("nonsense").alias("query_class"),
        F.when(F.col("turn") % 2 == 0, F.split("text", "\n")[0]).otherwise(" ").alias("topic_query"),
        F.when(F.col("turn") % 4 == 0, F.slice("w", 1, 7)).otherwise(F.array(F.lit(" "))).alias("keywords"),
        (F.length("text") % 20).alias("count"),
        F.concat(F.slice("w", 2, 5), F.array(F.lit("no such word"))).alias("critical_entities"),
    )
    p = x.select("conv_id", "turn", c.valid_plan(F.concat(F.lit("Plan:\n```json\n"), F.to_json(given), F.lit("\n```")), F.col("text")).alias("p"))
    return p.select("conv_id", "turn", "p.query_class", "p.topic_query", F.array_join("p.keywords", ",").alias("keywords"), "p.count", F.array_join("p.critical_entities", ",").alias("critical"), "p.short")


@query(f"""WITH x AS (SELECT conv_id, turn, {SAID_SQL} AS text FROM conversations), k AS (SELECT conv_id, turn, list_filter(list_transform({WORDS_SQL.format("text")}[1:8], lambda w: lower(trim(w))), lambda w: length(w) BETWEEN 1 AND 80)[1:5] AS k,
    list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: length(s) BETWEEN 5 AND 200)[1:3] AS q FROM x)
    SELECT conv_id, turn, CASE WHEN len(k) > 0 THEN array_to_string(k, ',') END AS keywords, CASE WHEN len(q) > 0 THEN array_to_string(q, ',') END AS questions FROM k""")
def t41_chunk_keywords(spark, sf_dir):
    """The words and lines of every turn as a model would return them, taken out of its reply."""
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", _said().alias("text"))
    reply = F.to_json(F.struct(F.slice(t.words(F.col("text")), 1, 8).alias("keywords"), F.split("text", "\n").alias("questions")))
    k = x.select("conv_id", "turn", c.chunk_keywords(F.concat(F.lit("Here: {}\n```json\n"), reply, F.lit("\n```"))).alias("k"))
    return k.select("conv_id", "turn", F.array_join("k.keywords", ",").alias("keywords"), F.array_join("k.questions", ",").alias("questions"))


def _safe_sql() -> str:
    tags = "|".join(rf"<{x}\b.*?</{x}\s*>" for x in ("script", "style", "iframe", "object", "embed", "form"))
    handlers = c.HANDLERS.replace("'", "''").replace('\\"', '"')
    return f"regexp_replace(regexp_replace(html, '(?is)(?:{tags})', '', 'g'), '{handlers}', '', 'g')"


@query(f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(html, '<h1', '<iframe src="x">' || chr(10) || '</IFRAME ><h1 onclick="f(1)" srcdoc=a') ELSE html END AS html FROM pages) SELECT page_id, sha256({_safe_sql()}) AS safe FROM p""")
def h7_strip_dangerous(spark, sf_dir):
    """Every page's html without its scripts, styles and forms, and without a frame and a handler that half of the pages get."""
    framed = F.replace("html", F.lit("<h1"), F.lit('<iframe src="x">\n</IFRAME ><h1 onclick="f(1)" srcdoc=a'))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(c.strip_dangerous(F.when(F.col("page_id") % 2 == 0, framed).otherwise(F.col("html"))), 256).alias("safe"))


@query("SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS day FROM orders")
def h9_page_dates(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    s = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(c.page_date(s)).alias("day"))


@query(f"WITH {DENSE} SELECT query_id, id, round(score + CASE WHEN rank <= 3 AND id % 2 = 0 AND id % 10 >= 6 THEN 0.30 WHEN rank <= 3 AND (id % 2 <> 0 OR id % 10 < 4) THEN -0.10 ELSE 0 END, 6) AS score FROM dense")
def r16_rerank_blend(spark, sf_dir):
    d = dense(spark, sf_dir)
    v = d.select("query_id", "id", (F.col("id") % 2 == 0).alias("answers"), (F.col("id") % 10).alias("grade"))
    return op.rerank_blend(d, v).select("query_id", "id", F.round("score", 6).alias("score"))


@query("SELECT p_partkey, substr(p_name, 1, 200) AS title, p_retailprice AS score FROM part QUALIFY row_number() OVER (PARTITION BY substr(p_name, 1, 200) ORDER BY p_retailprice DESC, p_partkey) = 1")
def r25_distinct_titles(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_name", 1, 200).alias("title"), F.col("p_retailprice").alias("score"))
    return p.withColumn("i", F.row_number().over(Window.partitionBy("title").orderBy(F.desc("score"), "p_partkey"))).where("i = 1").drop("i")


@query("""WITH a(m, c, r, t) AS (SELECT c_custkey, c_nationkey, 1, 0 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, (c_nationkey + 1) % 25, 2, 1 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, (c_nationkey + 2) % 25, 1, 2 FROM customer WHERE c_acctbal > 5000)
    SELECT m AS message_id, c AS cluster, t AS tier FROM a QUALIFY row_number() OVER (PARTITION BY m ORDER BY t, r, c) = 1""")
def c9_resolution_order(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    x = table(spark, sf_dir, "customer")
    row = lambda cluster, rank: (k.alias("message_id"), cluster.cast("int").alias("cluster"), F.lit(rank).alias("rank"))
    return entities.resolve_cluster(x.where(k % 3 == 0).select(*row(n, 1)), x.where(k % 2 == 0).select(*row((n + 1) % 25, 2)), x.select(*row((n + 2) % 25, 1), (F.col("c_acctbal") > 5000).alias("overlap")))


@query("""WITH r AS (SELECT l_orderkey AS message_id, l_suppkey AS cluster, min(l_linenumber) AS rank FROM lineitem GROUP BY ALL), p AS (SELECT message_id, cluster FROM r QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY rank, cluster) = 1)
    SELECT message_id, cluster, row_number() OVER (PARTITION BY message_id ORDER BY rank, cluster) AS place FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.message_id = r.message_id AND p.cluster = r.cluster) QUALIFY place <= 3""")
def c10_secondary_clusters(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("message_id"), F.col("l_suppkey").alias("cluster")).agg(F.min("l_linenumber").alias("rank"))
    p = r.withColumn("i", F.row_number().over(Window.partitionBy("message_id").orderBy("rank", "cluster"))).where("i = 1")
    return entities.secondary_clusters(r, p).select("message_id", "cluster", "place")


@query("""WITH w AS (SELECT lower(n_name) AS key, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey + 100 END AS canonical_id FROM nation), e AS (SELECT n_nationkey AS id, lower(n_name) AS key, n_nationkey + 99 AS canonical_id FROM nation WHERE n_nationkey % 3 = 0),
    f AS (SELECT w.key, e.id, 0 AS tier FROM w JOIN e ON e.canonical_id = w.canonical_id UNION ALL SELECT w.key, e.id, 1 FROM w JOIN e ON e.key = w.key), b AS (SELECT key, id FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier, id) = 1)
    SELECT w.key, b.id AS found, b.id IS NULL AS created FROM w LEFT JOIN b ON b.key = w.key""")
def c11_find_or_create(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    w = n.select(F.lower("n_name").alias("key"), F.when(k % 4 == 0, k + 100).alias("canonical_id"))
    e = n.where(k % 3 == 0).select(k.alias("id"), F.lower("n_name").alias("key"), (k + 99).alias("canonical_id"), F.lit(None).cast("array<string>").alias("aliases"), F.lit(0).alias("created_at"))
    return entities.find_or_create(w, e).select("key", "found", "created")


@query("SELECT DISTINCT lower(c_mktsegment) AS alias, 'org' AS type, CASE WHEN c_nationkey < 5 THEN c_nationkey + 5 ELSE c_nationkey END AS canonical_id FROM customer")
def e8_merge_canonicals(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("alias"), F.lit("org").alias("type"), F.col("c_nationkey").alias("canonical_id"))
    return entities.merge_canonicals(a, spark.range(5).select(F.col("id").cast("int").alias("source"), (F.col("id") + 5).cast("int").alias("target")))


@query("""WITH a AS (SELECT DISTINCT lower(p_name) AS alias, p_partkey % 40 AS id FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1),
    fresh AS (SELECT lower(p_name) AS alias, min(40 + p_partkey % 5) AS id FROM part WHERE p_size <= 5 GROUP BY 1 UNION ALL SELECT lower(n_name), n_nationkey FROM nation),
    added AS (SELECT alias, id FROM a WHERE alias NOT IN (SELECT alias FROM fresh) UNION ALL SELECT * FROM fresh), gone AS (SELECT DISTINCT lower(p_name) AS alias, p_partkey % 40 AS id FROM part WHERE p_size = 50),
    rest AS (SELECT * FROM added WHERE (alias, id) NOT IN (SELECT (alias, id) FROM gone)), moved AS (SELECT DISTINCT alias, CASE WHEN id BETWEEN 40 AND 42 THEN id - 40 ELSE id END AS id FROM rest)
    SELECT i.id, (SELECT count(*) FROM moved m WHERE m.id = i.id) AS alias_count FROM range(45) i(id) WHERE i.id NOT BETWEEN 40 AND 42""")
def e8_alias_operations(spark, sf_dir):
    """Aliases of parts added, removed and merged with their canonical names, then counted anew."""
    p, name = table(spark, sf_dir, "part"), F.lower("p_name").alias("alias")
    org, k = F.lit("org").alias("type"), F.col("p_partkey")
    a = p.groupBy(name).agg((F.min("p_partkey") % 40).alias("canonical_id")).select("alias", org, "canonical_id", F.lit("seed").alias("source"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), "n_name").alias("alias"), org, F.col("n_nationkey").cast("long").alias("canonical_id"))
    a = entities.add_aliases(a, p.where("p_size <= 5").select(name, org, (40 + k % 5).alias("canonical_id")).unionByName(nations))
    a, _ = entities.remove_aliases(a, p.where("p_size = 50").select(name, org, (k % 40).alias("canonical_id")))
    a = entities.merge_canonicals(a, spark.range(40, 43).select(F.col("id").alias("source"), (F.col("id") - 40).alias("target")))
    return entities.recount(spark.range(45).where("id not between 40 and 42"), a)


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def v11_mode_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("conversations"))


@query()
def d4_preference_pairs(spark, sf_dir):
    """Answers to the same question that differ enough, as whole texts, to be a preference pair."""
    p = curation.with_question(table(spark, sf_dir, "conversations")).where("question is not null")
    nxt = p.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("other"))
    j = p.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", c.ratio(F.col("text"), F.col("other")).alias("ratio"))
    return j.withColumn("applicable", F.col("ratio") < 0.95)
