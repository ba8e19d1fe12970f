"""Whole searches (R1, R2, R28) and further operators: T12, T26, T34, E7, H10, V3."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import MENTIONS_SQL, mentions, spread, table
from newsloom.functions import content as c
from newsloom.functions import query as qf
from newsloom.functions import semantic
from newsloom.functions.text import let, words
from newsloom.hooks import hook
from newsloom.operators import curation, entities, ingest
from newsloom.operators import retrieval as op
from newsloom.operators.entities import _cut as written

from .registry import query
from .retrieval import COS, TOKENS, asked_of
from .text import LOWER_SQL, QUOTES_SQL, TITLE

SPACE = r"[\s\x0B\x85\p{Z}]+"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(translate({LOWER_SQL.format(x)}, '{QUOTES_SQL}', ''), '{SPACE}', ' ', 'g'))"


def tri_sql(x: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda z: z <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def like_sql(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


FILLERS_SQL = ", ".join(f"'{w}'" for w in qf.FILLERS)
RUNS_SQL = "list_filter(list_distinct(list_concat({})), lambda p: length(p) >= 5 AND len(list_filter(string_split(p, ' '), lambda v: v NOT IN ({}))) > 0)".format(
    ", ".join(f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))" for n in (2, 3, 4)), FILLERS_SQL
)
ENTITIES_SQL = f"list_distinct(list_filter(regexp_extract_all(translate(lower(replace(text, 'İ', 'i')), '''’‘`´', '     '), '[\\p{{L}}0-9][\\p{{L}}0-9-]*'), lambda t: length(t) >= 3 AND t NOT IN ({FILLERS_SQL})))"
#: From ``asked`` (query_id, entity) and ``men`` (entity, article_id) to ``z`` (query_id, article_id, mode), at most 30 for each query.
NAMED_SQL = """h AS (SELECT DISTINCT query_id, entity, article_id FROM asked JOIN men USING (entity)), df AS (SELECT query_id, entity, count(*) AS df, count(*) < 30 AS rare FROM h GROUP BY ALL),
    d AS (SELECT *, count(*) FILTER (WHERE rare) OVER (PARTITION BY query_id) AS n_rare, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY df, entity) AS o FROM df),
    p AS (SELECT query_id, article_id, n_rare, n, count(*) FILTER (WHERE rare) AS rh, count(*) AS here, bool_or(o = 1) AS rarest FROM h JOIN d USING (query_id, entity) GROUP BY ALL),
    x AS (SELECT *, n_rare >= 2 AND rh = n_rare AS every, n_rare = 0 AND n >= 2 AND here = n AS common FROM p), y AS (SELECT *, bool_or(every) OVER (PARTITION BY query_id) AS any_every, count(*) FILTER (WHERE common) OVER (PARTITION BY query_id) AS nc FROM x),
    z AS (SELECT query_id, article_id, CASE WHEN every THEN 'multi_and' WHEN n_rare >= 2 AND NOT any_every AND rarest THEN 'single_rare' WHEN n_rare = 1 AND rh = 1 THEN 'single_rare' WHEN common AND nc < 30 THEN 'multi_and_common' END AS mode
      FROM y QUALIFY mode IS NOT NULL AND count(mode) OVER (PARTITION BY query_id ORDER BY article_id ROWS UNBOUNDED PRECEDING) <= 30)"""
#: From ``m`` (query_id, id, n, score, phrase, grams) to the boosted sparse part.
SPARSE_PART = """s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phrase DESC, grams DESC, score DESC, id) AS rank FROM m QUALIFY rank <= 30),
    sp AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) + CASE WHEN phrase THEN CASE WHEN query_id IN (SELECT query_id FROM named WHERE mode LIKE 'multi%') THEN 0.03::DOUBLE ELSE 0.05::DOUBLE END ELSE 0 END + least(grams * 0.025::DOUBLE, 0.10::DOUBLE) AS part
      FROM s WHERE phrase OR grams > 0 OR score >= greatest(0.10, CASE WHEN n <= 3 THEN 0.05 WHEN n <= 6 THEN 0.10 ELSE 0.15 END))"""
NAMED_PART = "nm AS (SELECT query_id, id, 1.0::DOUBLE / (CASE WHEN mode = 'single_rare' THEN 15 ELSE 5 END + row_number() OVER (PARTITION BY query_id ORDER BY article_id, id)) AS part FROM named)"

CHUNKS_SQL = f"""docs AS (SELECT doc_id AS id, doc_id // 5 AS article_id, doc_id % 5 AS chunk_index, coalesce(text, '') AS text, source || ' ' || lang AS title, doc_id % 100 AS seen,
      list_distinct(list_filter({TOKENS}, lambda w: length(w) >= 10)) AS kw, lower(string_split(coalesce(text, ''), chr(10))[1]) AS line, vec_id IS NOT NULL AS has_vec, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""


@query(f"""WITH {CHUNKS_SQL}, q AS (SELECT item_id AS query_id, text, {norm_sql("text")} AS q FROM benchmark WHERE item_id % 20 = 0),
    qw AS (SELECT *, list_filter(string_split(q, ' '), lambda v: v <> '') AS w FROM q WHERE q <> ''), qr AS (SELECT *, {RUNS_SQL} AS runs, {tri_sql("q")} AS qt FROM qw),
    terms AS (SELECT DISTINCT query_id, unnest(list_filter(list_transform(w, lambda v: regexp_replace(v, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda v: length(v) >= 2)) AS term FROM qw), nt AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY 1),
    post AS (SELECT id, unnest({TOKENS}) AS term FROM docs), tf AS (SELECT term, id, count(*) AS tf FROM post GROUP BY ALL),
    hit AS (SELECT query_id, id, sum(0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0 / (j * j))) / 1.64493406685) / any_value(n_terms) AS r FROM tf JOIN terms USING (term) JOIN nt USING (query_id) GROUP BY ALL),
    nd AS (SELECT id, {norm_sql("text")} AS t1, {norm_sql("title")} AS t2 FROM docs),
    m AS (SELECT query_id, id, length(q) AS n, round(greatest(r, {like_sql(tri_sql("t2"), "qt")}), 6) AS score, contains(t1, q) OR contains(t2, q) AS phrase, len(list_filter(runs, lambda g: contains(t1, g) OR contains(t2, g))) AS grams FROM hit JOIN qr USING (query_id) JOIN nd USING (id)),
    qv AS (SELECT query_id, embedding FROM qw JOIN embeddings ON vec_id = query_id), de AS (SELECT query_id, e.id, round({COS}, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({COS}, 6) DESC, e.id) AS rank FROM docs e, qv q WHERE has_vec QUALIFY rank <= 30),
    firsts AS (SELECT article_id, arg_min(id, chunk_index) AS id FROM docs WHERE has_vec GROUP BY 1),
    sn AS (SELECT query_id, e.vec_id AS article_id FROM embeddings e, qv q WHERE e.vec_id IN (SELECT article_id FROM docs) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round({COS}, 6) DESC, e.vec_id) <= 30),
    su AS (SELECT query_id, f.id, 1.0::DOUBLE / (80 + row_number() OVER (PARTITION BY query_id ORDER BY article_id)) AS part FROM sn JOIN firsts f USING (article_id)),
    asked AS (SELECT DISTINCT query_id, unnest({ENTITIES_SQL}) AS entity FROM qw), men AS (SELECT DISTINCT term AS entity, id // 5 AS article_id FROM tf), {NAMED_SQL}, named AS (SELECT query_id, id, article_id, mode FROM z JOIN firsts USING (article_id)), {NAMED_PART}, {SPARSE_PART},
    kq AS (SELECT query_id, q, list_transform(list_filter(w, lambda v: length(v) >= 3), lambda v: trim(v, '.,!?;:')) AS ws FROM qw),
    kj AS (SELECT query_id, id, contains(line, q) AS qm, len(list_filter(list_distinct(ws), lambda v: contains(line, v))) AS ov, len(list_filter(kw, lambda k: list_contains(ws, k))) AS km FROM docs, kq WHERE list_has_any(kw, ws) OR list_has_any(list_filter(string_split_regex(line, '{SPACE}'), lambda v: v <> ''), ws)),
    ke AS (SELECT query_id, id, 1.0::DOUBLE / (CASE WHEN qm THEN 15 WHEN ov >= 3 THEN 18 WHEN km >= 2 THEN 20 WHEN ov >= 2 THEN 22 ELSE 30 END + row_number() OVER w) AS part FROM kj WINDOW w AS (PARTITION BY query_id ORDER BY qm DESC, ov DESC, km DESC, id) QUALIFY row_number() OVER w <= 30),
    cr AS (SELECT DISTINCT query_id, unnest(list_filter(w, lambda v: length(v) >= 7)[1:1]) AS entity FROM qw), held AS (SELECT query_id, entity, id, seen FROM cr, docs WHERE contains(lower(title || ' ' || text), entity) OR len(list_filter(kw, lambda k: contains(k, entity))) > 0),
    re AS (SELECT query_id, id, 1.0::DOUBLE / (12 + row_number() OVER w) AS part FROM (SELECT query_id, id, max(seen) AS seen, count(DISTINCT entity) AS got FROM held GROUP BY ALL) JOIN (SELECT query_id, count(*) AS need FROM cr GROUP BY 1) USING (query_id) WHERE got = need WINDOW w AS (PARTITION BY query_id ORDER BY seen DESC, id) QUALIFY row_number() OVER w <= 30),
    parts AS (SELECT query_id, id, part FROM sp UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM de WHERE score >= 0.5 UNION ALL SELECT * FROM su UNION ALL SELECT * FROM nm UNION ALL SELECT * FROM ke UNION ALL SELECT * FROM re),
    fu AS (SELECT query_id, id, round(sum(part), 9) AS rrf FROM parts GROUP BY ALL), fl AS (SELECT *, (query_id, id) IN (SELECT (query_id, id) FROM held) AS ok FROM fu), kp AS (SELECT * FROM fl QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY query_id)),
    best AS (SELECT query_id, id, id // 5 AS article_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM kp QUALIFY rank <= 10),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, article_id) AS i FROM (SELECT query_id, article_id, min(rank) AS best FROM best GROUP BY ALL)),
    sb AS (SELECT b.query_id, docs.id, b.article_id, i, row_number() OVER (PARTITION BY b.query_id, b.article_id ORDER BY docs.chunk_index) AS j FROM b JOIN docs USING (article_id) WHERE i <= 3 AND NOT EXISTS (SELECT 1 FROM best r WHERE r.query_id = b.query_id AND r.id = docs.id)),
    u AS (SELECT query_id, id, article_id, 0 AS part, rank::BIGINT AS place, rank, rrf FROM best UNION ALL SELECT query_id, id, article_id, 1, i * 1000 + j, NULL, NULL FROM sb WHERE j <= 5)
    SELECT query_id, id, article_id, rank, rrf, row_number() OVER (PARTITION BY query_id ORDER BY part, place, id) AS position FROM u QUALIFY position <= 20""")
def r1_chunk_search(spark, sf_dir):
    """Documents as chunks, five to an article; asked with every benchmark passage whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    d = spread(table(spark, sf_dir, "documents"))
    text, article = F.coalesce("text", F.lit("")), F.floor(F.col("doc_id") / 5)
    q = asked_of(table(spark, sf_dir, "benchmark"), "item_id").select(F.col("item_id").alias("query_id"), "text")
    q = q.join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), "query_id", "left")
    q = q.withColumn("critical", F.slice(F.filter(words(F.lower("text")), lambda w: F.length(w) >= 7), 1, 1))
    # each text is cut into words once, for its keywords and for the words asked for, and stays apart from its vector
    wanted = op.searched(q)
    few = op.few_terms(wanted)
    cut = lambda w: F.struct(F.array_distinct(F.filter(w, lambda x: F.length(x) >= 10)).alias("keywords"), F.filter(w, lambda x: x.isin(*few or ())).alias("asked"))
    parsed = d.select(
        F.col("doc_id").alias("id"), article.alias("article_id"), (F.col("doc_id") % 5).alias("chunk_index"), text.alias("text"), F.concat_ws(" ", "source", "lang").alias("title"),
        let(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), cut).alias("w"), F.array(F.element_at(F.split(text, "\n"), 1)).alias("questions"), (F.col("doc_id") % 100).alias("published_at"),
    )
    chunks = written(parsed.select("*", "w.keywords", "w.asked").drop("w"))
    index = written(op.postings(chunks.select("id", "text"), terms=wanted) if few is None else op.postings(chunks.select("id", "asked"), "asked"))
    summaries = e.select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("vec")).join(d.select(article.alias("article_id")).distinct(), "article_id", "left_semi")
    named = index.select(F.col("term").alias("entity"), F.floor(F.col("id") / 5).alias("article_id"))
    found = op.chunk_search(q, chunks, summaries, named, vecs=e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), index=index)
    return found.select("query_id", "id", "article_id", "rank", "rrf", "position")


IN_TURKEY, DAILY = "country = 'TR'", "level = 'daily'"


def _cards_sql(only: str) -> str:
    fields = ("t1", "t2", "t3")
    return f"""cards AS (SELECT page_id AS id, page_id AS article_id, regexp_extract(html, '{TITLE}', 1) AS title, regexp_replace(html, '<[^>]*>', ' ', 'g') AS summary, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS canonical_title,
      ['daily', 'weekly', 'monthly'][page_id % 3 + 1] AS level, CASE WHEN page_id % 2 = 0 THEN 'TR' ELSE 'DE' END AS country, embedding, vec_id IS NOT NULL AS has_vec FROM pages LEFT JOIN embeddings ON vec_id = page_id),
    q AS (SELECT id AS query_id, title AS text, {norm_sql("title")} AS q, embedding, has_vec FROM cards WHERE id % 20 = 0), qw AS (SELECT *, list_filter(string_split(q, ' '), lambda v: v <> '') AS w FROM q WHERE q <> ''), qr AS (SELECT *, {RUNS_SQL} AS runs, {tri_sql("q")} AS qt FROM qw),
    live AS (SELECT *, {norm_sql("title")} AS t1, {norm_sql("substr(summary, 1, 500)")} AS t2, {norm_sql("canonical_title")} AS t3 FROM cards WHERE id % 7 <> 0 AND {only}), lt AS (SELECT *, {", ".join(f"{tri_sql(f)} AS g{f}" for f in fields)} FROM live),
    m AS (SELECT query_id, id, length(q) AS n, round(greatest({", ".join(like_sql(f"g{f}", "qt") for f in fields)}), 6) AS score, {" OR ".join(f"contains({f}, q)" for f in fields)} AS phrase, len(list_filter(runs, lambda g: {" OR ".join(f"contains({f}, g)" for f in fields)})) AS grams
      FROM qr, lt WHERE score >= 0.3 OR phrase OR grams > 0),
    de AS (SELECT query_id, e.id, round({COS}, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({COS}, 6) DESC, e.id) AS rank FROM live e, qw q WHERE e.has_vec AND q.has_vec QUALIFY rank <= 30),
    asked AS (SELECT DISTINCT query_id, unnest({ENTITIES_SQL}) AS entity FROM qw), men AS (SELECT DISTINCT id AS article_id, unnest(list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda v: v <> '')) AS entity FROM cards),
    {NAMED_SQL}, named AS (SELECT query_id, id, article_id, mode FROM z JOIN live USING (article_id)), {NAMED_PART}, {SPARSE_PART},
    parts AS (SELECT query_id, id, part FROM sp UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM de WHERE score >= 0.5 UNION ALL SELECT * FROM nm), fu AS (SELECT query_id, id, round(sum(part), 9) AS rrf FROM parts GROUP BY ALL),
    found AS (SELECT query_id, id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM fu QUALIFY rank <= 10)"""


def _cards(spark, sf_dir):
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    cards = p.select(
        k.alias("id"), k.alias("article_id"), F.regexp_extract("html", TITLE, 1).alias("title"), F.regexp_replace("html", "<[^>]*>", " ").alias("summary"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("canonical_title"),
        F.when(k % 7 == 0, "archived").otherwise("active").alias("status"), F.element_at(F.array(*map(F.lit, op.LEVELS)), (k % 3 + 1).cast("int")).alias("level"), F.when(k % 2 == 0, "TR").otherwise("DE").alias("country"), F.lit("2024-01-01").cast("timestamp").alias("first_seen_at"),
    )
    return cards.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "id", "left")


def _card_search(spark, sf_dir, **only):
    cards = _cards(spark, sf_dir)
    asked = asked_of(cards, "id").select(F.col("id").alias("query_id"), F.col("title").alias("text"), F.col("vec").alias("qvec"))
    named = op.postings(cards.select("id", "title"), "title").select(F.col("term").alias("entity"), F.col("id").alias("article_id"))
    return op.card_search(asked, cards, named, **only), cards


@query(f"WITH {_cards_sql(IN_TURKEY)} SELECT query_id, id, rank, rrf FROM found")
def r2_card_search(spark, sf_dir):
    """Pages as cards; asked with the title of every page whose id is divisible by 20, within one country."""
    found, _ = _card_search(spark, sf_dir, country="tr", seen=("2023-12-01", "2024-02-01"))
    return found.select("query_id", "id", "rank", "rrf")


@query(f"WITH {_cards_sql(DAILY)} SELECT query_id, rank, id, title, substr(summary, 1, 250) AS summary, country FROM found JOIN cards USING (id)")
def r28_public_search(spark, sf_dir):
    """Daily cards as visitors see them."""
    return op.public_results(*_card_search(spark, sf_dir, levels=("daily",)))


@query()
def t12_semantic_chunks(spark, sf_dir):
    """No SQL for the fold; ``test_semantic_chunks`` holds it against a plain version."""
    embed = hook("embed")
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.inline(semantic.semantic_chunk(F.coalesce("text", F.lit("")), lambda s: F.transform(s, lambda x: embed(x)), F.col("source"), F.col("lang"))))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Ada ' || p_brand || ' önünde konuşan' WHEN 1 THEN 'Ada ' || p_brand || ', sahada kim var' WHEN 2 THEN 'Konuşan Ada' WHEN 3 THEN 'Sahada bir kadın' ELSE 'Ada ' || p_brand || ' ve bir kişi' END AS caption FROM part""")
def t26_captions(spark, sf_dir):
    k, name = F.col("p_partkey") % 5, F.concat(F.lit("Ada "), "p_brand")
    said = F.when(k == 0, "bir adam önünde konuşan").when(k == 1, "Sahada kim var").when(k == 2, "Konuşan Ada").when(k == 3, "Sahada bir kadın").otherwise("bir kadın ve bir kişi")
    alt = F.when(k == 3, "Başka biri").when(k == 4, F.concat(F.lit("Haberde "), name)).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", c.enrich_caption(said, F.array(F.lit("kürsü"), name), alt).alias("caption"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN 'özgür özel' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE lower(c_mktsegment) || 'nin sultan' END AS entity FROM customer""")
def t34_canonical_entities(spark, sf_dir):
    k, low = F.col("c_custkey") % 5, F.lower("c_mktsegment")
    said = F.concat(F.lit("Özgür özelle "), low, F.lit("nin sultanları, 15 gol"))
    entity = F.when(k == 0, F.concat(low, F.lit("nin"))).when(k == 1, "özgür özel").when(k == 2, "özgür öz").when(k == 3, "filenin sultanları").otherwise(F.concat(low, F.lit("nin sultanları")))
    return table(spark, sf_dir, "customer").select("c_custkey", qf.canonical_entity(entity, qf.query_words(said)).alias("entity"))


KNOWN_SQL = "k AS (SELECT DISTINCT p_brand, p_type, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 5 AS b FROM part)"


@query(f"""WITH {MENTIONS_SQL}, {KNOWN_SQL}, tried AS (SELECT DISTINCT lower(p_brand) || ' ' || lower(p_type) AS norm FROM part WHERE p_size = 50),
    c AS (SELECT lower(entity_norm) || ' ' || lower(entity_type) AS norm, CASE WHEN entity_type < 'M' THEN 'event' ELSE 'org' END AS type, count(DISTINCT article_id) AS freq FROM mentions GROUP BY ALL HAVING freq >= 3),
    e AS (SELECT c.*, p_brand, p_type, b FROM c JOIN k ON lower(p_brand) || ' ' || lower(p_type) = norm WHERE norm NOT IN (SELECT norm FROM tried) ORDER BY freq DESC, norm, type LIMIT 150)
    SELECT norm, type, freq, CASE b WHEN 0 THEN 'no_match' WHEN 1 THEN 'llm_reject' WHEN 2 THEN 'type_mismatch' ELSE 'resolved' END AS status, CASE WHEN b = 3 AND type = 'org' THEN '2024 ' || p_brand || ' ' || p_type WHEN b >= 3 THEN p_brand || ' ' || p_type END AS canonical,
      CASE WHEN b = 3 AND type = 'event' THEN '2024 ' || p_brand || ' ' || p_type WHEN b >= 3 THEN '' END AS aliases FROM e""")
def e7_enrichment(spark, sf_dir):
    """Names not tried lately against a table of what a lookup would find."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size")
    norm = lambda a, b: F.concat_ws(" ", F.lower(a), F.lower(b))
    kind = lambda t: F.when(F.col(t) < "M", "event").otherwise("org")
    m = mentions(spark, sf_dir).select(norm("entity_norm", "entity_type").alias("norm"), kind("entity_type").alias("type"), F.concat_ws(" ", "entity_norm", "entity_type").alias("text"), "article_id")
    tried = p.where("p_size >= 49").select(norm("p_brand", "p_type").alias("norm"), kind("p_type").alias("type"), F.when(F.col("p_size") == 50, "1998-07-20").otherwise("1998-06-01").alias("attempted_at"))
    b, whole = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 5, F.concat_ws(" ", "p_brand", "p_type")
    found = p.select(
        norm("p_brand", "p_type").alias("norm"), kind("p_type").alias("type"), F.when(b == 1, F.col("p_type")).when(b == 3, F.concat(F.lit("2024 "), whole)).when(b > 1, whole).alias("title"),
        F.when(b == 2, F.array(F.lit("Q5"))).otherwise(F.array(F.lit("Q43229"))).alias("classes"), F.array().cast("array<string>").alias("aliases"),
    ).distinct()
    e = entities.enrich(entities.enrichment_candidates(m, tried, "1998-08-01"), found)
    return e.select("norm", "type", "freq", "status", "canonical", F.array_join("aliases", "|").alias("aliases"))


PROFILES = (("example.com", 1, "article"), ("m.example.com", 0, "main"), ("example.org", 2, "body"), ("ample.net", 3, "p"))


@query("""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages), f(domain, priority, selector) AS (VALUES ('example.com', 1, 'article'), ('m.example.com', 0, 'main'), ('example.org', 2, 'body'), ('ample.net', 3, 'p'))
    SELECT page_id, domain, selector FROM p LEFT JOIN f ON host = domain OR ends_with(host, '.' || domain) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY priority) = 1""")
def h10_site_profiles(spark, sf_dir):
    profiles = spark.createDataFrame(list(PROFILES), "domain string, priority int, selector string")
    return ingest.site_profiles(table(spark, sf_dir, "pages").select("page_id", "url"), profiles).select("page_id", "domain", "selector")


@query("""WITH c AS (SELECT CAST(floor(value) AS BIGINT) AS ms, ts FROM events WHERE event_type = 'purchase'), n AS (SELECT count(*) AS n FROM c), o AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS i FROM c)
    SELECT n, round((SELECT avg(ms) FROM c), 2) AS mean, (SELECT ms FROM o WHERE i = least(floor(n * 0.5), n - 1))::DOUBLE AS p50, (SELECT ms FROM o WHERE i = least(floor(n * 0.95), n - 1))::DOUBLE AS p95, (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) FROM c) AS last FROM n""")
def v3_latency(spark, sf_dir):
    calls = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.floor("value").alias("ms"), F.col("ts").cast("timestamp").alias("ts"))
    return curation.latency_stats(calls, "ms", "ts").withColumn("last", F.unix_seconds("last"))
