"""Retrieval queries (R*, V8) over a batch: vectors of ``embeddings``, words of ``documents``, questions of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import MENTIONS_SQL, mentions, spread, table
from newsloom.functions import vector
from newsloom.operators import curation, retrieval as op
from newsloom.operators import codes, vectors

from .registry import query
from .relational import RUNS, two_runs

POOL = 30
#: The query set: rows whose id is divisible by 20, each against all rows.
ASKED_SQL = "{} % 20 = 0"


def asked_of(df, key):
    return df.where(F.col(key) % 20 == 0)


COS = "(1 + list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2"
DENSE = f"""dense AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({COS}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 6) DESC, e.vec_id) AS rank
    FROM embeddings e, embeddings q WHERE {ASKED_SQL.format('q.vec_id')} QUALIFY rank <= {POOL})"""
TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
SPARSE = f"""terms AS (SELECT DISTINCT item_id AS query_id, unnest(list_distinct(list_filter(list_transform(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda w: w <> ''))) AS term FROM benchmark WHERE {ASKED_SQL.format('item_id')}),
    post AS (SELECT doc_id AS id, unnest({TOKENS}) AS term FROM documents), tf AS (SELECT term, id, count(*) AS tf FROM post GROUP BY ALL), n AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY 1),
    hit AS (SELECT query_id, id, count(*) AS grams, sum(0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0 / (j * j))) / 1.64493406685) AS r FROM tf JOIN terms USING (term) GROUP BY ALL),
    sparse AS (SELECT query_id, id, grams, round(r / n_terms, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY grams DESC, round(r / n_terms, 9) DESC, id) AS rank FROM hit JOIN n USING (query_id) QUALIFY rank <= {POOL})"""


def dense(spark, sf_dir, pool=POOL):
    e = table(spark, sf_dir, "embeddings")
    q = asked_of(e, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return op.dense(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), pool)


def sparse(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    b = asked_of(table(spark, sf_dir, "benchmark"), "item_id").select(F.col("item_id").alias("query_id"), "text")
    terms = op.query_terms(b)
    return op.sparse(terms, op.postings(docs, terms=terms), POOL)


@query(f"WITH {DENSE} SELECT query_id, id, rank, score FROM dense WHERE score >= 0.5")
def r4_dense(spark, sf_dir):
    return dense(spark, sf_dir).where("score >= 0.5").select("query_id", "id", "rank", "score")


def _asked_and_base(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return asked_of(e, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query(f"WITH {DENSE} SELECT query_id, id, rank, score FROM dense")
def r4_all_lists(spark, sf_dir):
    """The inverted-file index with every list read: the rows of the exact search."""
    q, base = _asked_and_base(spark, sf_dir)
    index = vectors.build(base)
    return vectors.indexed(q, index, POOL, len(index.centroids)).select("query_id", "id", "rank", "score")


@query()
def r4_index_recall(spark, sf_dir):
    """The share of each query's ten nearest rows that the index finds with the number of lists that a sample asks for. No SQL: which rows
    a list holds is a matter of k-means; ``test_recall_of_the_index`` holds it against the exact search."""
    q, base = _asked_and_base(spark, sf_dir)
    index = vectors.build(base)
    probes = vectors.probes_for(q, base, index, 10)
    found = vectors.indexed(q, index, 10, probes)
    return vectors.recall(vectors.dense(q, base, 10), found).withColumn("probes", F.lit(probes)).withColumn("lists", F.lit(len(index.centroids)))


@query(f"WITH {SPARSE} SELECT query_id, id, rank, grams, score FROM sparse")
def r3_sparse(spark, sf_dir):
    return sparse(spark, sf_dir).select("query_id", "id", "rank", "grams", "score")


@query(f"""WITH {SPARSE}, {DENSE}, parts AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) + least(grams * 0.025::DOUBLE, 0.10::DOUBLE) AS part FROM sparse UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM dense WHERE score >= 0.5),
    fused AS (SELECT query_id, id, round(sum(part), 9) AS rrf FROM parts GROUP BY ALL)
    SELECT query_id, id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM fused QUALIFY rank <= 10""")
def r1_hybrid(spark, sf_dir):
    """Sparse and dense streams fused, with the boost for matched grams."""
    s = sparse(spark, sf_dir).withColumn("boost", F.least(F.col("grams") * op.GRAM_BOOST, F.lit(op.GRAM_BOOST_MAX)))
    f = op.fuse((s, op.STREAM_K["sparse"]), (dense(spark, sf_dir).where("score >= 0.5"), op.STREAM_K["dense"])).withColumn("rrf", F.round("rrf", 9))
    return op.top(f, 10, F.desc("rrf")).select("query_id", "id", "rrf", "rank")


@query(f"""WITH {DENSE}, r AS (SELECT *, id // 5 AS article_id FROM dense WHERE rank <= 10), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, article_id) AS i FROM (SELECT query_id, article_id, min(rank) AS best FROM r GROUP BY ALL)),
    s AS (SELECT b.query_id, e.vec_id AS id, b.article_id, i, row_number() OVER (PARTITION BY b.query_id, b.article_id ORDER BY e.vec_id % 5) AS j FROM b JOIN embeddings e ON e.vec_id // 5 = b.article_id
      WHERE i <= 3 AND NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = b.query_id AND r.id = e.vec_id)),
    u AS (SELECT query_id, id, article_id, 0 AS part, rank::BIGINT AS place FROM r UNION ALL SELECT query_id, id, article_id, 1, i * 1000 + j FROM s WHERE j <= 5)
    SELECT query_id, id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY part, place, id) AS position FROM u QUALIFY position <= 20""")
def r10_parent_expansion(spark, sf_dir):
    r = dense(spark, sf_dir, 10).withColumn("article_id", F.floor(F.col("id") / 5))
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 5).alias("article_id"), (F.col("vec_id") % 5).alias("chunk_index"))
    return op.expand_parents(r.select("query_id", "id", "article_id", "rank"), chunks).select("query_id", "id", "article_id", "position")


@query(f"""WITH {DENSE}, r AS (SELECT *, id // 5 AS article_id FROM dense), f AS (SELECT *, min(rank) OVER (PARTITION BY query_id, article_id) AS first FROM r)
    SELECT query_id, id, article_id, dense_rank() OVER (PARTITION BY query_id ORDER BY first, article_id) AS citation FROM f QUALIFY citation <= 8""")
def r19_collapse(spark, sf_dir):
    r = dense(spark, sf_dir).withColumn("article_id", F.floor(F.col("id") / 5))
    return op.collapse(r, 8).select("query_id", "id", "article_id", "citation")


@query(f"""WITH b AS (SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 1)) ELSE 0 END))::BIGINT AS lo, list_sum(list_transform(range(33, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 33)) ELSE 0 END))::BIGINT AS hi FROM embeddings)
    SELECT q.vec_id AS query_id, e.vec_id AS id, (bit_count(xor(e.lo, q.lo)) + bit_count(xor(e.hi, q.hi)))::INTEGER AS distance FROM b e, b q WHERE {ASKED_SQL.format('q.vec_id')}
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, e.vec_id) <= 10""")
def r12_binary_search(spark, sf_dir):
    b = table(spark, sf_dir, "embeddings").select("vec_id", vector.sign_bits(F.col("embedding")).alias("bits"))
    q = asked_of(b, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("bits").alias("qbits"))
    return codes.nearest_codes(q, b.select(F.col("vec_id").alias("id"), "bits"), 10, 64).select("query_id", "id", "distance")


@query(f"""WITH {MENTIONS_SQL}, asked AS (SELECT DISTINCT q.p_partkey AS query_id, p.p_brand || ' ' || p.p_type AS entity FROM part q JOIN part p ON p.p_partkey = q.p_partkey OR p.p_partkey = q.p_partkey + 1 WHERE {ASKED_SQL.format('q.p_partkey')}),
    h AS (SELECT DISTINCT query_id, entity, article_id FROM asked JOIN mentions ON entity_norm || ' ' || entity_type = entity), df AS (SELECT query_id, entity, count(*) AS df, count(*) < 30 AS rare FROM h GROUP BY ALL),
    d AS (SELECT *, count(*) FILTER (WHERE rare) OVER (PARTITION BY query_id) AS n_rare, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY df, entity) AS o FROM df),
    p AS (SELECT query_id, article_id, n_rare, n, count(*) FILTER (WHERE rare) AS rh, count(*) AS here, bool_or(o = 1) AS rarest FROM h JOIN d USING (query_id, entity) GROUP BY ALL),
    x AS (SELECT *, n_rare >= 2 AND rh = n_rare AS every, n_rare = 0 AND n >= 2 AND here = n AS common FROM p), y AS (SELECT *, bool_or(every) OVER (PARTITION BY query_id) AS any_every, count(*) FILTER (WHERE common) OVER (PARTITION BY query_id) AS nc FROM x),
    z AS (SELECT query_id, article_id, CASE WHEN every THEN 'multi_and' WHEN n_rare >= 2 AND NOT any_every AND rarest THEN 'single_rare' WHEN n_rare = 1 AND rh = 1 THEN 'single_rare' WHEN common AND nc < 30 THEN 'multi_and_common' END AS mode FROM y)
    SELECT query_id, mode, article_id FROM z WHERE mode IS NOT NULL""")
def r6_ner_stream(spark, sf_dir):
    """A query asks for the kinds of a part and of the one after it."""
    kind = F.concat_ws(" ", "p_brand", "p_type").alias("entity")
    p, last = table(spark, sf_dir, "part"), F.col("p_partkey") - F.col("p_partkey") % 20
    queries = asked_of(p, "p_partkey").select(F.col("p_partkey").alias("query_id"))
    asked = p.where("p_partkey % 20 in (0, 1)").select(last.alias("query_id"), kind).join(queries, "query_id", "left_semi").distinct()
    m = mentions(spark, sf_dir).select(F.concat_ws(" ", "entity_norm", "entity_type").alias("entity"), "article_id")
    return op.ner_targets(asked, m)


@query(f"""WITH {DENSE}, s AS (SELECT query_id, avg(score) FILTER (WHERE rank <= 3) AS top3, least(1.0, count(*) / 30.0) AS coverage, least(1.0, count(DISTINCT id % 5) / 5.0) AS sources, avg(pow(0.5, id / 240.0)) AS freshness FROM dense GROUP BY 1),
    c AS (SELECT *, (top3 * 0.40 + coverage * 0.20 + sources * 0.15 + freshness * 0.15) / 0.90 AS confidence FROM s)
    SELECT query_id, round(confidence, 5) AS confidence, CASE WHEN confidence >= 0.70 THEN 'answer' WHEN confidence >= 0.40 THEN 'hedge' ELSE 'decline' END AS route,
      array_to_string(list_filter([CASE WHEN top3 < 0.4 THEN 'top3' END, CASE WHEN coverage < 0.4 THEN 'coverage' END, CASE WHEN sources < 0.4 THEN 'sources' END, CASE WHEN freshness < 0.4 THEN 'freshness' END], lambda x: x IS NOT NULL), ',') AS missing FROM c""")
def r17_confidence(spark, sf_dir):
    from newsloom.functions.trend import freshness

    s = dense(spark, sf_dir).groupBy("query_id").agg(
        F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("top3"), F.least(F.lit(1.0), F.count(F.lit(1)) / 30.0).alias("coverage"), F.least(F.lit(1.0), F.countDistinct(F.col("id") % 5) / 5.0).alias("sources"),
        F.avg(freshness(F.col("id") / 10.0)).alias("freshness"), F.lit(None).cast("double").alias("agreement"),
    )
    return op.confidence(s).withColumn("confidence", F.round("confidence", 5))


def _merge_sql(part: str, rerank: bool = False) -> str:
    rank = "row_number() OVER (PARTITION BY list ORDER BY rank, id)" if rerank else "rank"
    return f"""WITH {RUNS}, o AS (SELECT list, id, min(rank) AS rank FROM u GROUP BY ALL), k AS (SELECT id, 1.0::DOUBLE / (60 + {rank}) AS p FROM o), m AS (SELECT id, {part}(p) AS score FROM k GROUP BY 1)
    SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS rank FROM m"""


def _merged(spark, sf_dir, **how):
    return op.merge_rrf(two_runs(spark, sf_dir), **how).select("id", F.round("score", 6).alias("score"), "rank")


@query(_merge_sql("sum"))
def r26_merge_rrf_sum(spark, sf_dir):
    return _merged(spark, sf_dir, how="sum")


@query(_merge_sql("max"))
def r26_merge_rrf_max(spark, sf_dir):
    return _merged(spark, sf_dir, how="max")


@query(_merge_sql("sum", True))
def r26_merge_rank_rrf(spark, sf_dir):
    return _merged(spark, sf_dir, how="sum", rerank=True)


@query(f"""WITH {DENSE}, q AS (SELECT q.vec_id AS query_id, e.vec_id AS id, 1 AS rel FROM embeddings e JOIN embeddings q ON e.label = q.label AND {ASKED_SQL.format('q.vec_id')}),
    h AS (SELECT query_id, rank, rel, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS found FROM dense JOIN q USING (query_id, id) WHERE rank <= 10),
    g AS (SELECT query_id, sum((pow(2, rel) - 1) / log2(rank + 1)) AS dcg, count(*) AS n, sum(found::DOUBLE / rank) AS ap, min(rank) AS first FROM h GROUP BY 1),
    i AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN i <= 10 THEN 1 / log2(i + 1) END) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS i FROM q) GROUP BY 1)
    SELECT query_id, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(n / 10.0::DOUBLE, 0), 6) AS precision, round(coalesce(ap / least(relevant, 10), 0), 6) AS average_precision, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank, round(coalesce(n::DOUBLE / relevant, 0), 6) AS recall
    FROM i LEFT JOIN g USING (query_id)""")
def v8_ranking_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = asked_of(e, "vec_id").select(F.col("vec_id").alias("query_id"), "label")
    qrels = e.join(q, "label").select("query_id", F.col("vec_id").alias("id"), F.lit(1).alias("rel"))
    m = curation.ranking_metrics(dense(spark, sf_dir), qrels)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in m.columns[1:]))


@query("SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 5) AS cos FROM embeddings e JOIN embeddings p ON p.vec_id = e.vec_id - 1")
def r23_relatedness(spark, sf_dir):
    """Each message's vector against the one before it, met by key instead of a global order."""
    e = table(spark, sf_dir, "embeddings")
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("prev"))
    return e.join(before, "vec_id").select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("prev")), 5).alias("cos"))


@query(f"""WITH {DENSE} SELECT query_id, id, score, s_name AS source FROM dense JOIN supplier ON s_suppkey = id % 10 + 1 WHERE s_acctbal > 0""")
def r11_candidates(spark, sf_dir):
    """Candidates of one vector each with the source they come from; those of inactive sources drop out."""
    sources = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source"))
    d = dense(spark, sf_dir).withColumn("source_id", F.col("id") % 10 + 1)
    return d.join(sources, "source_id").select("query_id", "id", "score", "source")


@query("""WITH q AS (SELECT p_partkey AS query_id, p_brand, unnest(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda w: w <> ''))) AS entity FROM part),
    h AS (SELECT query_id, entity, bool_or(c.p_partkey <> query_id AND contains(lower(c.p_type || ' ' || c.p_name), entity)) AS hit FROM q JOIN part c USING (p_brand) GROUP BY ALL)
    SELECT query_id, round(count(*) FILTER (WHERE hit) / count(*)::DOUBLE, 3) AS coverage FROM h GROUP BY 1""")
def r21_entity_coverage(spark, sf_dir):
    """Every part's words, looked for in the other parts of its brand."""
    p = table(spark, sf_dir, "part")
    asked = p.select(F.col("p_partkey").alias("query_id"), F.col("p_brand").alias("group"), F.explode(F.split(F.lower("p_name"), " ")).alias("entity"))
    return op.entity_coverage(asked, p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("group"), F.concat_ws(" ", "p_type", "p_name").alias("text"))).select("query_id", "coverage")
