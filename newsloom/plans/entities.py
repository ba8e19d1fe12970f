"""Entity and cluster queries (E*, C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import MENTIONS_SQL, mentions, table
from newsloom.operators import clusters, entities as op

from .registry import query
from .relational import COOC, memberships


@query("""WITH e AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'dr. ' ELSE '' END || lower(n_name) AS norm, CASE WHEN s_suppkey % 2 = 0 THEN 'person' ELSE 'org' END AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    a AS (SELECT DISTINCT lower(n_name) AS alias, n_name AS canonical FROM nation)
    SELECT norm, type, coalesce(a.canonical, CASE WHEN type = 'person' THEN b.canonical END) AS canonical FROM e LEFT JOIN a ON a.alias = e.norm LEFT JOIN a b ON b.alias = regexp_replace(e.norm, '^dr\\. ', '')""")
def e3_resolve_canonical(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    e = s.select(F.concat(F.when(F.col("s_suppkey") % 3 == 0, "dr. ").otherwise(""), F.lower("n_name")).alias("norm"), F.when(F.col("s_suppkey") % 2 == 0, "person").otherwise("org").alias("type")).distinct()
    a = n.select(F.lower("n_name").alias("alias"), F.explode(F.array(F.lit("person"), F.lit("org"))).alias("type"), F.col("n_name").alias("canonical"))
    return op.resolve(e, a)


SUBSETS = """n AS (SELECT lower(p_name) AS norm, count(*) AS freq FROM part GROUP BY 1 UNION ALL SELECT DISTINCT lower(p_name) || ' of ' || lower(p_brand), 1 FROM part WHERE p_partkey % 7 = 0),
    f AS (SELECT norm, max(freq) AS freq FROM n GROUP BY 1), t AS (SELECT norm, list_sort(list_distinct(string_split(norm, ' '))) AS tok FROM f WHERE len(list_distinct(string_split(norm, ' '))) >= 2)"""


def _names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.groupBy(F.lower("p_name").alias("norm")).agg(F.count(F.lit(1)).alias("freq"))
    b = p.where("p_partkey % 7 = 0").select(F.concat(F.lower("p_name"), F.lit(" of "), F.lower("p_brand")).alias("norm"), F.lit(1).cast("long").alias("freq")).distinct()
    return a.union(b).groupBy("norm").agg(F.max("freq").alias("freq"))


EDGES = f"""{SUBSETS}, p AS (SELECT a.norm, b.norm AS up, len(a.tok) AS n, len(b.tok) AS m FROM t a JOIN t b ON a.norm <> b.norm AND list_has_all(b.tok, a.tok)),
    w AS (SELECT *, min(m) OVER (PARTITION BY norm) AS low FROM p WHERE m > n),
    e AS (SELECT norm, up FROM p WHERE m = n UNION ALL SELECT norm, up FROM (SELECT *, count(*) OVER (PARTITION BY norm) AS c FROM w WHERE m = low) WHERE c = 1)"""


@query(f"WITH {EDGES} SELECT norm, up FROM e")
def e4_subset_edges(spark, sf_dir):
    return op.subset_edges(_names(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT norm AS x, up AS y FROM e UNION SELECT up, norm FROM e), r AS (SELECT x AS node, x AS other FROM b UNION SELECT r.node, b.y FROM r JOIN b ON r.other = b.x),
    g AS (SELECT node, min(other) AS grp FROM r GROUP BY 1), k AS (SELECT node, grp, freq FROM g JOIN f ON f.norm = node)
    SELECT node AS norm, first_value(node) OVER (PARTITION BY grp ORDER BY freq DESC, length(node) DESC, node) AS canonical FROM k""")
def e4_subset_groups(spark, sf_dir):
    return op.subset_groups(_names(spark, sf_dir))


@query("""WITH r AS (SELECT lower(n_name) AS alias, 'seed' AS source, n_name AS canonical FROM nation UNION ALL SELECT lower(n_name), 'admin', n_name || ' (A)' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT lower(n_name), 'wikidata', n_name || ' (W)' FROM nation WHERE n_nationkey % 3 = 0)
    SELECT alias, source, canonical FROM r QUALIFY row_number() OVER (PARTITION BY alias ORDER BY list_position(['admin', 'wikidata', 'seed', 'token_subset'], source), canonical) = 1""")
def e5_authority(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    row = lambda df, src, mark: df.select(F.lower("n_name").alias("alias"), F.lit(src).alias("source"), F.concat("n_name", F.lit(mark)).alias("canonical"))
    return op.by_authority(row(n, "seed", "").union(row(n.where("n_nationkey % 2 = 0"), "admin", " (A)")).union(row(n.where("n_nationkey % 3 = 0"), "wikidata", " (W)")), ["alias"])


@query(f"""WITH {COOC}, o AS (SELECT c, count(*) AS occ FROM d GROUP BY 1), p AS (SELECT a.c AS a, b.c AS b, count(*) AS s FROM d a JOIN d b ON a.user_id = b.user_id AND a.c < b.c GROUP BY ALL),
    f AS (SELECT c, count(*) AS df FROM (SELECT a AS c FROM p UNION ALL SELECT b FROM p) GROUP BY 1), g AS (SELECT o.c, occ, coalesce(df, 0) AS df FROM o LEFT JOIN f ON f.c = o.c),
    e AS (SELECT a AS parent, b AS child, s FROM p WHERE s >= 3 UNION ALL SELECT b, a, s FROM p WHERE s >= 3)
    SELECT child, parent, round(s::DOUBLE / y.occ, 6) AS strength FROM e JOIN g x ON x.c = parent JOIN g y ON y.c = child
    WHERE s::DOUBLE / y.occ >= 0.05 AND s::DOUBLE / x.occ <= 0.9 AND x.df >= y.df AND x.occ >= y.occ QUALIFY row_number() OVER (PARTITION BY child ORDER BY s::DOUBLE / y.occ DESC, parent) = 1""")
def c13_parent_edges(spark, sf_dir):
    """The thresholds are eased: the mapping's memberships are near random."""
    return op.infer_parents(memberships(spark, sf_dir), 3, 0.05, 0.9, 1.0).withColumn("strength", F.round("strength", 6))


@query(f"""WITH {MENTIONS_SQL}, s AS (SELECT source_id AS cluster, entity_norm, entity_type, sum(mention_count)::BIGINT AS n FROM mentions WHERE entity_type LIKE 'PROMO%' OR entity_type LIKE 'ECONOMY%' OR entity_type LIKE '%BRASS%' GROUP BY ALL)
    SELECT cluster, entity_norm, entity_type, n FROM s QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, entity_norm, entity_type) = 1""")
def c6_dominant_entity(spark, sf_dir):
    m = mentions(spark, sf_dir).withColumnRenamed("source_id", "cluster")
    t = F.col("entity_type")
    kinds = tuple(r[0] for r in table(spark, sf_dir, "part").where(F.col("p_type").like("PROMO%") | F.col("p_type").like("ECONOMY%") | F.col("p_type").like("%BRASS%")).select("p_type").distinct().collect())  # types, some 150 at most
    return op.dominant(m.where(t.isin(*kinds)) if kinds else m.where(F.lit(False)), "cluster", kinds or ("",)).select("cluster", "entity_norm", "entity_type", "n")


ANCHORS = """c AS (SELECT n_regionkey AS grp, lower(n_name) AS norm, CASE n_nationkey % 3 WHEN 0 THEN 'place' WHEN 1 THEN 'org' ELSE 'misc' END AS type, n_nationkey % 6 AS df, n_nationkey % 4 AS sources, n_nationkey % 5 = 0 AS named, n_nationkey % 20 AS g FROM nation
    UNION ALL SELECT n_regionkey, lower(n_name) || ' union', 'org', 5, 3, false, 1 FROM nation WHERE n_nationkey % 2 = 0)"""


@query(f"""WITH {ANCHORS}, v AS (SELECT * FROM c WHERE type <> 'misc' AND df >= 2 AND sources >= 2), x AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.grp = v.grp AND o.norm <> v.norm AND contains(o.norm, v.norm)))
    SELECT grp AS "group", norm, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN named THEN 0 ELSE 1 END, CASE WHEN g >= 15 THEN 1 ELSE 0 END, df DESC, norm) AS rank FROM x WHERE NOT (g >= 15 AND type <> 'place')""")
def c7_anchors(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    a = n.select(F.col("n_regionkey").alias("group"), F.lower("n_name").alias("norm"), F.when(k % 3 == 0, "place").when(k % 3 == 1, "org").otherwise("misc").alias("type"), (k % 6).alias("df"), (k % 4).alias("sources"), (k % 5 == 0).alias("has_canonical"), (k % 20).alias("genericness"))
    b = n.where("n_nationkey % 2 = 0").select("n_regionkey", F.concat(F.lower("n_name"), F.lit(" union")), F.lit("org"), F.lit(5), F.lit(3), F.lit(False), F.lit(1))
    return op.rank_anchors(a.union(b)).select("group", "norm", "rank")


@query(f"""WITH {MENTIONS_SQL}, a AS (SELECT entity_norm, entity_type, count(DISTINCT article_id) AS df, count(DISTINCT source_id) AS sources FROM mentions WHERE entity_norm IN ('Brand#11', 'Brand#22', 'Brand#33') GROUP BY ALL) SELECT entity_norm, entity_type, df, sources FROM a""")
def c8_entity_df(spark, sf_dir):
    m = mentions(spark, sf_dir).where(F.col("entity_norm").isin("Brand#11", "Brand#22", "Brand#33"))
    return m.groupBy("entity_norm", "entity_type").agg(F.countDistinct("article_id").alias("df"), F.countDistinct("source_id").alias("sources"))


@query("""WITH m AS (SELECT o_custkey % 50 AS cluster, o_orderkey % 200 AS item, CASE WHEN o_orderkey % 3 = 0 THEN 'primary' ELSE 'secondary' END AS role FROM orders),
    j AS (SELECT CASE WHEN cluster < 10 THEN cluster + 10 ELSE cluster END AS cluster, item, role FROM m) SELECT cluster, item, min(role) AS role FROM j GROUP BY ALL""")
def c14_merge_clusters(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("cluster"), (F.col("o_orderkey") % 200).alias("item"), F.when(F.col("o_orderkey") % 3 == 0, "primary").otherwise("secondary").alias("role"))
    moves = spark.range(10).select(F.col("id").alias("source"), (F.col("id") + 10).alias("target"))
    return clusters.merge(o, moves)


@query("""SELECT c_nationkey AS cluster, c_custkey AS source, first_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY CAST(floor(c_acctbal) AS BIGINT) DESC, c_custkey) AS target FROM customer""")
def c14_merge_target(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("id"), F.floor("c_acctbal").alias("subscriptions"), F.lit(0).alias("artifacts"), F.lit(0).alias("created_at"))
    return clusters.merge_target(c, "cluster").select("cluster", "source", "target")


CENTRES = "c AS (SELECT label AS cluster, embedding AS centroid FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)"


@query(f"""WITH {CENTRES}, s AS (SELECT vec_id AS id, cluster, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(centroid AS DOUBLE[])), 6) AS cos FROM embeddings, c)
    SELECT id, cluster, cos FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY cos DESC, cluster) = 1 AND cos >= 0.2""")
def c12_assign_by_centroid(spark, sf_dir):
    from newsloom.operators.ingest import keep_first

    e = table(spark, sf_dir, "embeddings")
    c = keep_first(e, ["label"], ["vec_id"]).select(F.col("label").alias("cluster"), F.col("embedding").alias("centroid"))
    return clusters.nearest_centroid(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), c, 0.2)


@query("""SELECT n_nationkey AS cluster, count(o_orderkey) AS subscriptions, count(DISTINCT o_custkey) AS users, max(o_orderdate) AS last_used FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def c15_cluster_listing(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("nation").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy(F.col("n_nationkey").alias("cluster")).agg(F.count("o_orderkey").alias("subscriptions"), F.countDistinct("o_custkey").alias("users"), F.max("o_orderdate").alias("last_used"))


@query()
def c1_event_clusters(spark, sf_dir):
    """Documents in order of id, an hour apart, with their vectors; the first line of a text is its title."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.substring_index(F.ltrim("text"), "\n", 1).alias("title"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("vec"))
    return clusters.event_clusters(d.join(e, "article_id", "left").withColumn("seconds", F.col("article_id") * 3600.0))


@query()
def c4_leader_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("place"), F.col("embedding").alias("vec"))
    return clusters.leader_clusters(e, 0.75)
