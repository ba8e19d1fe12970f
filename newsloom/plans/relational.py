"""Projections, joins, aggregates, windows, sorts and set operations (P*, J*, G*, W*, S*, U*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.catalog import table
from newsloom.functions import predicates as pred
from newsloom.operators import patterns

from .registry import query


@query("""SELECT p_partkey, coalesce(nullif(p_name, ''), p_brand) AS title, CASE WHEN p_size >= 25 THEN 'large' ELSE 'small' END AS kind, greatest(p_size, 10) AS least_size FROM part""")
def p1_projection(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.nullif("p_name", F.lit("")), "p_brand").alias("title"), F.when(size >= 25, "large").otherwise("small").alias("kind"), F.greatest(size, F.lit(10)).alias("least_size"))


@query("""SELECT p_partkey, CAST(contains(lower(p_name), 'red') AS INTEGER) + CAST(contains(lower(p_name), 'a') AS INTEGER) + CAST(contains(lower(p_name), 'steel') AS INTEGER) AS grams FROM part
    WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'a') OR contains(lower(p_name), 'steel')""")
def p2_pattern_counts(spark, sf_dir):
    grams = spark.createDataFrame([("red",), ("a",), ("steel",)], "pattern string")
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.lower("p_name")).alias("fields"))
    return patterns.found(texts, grams).groupBy(F.col("id").alias("p_partkey")).agg(F.count(F.lit(1)).cast("int").alias("grams"))


@query("""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents), w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda v: length(v) >= 5)) AS w FROM benchmark)
    SELECT doc_id, count(*) AS found FROM t, w WHERE contains(x, w) GROUP BY 1""")
def p2_passage_words(spark, sf_dir):
    """How many of the longer words of all passages, looked for at once, occur in each document."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("pattern")).where(F.length("pattern") >= 5)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array(F.lower("text")).alias("fields"))
    return patterns.found(texts, words).groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("found"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, '(?i)STEEL|copper') OR regexp_matches(p_name, '(?i)STEEL|copper')")
def p4_pattern_alternation(spark, sf_dir):
    return table(spark, sf_dir, "part").where(pred.matches_any("p_type", ["STEEL", "copper"]) | pred.matches_any("p_name", ["STEEL", "copper"])).select("p_partkey")


@query("""WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part)
    SELECT p_partkey, list_has_any(w, ['red', 'blue', 'green']) AS overlaps, list_contains(w, 'red') AS has, len(list_filter(w, lambda x: contains(x, 'ee'))) > 0 AS any_holds FROM w""")
def p5_array_predicates(spark, sf_dir):
    w = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("w"))
    return w.select("p_partkey", F.arrays_overlap("w", F.array(*map(F.lit, ("red", "blue", "green")))).alias("overlaps"), F.array_contains("w", "red").alias("has"), F.exists("w", lambda x: F.contains(x, F.lit("ee"))).alias("any_holds"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS made FROM orders) SELECT 'frame' AS asked, o_orderkey FROM o WHERE made IS NULL OR made BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-01'
    UNION ALL SELECT 'recent', o_orderkey FROM o WHERE made IS NULL OR made >= TIMESTAMP '1998-08-01' - INTERVAL 720 HOUR""")
def p6_date_window(spark, sf_dir):
    """A time frame if one is asked for, else the last hours; rows without a time pass."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("at"))
    frame = o.where(pred.within("at", "1998-08-01", 720, "1996-01-01", "1996-03-01")).select(F.lit("frame").alias("asked"), "o_orderkey")
    return frame.unionAll(o.where(pred.within("at", "1998-08-01", 720)).select(F.lit("recent").alias("asked"), "o_orderkey"))


@query("""SELECT 'all' AS asked, count(*) AS n, sum(c_acctbal)::DECIMAL(18, 2)::DOUBLE AS balance FROM customer WHERE NULL IS NULL UNION ALL SELECT 'one', count(*), sum(c_acctbal)::DECIMAL(18, 2)::DOUBLE FROM customer WHERE c_nationkey = 7""")
def p8_optional_parameter(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    of = lambda name, nation: c.where(pred.optional("c_nationkey", nation)).agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").cast("decimal(18,2)").cast("double").alias("balance")).select(F.lit(name).alias("asked"), "n", "balance")
    return of("all", None).unionAll(of("one", 7))


@query("SELECT event_id, event_type || ':' || strftime(ts, '%Y-%m-%d') AS key FROM events WHERE event_type || ':' || strftime(ts, '%Y-%m-%d') LIKE '%:2024-01-05'")
def p10_key_suffix(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(":"), F.date_format("ts", "yyyy-MM-dd")).alias("key"))
    return e.where(F.endswith("key", F.lit(":2024-01-05")))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment IS NOT NULL AND c_mktsegment <> 'MACHINERY' AND c_nationkey NOT IN (3, 4) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def p11_eligibility_gates(spark, sf_dir):
    """All gates must be open: consent, not revoked, active, subscribed."""
    active = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    gates = (F.col("c_acctbal") > 0, F.col("c_mktsegment").isNotNull(), F.col("c_mktsegment") != "MACHINERY", ~F.col("c_nationkey").isin(3, 4))
    return table(spark, sf_dir, "customer").where(pred.all_open(*gates)).join(active, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') = '7' OR TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 90")
def p9_json_predicates(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").where((k == "7") | (k.try_cast("double") > 90)).select("event_id", k.cast("long").alias("k"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-02' AND o_orderdate < TIMESTAMP '1998-08-01' AND o_orderstatus = 'O'")
def p7_half_open_window(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").where((at >= F.lit("1998-07-02").cast("timestamp_ntz")) & (at < F.lit("1998-08-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_totalprice")


@query("""SELECT n_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def j1_inner_joins(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_totalprice), 0) AS largest FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1")
def j2_left_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.coalesce(F.max("o_totalprice"), F.lit(0.0)).alias("largest"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j3_anti_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)")
def j5_semi_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(lines, "s_suppkey", "left_semi").select("s_suppkey")


@query("""WITH e AS (SELECT DISTINCT lower(p_brand) || ' ' || lower(p_type) AS norm FROM part), g AS (SELECT DISTINCT lower(p_type) AS norm FROM part)
    SELECT g.norm, count(DISTINCT e.norm) AS genericness FROM g LEFT JOIN e ON contains(e.norm, g.norm) AND e.norm <> g.norm GROUP BY 1""")
def j6_genericness(spark, sf_dir):
    from newsloom.operators.entities import genericness

    parts = table(spark, sf_dir, "part")
    e = parts.select(F.lower(F.concat_ws(" ", "p_brand", "p_type")).alias("norm")).distinct()
    return genericness(parts.select(F.lower("p_type").alias("norm")).distinct(), e)


COOC = "d AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS c FROM events)"


@query(f"WITH {COOC} SELECT a.c AS a, b.c AS b, count(*) AS support FROM d a JOIN d b ON a.user_id = b.user_id AND a.c < b.c GROUP BY ALL")
def j7_cooccurrence(spark, sf_dir):
    from newsloom.operators.entities import cooccurrence

    return cooccurrence(memberships(spark, sf_dir))


def memberships(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("cluster")).distinct()


@query("""SELECT p_partkey, len(list_filter(list_distinct(string_split(lower(p_name), ' ')), lambda w: contains(w, 'an') OR contains(w, 'ro') OR contains(w, 'e'))) AS hits FROM part""")
def j8_question_words(spark, sf_dir):
    marks = F.array(*map(F.lit, ("an", "ro", "e")))
    w = F.array_distinct(F.split(F.lower("p_name"), " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.filter(w, lambda x: F.exists(marks, lambda m: F.contains(x, m)))).cast("long").alias("hits"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question
    FROM conversations QUALIFY role = 'assistant'""")
def j9_previous_question(spark, sf_dir):
    from newsloom.operators.curation import with_question

    return with_question(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "question")


@query("""WITH f(name, a, b) AS (VALUES ('early', TIMESTAMP '1995-01-01', TIMESTAMP '1996-01-01'), ('late', TIMESTAMP '1998-01-01', TIMESTAMP '1998-03-01'), ('none', TIMESTAMP '2050-01-01', TIMESTAMP '2051-01-01'))
    SELECT name, count(o_orderkey) AS n, count(o_orderkey) >= 2 AS sufficient FROM f LEFT JOIN orders ON o_orderdate >= a AND o_orderdate < b GROUP BY 1""")
def j10_sufficiency(spark, sf_dir):
    from newsloom.operators.retrieval import sufficiency

    rows = [("early", "1995-01-01", "1996-01-01"), ("late", "1998-01-01", "1998-03-01"), ("none", "2050-01-01", "2051-01-01")]
    frames = spark.createDataFrame(rows, "name string, a string, b string").select("name", *(F.col(c).cast("timestamp_ntz").alias(c) for c in "ab"))
    return sufficiency(table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("at")), frames)


@query("SELECT r_regionkey, r_name, count(n_nationkey) AS n, string_agg(n_name, ',' ORDER BY n_name) AS children FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL")
def j12_children(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("children"))
    return table(spark, sf_dir, "region").join(n, "r_regionkey", "left").select("r_regionkey", "r_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "children")


@query("""WITH r AS (SELECT o_custkey AS artifact, o_orderkey AS revision, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT h.artifact, h.revision AS head, p.revision AS parent, f.revision AS initial, round(h.price - f.price, 2) AS change FROM r h LEFT JOIN r p ON p.artifact = h.artifact AND p.i = h.i - 1 JOIN r f ON f.artifact = h.artifact AND f.i = 1 WHERE h.i = h.n""")
def j13_revision_chain(spark, sf_dir):
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    r = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("artifact"), F.col("o_orderkey").alias("head"), F.lag("o_orderkey").over(by).alias("parent"), F.first("o_orderkey").over(by).alias("initial"),
        F.round(F.col("o_totalprice") - F.first("o_totalprice").over(by), 2).alias("change"), F.lead("o_orderkey").over(by).alias("next"),
    )
    return r.where("next IS NULL").drop("next")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount, min(l_extendedprice) AS low, max(l_extendedprice) AS high
    FROM lineitem GROUP BY ALL""")
def g1_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"),
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"),
    )


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 150000) AS big, bool_or(o_totalprice > 400000) AS huge
    FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 10""")
def g2_filtered_aggregates(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.countDistinct(F.when(F.col("o_totalprice") > 150000, F.col("o_custkey"))).alias("big"),
        F.bool_or(F.col("o_totalprice") > 400000).alias("huge"), F.countDistinct("o_custkey").alias("_n"),
    )
    return a.where("_n > 10").drop("_n")


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95, round(max(CASE WHEN i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN value END), 6) AS index_p95 FROM s GROUP BY 1""")
def g5_percentiles(spark, sf_dir):
    """Continuous, discrete, and by index into the sorted values (by rank, so nothing is collected)."""
    by = Window.partitionBy("event_type")
    e = table(spark, sf_dir, "events").select("event_type", "value", (F.row_number().over(by.orderBy("value")) - 1).alias("i"), F.count(F.lit(1)).over(by).alias("n"))
    at = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)
    return e.groupBy("event_type").agg(
        F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)"), 6).alias("p95"), F.round(F.max(F.when(F.col("i") == at, F.col("value"))), 6).alias("index_p95")
    )


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
    SELECT c_nationkey, c_mktsegment AS label, n FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1""")
def g7_mode(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("i", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "label"))).where("i = 1").drop("i")


@query("SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types, bool_or(p_size > 45) AS large FROM part GROUP BY 1")
def g8_sets(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"), F.bool_or(F.col("p_size") > 45).alias("large"))


@query("SELECT event_type, round(count(*) FILTER (WHERE value > 50)::DOUBLE / nullif(count(*) FILTER (WHERE value <= 50), 0), 6) AS ratio, round(sum(value * user_id) / nullif(sum(user_id), 0), 6) AS weighted FROM events GROUP BY 1")
def g11_ratios(spark, sf_dir):
    """Null-safe division and weighted means."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.try_divide(F.count_if(v > 50), F.count_if(v <= 50)), 6).alias("ratio"), F.round(F.try_divide(F.sum(v * F.col("user_id")), F.sum("user_id")), 6).alias("weighted"))


@query("""WITH w AS (SELECT c_custkey % 97 AS cluster, n_name AS country, sum(greatest(1, CAST(floor(c_acctbal) AS BIGINT))) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    s AS (SELECT *, w::DOUBLE / sum(w) OVER (PARTITION BY cluster) AS share, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, country) AS i FROM w)
    SELECT cluster, CASE WHEN share >= 0.6 THEN country END AS country, round(share, 6) AS share FROM s WHERE i = 1""")
def g13_majority_vote(spark, sf_dir):
    from newsloom.operators.clusters import majority

    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    votes = c.select((F.col("c_custkey") % 97).alias("cluster"), F.col("n_name").alias("country"), F.greatest(F.lit(1), F.floor("c_acctbal")).cast("long").alias("w"))
    return majority(votes, "cluster", "country", "w").withColumn("share", F.round("share", 6))


@query("SELECT c_custkey, o_orderkey, o_orderdate FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) WHERE i = 1")
def w1_keep_first(spark, sf_dir):
    from newsloom.operators.ingest import keep_first

    return keep_first(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate"), ["c_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT p_partkey, p_size, p_retailprice, p_size > 25 AS phrase FROM part ORDER BY phrase DESC, p_size DESC NULLS LAST, p_retailprice DESC, p_partkey LIMIT 30")
def s1_pool(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_size") > 25).alias("phrase")).orderBy(F.desc("phrase"), F.desc_nulls_last("p_size"), F.desc("p_retailprice"), "p_partkey").limit(30)


@query("""WITH m AS (SELECT l_partkey, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS cur, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS prev FROM lineitem GROUP BY 1), k AS (SELECT l_partkey, CASE WHEN prev > 0 THEN round((coalesce(cur, 0) - prev) / prev, 6) END AS momentum FROM m)
    SELECT l_partkey, momentum, row_number() OVER (ORDER BY coalesce(momentum, 'inf'::DOUBLE) DESC, l_partkey) AS place FROM k QUALIFY place <= 200""")
def s2_whitelisted_sort(spark, sf_dir):
    """Sorted by one of the allowed keys; what is missing counts as endless. The first 200."""
    flag = lambda x: F.sum(F.when(F.col("l_returnflag") == x, F.col("l_quantity")))
    m = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(flag("R").alias("cur"), flag("A").alias("prev"))
    k = m.select("l_partkey", F.when(F.col("prev") > 0, F.round((F.coalesce("cur", F.lit(0.0)) - F.col("prev")) / F.col("prev"), 6)).alias("momentum"))
    order = pred.sort_keys("momentum", {"momentum": float("inf"), "l_partkey": -1}) + [F.asc("l_partkey")]
    return k.orderBy(*order).limit(200).withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("SELECT DISTINCT p_brand, p_type, p_size FROM part ORDER BY ALL LIMIT 100")
def g14_distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size").distinct().orderBy("p_brand", "p_type", "p_size").limit(100)


@query("SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def s3_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    page = o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")
    return page.crossJoin(o.agg(F.count(F.lit(1)).alias("total")))


@query("WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_partkey, l_suppkey, n FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) <= 5")
def s4_top_of_each(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("i", F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("n"), "l_suppkey"))).where("i <= 5").drop("i")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u1_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("""SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2""")
def u2_articles_with_all(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"))
    j = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("l_orderkey").agg(F.countDistinct("p_brand").alias("n")).where("n >= 2").select("l_orderkey")


RUNS = """a AS (SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, 0 AS list, p_partkey AS id FROM part ORDER BY rank LIMIT 20),
    b AS (SELECT row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank, 1 AS list, p_partkey AS id FROM part ORDER BY rank LIMIT 20),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""


@query(f"WITH {RUNS}, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, list) AS seen FROM u) SELECT id, row_number() OVER (ORDER BY rank, list) AS position FROM f WHERE seen = 1")
def u3_round_robin(spark, sf_dir):
    from newsloom.operators.retrieval import round_robin

    return round_robin(two_runs(spark, sf_dir)).select("id", "position")


def two_runs(spark, sf_dir):
    """Two ranked lists of the same query."""
    p = table(spark, sf_dir, "part")
    runs = []
    for i, key in enumerate(("p_retailprice", "p_size")):
        top = p.orderBy(F.desc(key), "p_partkey").limit(20)
        runs.append(top.select(F.lit(0).alias("query_id"), F.row_number().over(Window.orderBy(F.desc(key), "p_partkey")).alias("rank"), F.lit(i).alias("list"), F.col("p_partkey").alias("id")))
    return runs[0].union(runs[1])
