"""How the driver's tables stand for the roles that operators work on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "1998-08-01 00:00:00"
WINDOW_DAYS = 30
#: Lines of a part of the mentions, about.
LINES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt out to all cores if it has fewer splits than there are: a small table is one file, and heavy work on its texts would be one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the session's checkpoint folder; in local mode a temporary one where neither is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/") if root else f"file://{tempfile.mkdtemp(prefix='newsloom-')}"


def epoch(ts) -> F.Column:
    """Seconds since 1970 of a timestamp taken as UTC."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_seconds(c.cast("timestamp"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity mentions in articles: a line of an order names its part's brand; its supplier is the source. Many lines are dealt by article into parts of
    about ``LINES``, so that what a task sorts or counts of its articles does not grow with the table."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    orders = t("orders").select("o_orderkey", "o_orderdate")
    parts = t("part").select("p_partkey", "p_brand", "p_type")
    sources = t("supplier").select("s_suppkey", F.round((F.col("s_acctbal") + 1000) / 11000, 2).alias("reliability"))
    n = -(-lines.count() // LINES)
    named = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(sources, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    dealt = named.repartition(n, "l_orderkey") if n > 1 else named
    return (
        dealt.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_orderkey").alias("article_id"),
            F.col("o_orderdate").cast("timestamp").alias("published_at"),
            F.col("p_brand").alias("entity_norm"),
            F.col("p_type").alias("entity_type"),
            F.col("l_suppkey").alias("source_id"),
            "reliability",
            F.col("l_quantity").cast("long").alias("mention_count"),
        )
    )


#: The same in SQL, as the common table `mentions`.
MENTIONS_SQL = """mentions AS (
    SELECT o_orderkey AS article_id, o_orderdate AS published_at, p_brand AS entity_norm, p_type AS entity_type,
           l_suppkey AS source_id, round((s_acctbal + 1000) / 11000, 2) AS reliability, CAST(l_quantity AS BIGINT) AS mention_count
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey)"""
