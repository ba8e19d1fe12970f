"""Shared helpers: reading tables, cutting lineage in the shared folder, gapless ranks."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side of a join is broadcast up to this many rows of two or three longs; beyond it Spark shuffles.
BROADCAST_ROWS = 250_000
#: Bytes that go to a Python worker in one batch, and that are worked on at a time there.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 4 << 20

_folders: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; on a
    cluster that is an error, since executors don't see each other's disks."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root and not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = root or f"file://{tempfile.mkdtemp(prefix='newsloom-')}"
        _folders[app] = f"{root.rstrip('/')}/newsloom-{app}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table cuts the lineage: an executor lost later costs no recomputation of what came
    before, results that depend on row order are fixed, and readers prune its columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if ``rows``, the counted size of ``df``, is within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself, to be mapped in Python: its session sends batches of at most ``BATCH_BYTES`` to Python workers from now on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut, without copying, so that ``column``'s values have about ``most`` bytes in each part."""
    for b in batches:
        if b.nbytes <= most or b.num_rows < 2:
            yield b
            continue
        part = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            yield b.slice(i, j - i)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless_rank(df: DataFrame, group: list[str], order: list[str], rank: str, rows: int, block_rows: int = 50_000) -> DataFrame:
    """Add ``rank``: 0, 1, ... without gaps within each ``group``, however large a group is.

    Rows are dealt into blocks by a hash of ``order``. Each block numbers its own rows, and the
    counts of the blocks before it in the group are added, so no task holds a whole group.
    ``rows`` is the row count of ``df`` (a staged table); ``order`` should tell rows apart, and rows
    that it does not tell apart are alike. The columns of ``group`` hold no nulls.
    """
    blocks = max(1, -(-rows // block_rows))
    keyed = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    before = (
        keyed.groupBy(*group, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
        .select(*group, "_block", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    own = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*order)) - 1
    ranked = keyed.withColumn("_own", own).join(before, [*group, "_block"])
    return ranked.withColumn(rank, F.col("_before") + F.col("_own")).drop("_block", "_before", "_own")


def text_bytes(col: str | Column = "text") -> Column:
    """The UTF-8 bytes of a text; none for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("binary"), F.lit("").cast("binary"))
