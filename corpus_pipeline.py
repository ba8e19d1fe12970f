"""A corpus pipeline of five stages over ``documents``; each is written as Parquet and read again by the next.

All stages take texts of any length. Null and empty texts, and texts of few words, fail the quality rules and go there; given to
a later stage alone they are not toxic by themselves, are like no other text, hold no secret, and are packed as the end
token. Nulls in other columns are kept. Of equal texts the one with the least id stays; rows that repeat an id leave
near-dedup as one row, rows without an id all stay. An empty table gives an empty one. Further columns, whatever their names, end
with the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import neardup, packing, quality, secrets, toxicity
from newsloom.llm.common import read_table, shared_folder, small, staged, text_bytes
from newsloom.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade of quality rules passes."""
    return _columns(docs.where(quality.keeper(docs)(text_bytes())))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return _columns(docs.where(toxicity.scorer(model)(text_bytes()) < 0.5))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates (five-word shingles, 0.8). Rows that repeat an
    id are one document, of which the row with the least text (then language, source, length) stays; rows without an id all stay."""
    found = staged(neardup.near_duplicates(docs).where("doc_id is not null").select("doc_id", "kept"))
    dropped = staged(found.where("not kept").select("doc_id").distinct())
    docs = docs.join(small(dropped, dropped.count()), "doc_id", "left_anti")
    repeated = staged(found.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if n := repeated.count():
        least = F.min(F.struct("text", "lang", "source", "n_chars")).alias("x")
        one = docs.join(small(repeated, n), "doc_id", "left_semi").groupBy("doc_id").agg(least).select("doc_id", "x.*")
        docs = _columns(docs.join(small(repeated, n), "doc_id", "left_anti")).unionByName(one)
    return _columns(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret replaced by its kind."""
    clean = docs.withColumn("text", secrets.redactor()(F.col("text").cast("binary")))
    return _columns(clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, placed in sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("toxicity", keep_civil),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("secret_scans", hide_secrets),
    ("packing", pack_sequences),
]

#: The stages go beyond SQL (compression distance, byte-level BPE); tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
