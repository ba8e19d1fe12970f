"""Sinks: exports by split, upserts into a versioned table, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from newsloom.operators.ingest import failures, resolve_siblings, upsert


def export_samples(samples: DataFrame, path: str, fmt: str = "json", split: str = "split") -> None:
    """A folder for each split."""
    samples.write.mode("overwrite").partitionBy(split).format(fmt).save(path)


def upsert_version(old_path: str | None, new: DataFrame, keys: list[str], new_path: str, protected: Column | None = None) -> DataFrame:
    """Write the merged table as a new version; readers move on to its path, so a lost job leaves the old one whole."""
    out = upsert(new.sparkSession.read.parquet(old_path), new, keys, protected) if old_path else new.dropDuplicates(keys)
    out.write.mode("errorifexists").parquet(new_path)
    return new.sparkSession.read.parquet(new_path)


def write_with_dead_letters(rows: DataFrame, ok: Column, severe: Column, key: str, good_path: str, dead_path: str) -> None:
    good, dead = failures(rows, ok, severe)
    good.write.mode("append").parquet(good_path)
    resolve_siblings(dead, good, key).write.mode("append").parquet(dead_path)
