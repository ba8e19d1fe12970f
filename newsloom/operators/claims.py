"""A ledger of claims: at most one worker holds an item, and a batch that is run again claims nothing twice.

The ledger is a folder. Each commit is a Parquet folder of rows and a file of the commit's number that names it; that file is
created only if it isn't there, which the file system does for one writer alone. Who loses reads the ledger anew and tries
again. A claim lasts for its lease; items that were finished are never claimed again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """Claims and finishes of items, in a folder that driver and executors share. ``now`` and leases are seconds."""

    def __init__(self, spark: SparkSession, folder: str, key_type: str = "bigint"):
        self.spark, self.folder, self.key_type = spark, folder.rstrip("/"), key_type
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))

    def commits(self) -> list[dict]:
        """What has been committed, in order: number, batch, folder of rows."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/commits")) if s.getPath().getName().endswith(".json"))
        return [json.loads(self._read(f"{self.folder}/commits/{n}")) for n in names]

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, number: int, entry: dict) -> bool:
        """True if this call, and no other writer, made the commit of that number. A writer that dies before the file has its content leaves it empty,
        so the content is written aside and moved to its name, which fails if the name is taken."""
        aside, name = f"{self.folder}/aside-{uuid.uuid4().hex}", f"{self.folder}/commits/{number:08d}.json"
        out = self._fs.create(self._path(aside), False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(aside), self._path(name), none)
        except Exception as e:  # noqa: BLE001
            if not self._fs.exists(self._path(name)):
                raise
            self._fs.delete(self._path(aside), False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def rows(self, commits: list[dict] | None = None) -> DataFrame:
        """All rows of the ledger: key, action (claim or finish), worker, until, batch, number."""
        schema = f"key {self.key_type}, action string, worker string, until bigint, batch string, number bigint"
        folders = [f"{self.folder}/rows/{c['rows']}" for c in (self.commits() if commits is None else commits) if c["rows"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _append(self, batch: str, made, again: int = 100) -> list[dict]:
        """Commit the rows that ``made`` gives for the ledger as it stands; nothing if the batch is in it already."""
        for _ in range(again):
            commits = self.commits()
            if any(c["batch"] == batch for c in commits):
                return commits
            number, name = len(commits), uuid.uuid4().hex
            made(self.rows(commits)).withColumn("batch", F.lit(batch)).withColumn("number", F.lit(number).cast("long")).write.parquet(f"{self.folder}/rows/{name}")
            entry = {"number": number, "batch": batch, "rows": name}
            if self._commit(number, entry):
                return [*commits, entry]
            self._fs.delete(self._path(f"{self.folder}/rows/{name}"), True)
        raise RuntimeError(f"batch {batch}: other workers were first {again} times")

    def claim(self, queue: DataFrame, key: str, order: list[Column | str], most: int, worker: str, batch: str, now: int, lease: int) -> DataFrame:
        """The oldest ``most`` items of ``queue`` that are neither finished nor leased, claimed for ``worker``; for a batch that has claimed before, what it claimed then."""

        def made(ledger: DataFrame) -> DataFrame:
            held = ledger.where((F.col("action") == "finish") | (F.col("until") > now)).select(F.col("key").alias(key)).distinct()
            free = queue.join(held, key, "left_anti").orderBy(*order).limit(most)
            return free.select(F.col(key).cast(self.key_type).alias("key"), F.lit("claim").alias("action"), F.lit(worker).alias("worker"), F.lit(now + lease).cast("long").alias("until"))

        commits = [c for c in self._append(batch, made) if c["batch"] == batch]
        return self.rows(commits).select(F.col("key").alias(key), "worker", "until", "batch")

    def finish(self, done: DataFrame, key: str, worker: str, batch: str) -> None:
        """Items that ``worker`` is through with. What it no longer holds, since its lease ran out and another claimed it, is left to the other."""

        def made(ledger: DataFrame) -> DataFrame:
            last = ledger.where("action = 'claim'").groupBy("key").agg(F.max_by("worker", "number").alias("holder"))
            own = last.where(F.col("holder") == worker).select(F.col("key").alias(key))
            kept = done.select(F.col(key).cast(self.key_type).alias(key)).distinct().join(own, key, "left_semi")
            return kept.select(F.col(key).alias("key"), F.lit("finish").alias("action"), F.lit(worker).alias("worker"), F.lit(None).cast("long").alias("until"))

        self._append(batch, made)
