"""Streams whose state ends by itself: processors with event-time timers.

A key's state is what its timers still need: a tier's hourly counts of seven days, an event cluster until its window has passed, a
quota's times until they count no more. When the last timer has gone, nothing of the key is left.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from newsloom.catalog import scratch
from newsloom.config import DEFAULT, EngineConfig
from newsloom.operators.clusters import EventFold

HOUR, DAY, WEEK = 3600, 86_400, 604_800
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tier_of(day: int, week: int) -> str:
    """By how much a source has given in a day and a week."""
    return "hibernate" if week == 0 else "hot" if day >= 20 else "normal" if day >= 3 else "cold"


class Tiers(StatefulProcessor):
    """A source's tier at full hours, held for a dwell unless it falls asleep or wakes. Its counts change when an hour ends, a day later and
    a week later; one timer stands for the next of these times, and when it fires all those that the watermark has passed are gone through. A source that sleeps has no state."""

    def __init__(self, dwell: int = 900):
        self.dwell = dwell

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getValueState("hours", "hours array<long>, counts array<long>, done long")
        self.tier = handle.getValueState("tier", "tier string, since long")

    def _counts(self) -> tuple[dict[int, int], int]:
        """Events of the hours that still count, and up to which time the tier is known."""
        state = self.hours.get() if self.hours.exists() else None
        return (dict(zip(state[0], state[1], strict=True)), state[2]) if state else ({}, -1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts, done = self._counts()
        before = min(_times(counts, done), default=None)
        for pdf in rows:
            hours, n = np.unique(pdf["s"].to_numpy() // HOUR, return_counts=True)
            for h, k in zip(hours.tolist(), n.tolist(), strict=True):
                counts[h] = counts.get(h, 0) + k
        if counts:
            self.hours.update((list(counts), list(counts.values()), done))
            due = min(_times(counts, done), default=None)
            if due is not None and due != before:
                if before is not None:
                    self.handle.deleteTimer(before * 1000)
                self.handle.registerTimer(due * 1000)
        yield pd.DataFrame([], columns=["key", "s", "before", "after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        counts, done = self._counts()
        mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // 1000
        before, since = self.tier.get() if self.tier.exists() else ("hibernate", None)
        out, times = [], sorted(_times(counts, done))
        due = times[: bisect_right(times, mark)]
        hours = sorted(counts)
        sums = [0, *accumulate(counts[h] for h in hours)]
        # events of the hours that begin before a time
        until = lambda at: sums[bisect_left(hours, -(-at // HOUR))]
        for at in due:
            all_before = until(at)
            after = tier_of(all_before - until(at - DAY), all_before - until(at - WEEK))
            if after != before and (since is None or at - since >= self.dwell or "hibernate" in (before, after)):
                out.append((key[0], at, before, after))
                before, since = after, None if after == "hibernate" else at
        if before == "hibernate":
            if self.tier.exists():
                self.tier.clear()
        elif out:
            self.tier.update((before, since))
        if due:
            done = due[-1]
            counts = {h: n for h, n in counts.items() if h * HOUR >= done - WEEK}
        if len(times) > len(due):
            self.handle.registerTimer(times[len(due)] * 1000)
            self.hours.update((list(counts), list(counts.values()), done))
        else:
            self.hours.clear()
        yield pd.DataFrame(out, columns=["key", "s", "before", "after"])

    def close(self) -> None:
        pass


def _times(counts: dict[int, int], done: int) -> set[int]:
    """When the counts of a source change, after ``done``."""
    return {at for h in counts for at in (h * HOUR + HOUR, h * HOUR + HOUR + DAY, h * HOUR + HOUR + WEEK) if at > done}


class Clusters(StatefulProcessor):
    """Event clustering of a block: its live clusters are a list, one timer for each time that one of them can end."""

    def __init__(self, cfg: EngineConfig = DEFAULT):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", "id long, seen double, vec array<double>, title string")

    def _load(self) -> EventFold:
        fold, rows = EventFold(self.cfg), list(self.live.get()) if self.live.exists() else []
        if rows:
            fold.load(tuple(zip(*rows, strict=True)))
        return fold

    def _keep(self, fold: EventFold) -> None:
        rows = list(zip(*fold.dump(), strict=True))
        if rows:
            self.live.put(rows)
        else:
            self.live.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fold, pdf = self._load(), pd.concat(list(rows)).sort_values(["seconds", "article_id"])
        out = [(int(a), *fold.add(int(a), float(s), v, t or "")) for a, s, v, t in zip(pdf.article_id, pdf.seconds, pdf.vec, pdf.title, strict=True)]
        self._keep(fold)
        for seen in {c["seen"] for c in fold.live}:
            self.handle.registerTimer(math.ceil((seen + self.cfg.cluster_window_hours * HOUR) * 1000) + 1)
        yield pd.DataFrame(out, columns=["article_id", "event_id", "action", "similarity"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold, at = self._load(), expiredTimerInfo.getExpiryTimeInMs() / 1000
        fold.live = [c for c in fold.live if at - c["seen"] <= self.cfg.cluster_window_hours * HOUR]
        self._keep(fold)
        yield pd.DataFrame([], columns=["article_id", "event_id", "action", "similarity"])

    def close(self) -> None:
        pass


def tier_stream(events: DataFrame, key: str, ts: str, late: str, dwell: int = 900) -> DataFrame:
    """Changes of tier: (key, s, before, after)."""
    e = events.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("at")).withColumn("s", F.unix_seconds("at")).withWatermark("at", late)
    return e.groupBy("key").transformWithStateInPandas(Tiers(dwell), "key long, s long, before string, after string", "Append", "EventTime")


def cluster_stream(articles: DataFrame, block: str, late: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(article_id, event_id, action, similarity) of articles (article_id, seconds, vec, title) by block; articles without a vector are left out."""
    a = articles.where("vec is not null").select(F.coalesce(F.col(block).cast("string"), F.lit("")).alias("block"), "article_id", F.col("seconds").cast("double").alias("seconds"), F.col("vec").cast("array<double>").alias("vec"), "title")
    a = a.withColumn("at", F.timestamp_millis((F.col("seconds") * 1000).cast("long"))).withWatermark("at", late)
    return a.groupBy("block").transformWithStateInPandas(Clusters(cfg), "article_id long, event_id long, action string, similarity double", "Append", "EventTime")


@contextmanager
def state_store(spark: SparkSession):
    """Streams begun within keep their state in RocksDB, which timers need; the setting before is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what there is and read its rows back from ``folder``, which also keeps its checkpoint: called again, it goes on from
    there. A batch that is written again replaces itself."""
    spark, schema = stream.sparkSession, stream.schema
    with state_store(spark):
        q = (
            stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
            .foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")).start()
        )
        q.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, all that are there in one batch; a table that is one file is picked out of its folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def once(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    return run_to_table(make(), f"{scratch(spark)}/stream-{uuid.uuid4().hex}")
