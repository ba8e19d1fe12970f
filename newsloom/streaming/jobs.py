"""Streaming forms: closed windows, deduplication, quotas, tiers and event clusters with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.config import DEFAULT, EngineConfig
from newsloom.operators.clusters import EventFold


def read_files(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def closed_buckets(events: DataFrame, ts: str, key: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of tumbling windows, each given once the watermark has passed its end; later events are dropped, and a
    batch backfill repairs their buckets."""
    e = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    out = e.groupBy(F.window("at", length), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_seconds("window.start").alias("bucket"), key, "n")


def sliding_buckets(events: DataFrame, ts: str, key: str, length: str, slide: str, late: str = "2 hours") -> DataFrame:
    e = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", length, slide), key).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("window.start").alias("bucket"), key, "n")


def fresh_only(events: DataFrame, ts: str, keys: list[str], history: DataFrame | None = None, late: str = "2 hours") -> DataFrame:
    """First sight of each key within the watermark, less what the history has."""
    e = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)
    return e if history is None else e.join(history.select(*keys).distinct(), keys, "left_anti")


def quota(events: DataFrame, key: str, seconds: str, window: int, limit: int) -> DataFrame:
    """A sliding quota: the times within the window are the state of a key; rejected events do not count against it.
    State holds at most ``limit`` times."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = []
        for pdf in batches:
            for s in sorted(pdf[seconds]):
                times = [t for t in times if t > s - window]
                ok = len(times) < limit
                if ok:
                    times.append(int(s))
                rows.append((k[0], int(s), len(times), ok, times[0] + window if times else int(s)))
        state.update((times,))
        yield pd.DataFrame(rows, columns=["key", "s", "used", "allowed", "reset_at"])

    return events.groupBy(key).applyInPandasWithState(step, "key long, s long, used int, allowed boolean, reset_at long", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def tiers(counts: DataFrame, key: str, dwell: int = 900) -> DataFrame:
    """A tier for each source with a dwell: (key, s, n_24h, n_7d) in, changes of tier out."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tier, since = state.get if state.exists else ("normal", -dwell)
        rows = []
        for pdf in batches:
            for s, day, week in sorted(zip(pdf.s, pdf.n_24h, pdf.n_7d, strict=True)):
                wanted = "hibernate" if week == 0 else "hot" if day >= 20 else "normal" if day >= 3 else "cold"
                if wanted != tier and (s - since >= dwell or "hibernate" in (wanted, tier)):
                    rows.append((k[0], int(s), tier, wanted))
                    tier, since = wanted, int(s)
        state.update((tier, int(since)))
        yield pd.DataFrame(rows, columns=["key", "s", "before", "after"])

    return counts.groupBy(key).applyInPandasWithState(step, "key long, s long, before string, after string", "tier string, since long", "append", GroupStateTimeout.NoTimeout)


def cluster_stream(articles: DataFrame, block: str, cfg: EngineConfig = DEFAULT, late: str | None = None) -> DataFrame:
    """Event clustering with each block's live clusters as state; clusters leave it after the window. With ``late``, the delay of a
    watermark, a block's whole state goes once the watermark has passed the window after its last article, and articles
    older than the watermark are dropped; without it no article is, and a block that falls silent keeps its state."""
    names = ["article_id", "event_id", "action", "similarity"]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fold = EventFold(cfg)
        if state.exists:
            fold.load(state.get)
        rows = []
        for pdf in batches:
            pdf = pdf.sort_values(["seconds", "article_id"])
            rows += [(int(a), *fold.add(int(a), float(s), v, t or "")) for a, s, v, t in zip(pdf.article_id, pdf.seconds, pdf.vec, pdf.title, strict=True)]
        state.update(fold.dump())
        if late:
            last = max(c["seen"] for c in fold.live)
            state.setTimeoutTimestamp(int((last + cfg.cluster_window_hours * 3600) * 1000) + 1)
        yield pd.DataFrame(rows, columns=names)

    shape = "ids array<long>, seen array<double>, vecs array<array<double>>, titles array<string>"
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    if late:
        articles = articles.withColumn("at", F.timestamp_millis((F.col("seconds") * 1000).cast("long"))).withWatermark("at", late)
    return articles.groupBy(block).applyInPandasWithState(step, "article_id long, event_id long, action string, similarity double", shape, "append", timeout)


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over what there is now and wait; ``sink`` gets each batch and its number, so that writing a batch a
    second time replaces the first."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
