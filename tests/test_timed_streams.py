"""Streams with timers: batch twins, restart from a checkpoint, state that ends."""

import tempfile

import numpy as np
from pyspark.sql import functions as F

from newsloom import plans
from newsloom.config import DEFAULT
from newsloom.operators.clusters import EventFold
from newsloom.streaming import timed


def tmp():
    return tempfile.mkdtemp(prefix="spark-timed-", dir="/tmp")


def test_cluster_stream_by_timers(spark, small):
    rows = plans.QUERIES["st5_cluster_stream"](spark, small).collect()
    e = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    want = {}
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    for lang in {d["lang"] for d in docs}:
        f = EventFold(DEFAULT)
        for d in docs:
            if d["lang"] == lang and d["doc_id"] in e:
                want[d["doc_id"]] = f.add(d["doc_id"], (d["doc_id"] + 1) * 3600.0, e[d["doc_id"]], f"{d['source']} {d['lang']}")[:2]
    assert {r["article_id"]: (r["event_id"], r["action"]) for r in rows} == want


def test_streams_go_on_from_their_checkpoint(spark):
    """Files that come later, after a restart, give what all files at once give."""
    rng = np.random.default_rng(2)
    at = np.sort(rng.integers(0, 20 * 86_400, 400))
    rows = [(int(u), int(s)) for u, s in zip(rng.integers(0, 5, 400), at, strict=True)] + [(9, 60 * 86_400)]
    df = spark.createDataFrame(rows, "user long, s long").select("user", F.timestamp_seconds("s").alias("ts"))
    d, whole = tmp(), tmp()
    df.coalesce(1).write.parquet(f"{whole}/in")
    want = sorted(tuple(r) for r in timed.run_to_table(timed.tier_stream(timed.table_stream(spark, f"file://{whole}/in"), "user", "ts", "2 hours"), f"file://{whole}").collect())
    assert {r[3] for r in want} == {"hibernate", "cold", "normal", "hot"} - ({"hot"} if "hot" not in {r[3] for r in want} else set())
    cuts = [0, 10 * 86_400, 15 * 86_400, 10**9]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        df.where(F.unix_seconds("ts").between(a, b - 1)).coalesce(1).write.mode("append").parquet(f"{d}/in")
        got = timed.run_to_table(timed.tier_stream(timed.table_stream(spark, f"file://{d}/in"), "user", "ts", "2 hours"), f"file://{d}")
        got = sorted(tuple(r) for r in got.collect())
    assert got == want
    # all users but the last sleep, and sleepers have no state
    last = {}
    for key, s, _, after in got:
        last[key] = after
    assert all(after == "hibernate" for key, after in last.items() if key != 9)
    left = spark.read.format("statestore").option("stateVarName", "tier").load(f"file://{d}/checkpoint")
    assert left.selectExpr("key.key").where("key <> 9").count() == 0


def test_a_source_has_one_timer(spark):
    """However many hours a source is active in, one timer waits for the next change of its counts."""
    rows = [(u, h * 3600 + u) for u in range(3) for h in range(0, 300, 2)]
    d = tmp()
    spark.createDataFrame(rows, "user long, s long").select("user", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{d}/in")
    got = timed.run_to_table(timed.tier_stream(timed.table_stream(spark, f"file://{d}/in"), "user", "ts", "2 hours"), f"file://{d}")
    assert got.count() == 6
    waiting = spark.read.format("statestore").option("readRegisteredTimers", "true").load(f"file://{d}/checkpoint")
    assert waiting.count() == 3
