"""Operators against plain versions, and streams against their batch twins."""

import random
import tempfile
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom import hooks
from newsloom.catalog import table
from newsloom.operators import clusters, curation, entities, ingest, retrieval, trends
from newsloom.plans import entities as entity_plans
from newsloom.sources import sinks
from newsloom.streaming import jobs


def tmp():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_entity_gates(spark):
    """Three articles of two sources without a past break; one article of one source needs open gates."""
    from newsloom.config import DEFAULT

    rows = [("a", "x", i, "1998-07-30 00:00:00", i % 2, 0.5) for i in range(3)] + [("b", "x", 9, "1998-07-30 00:00:00", 1, 0.5)]
    m = spark.createDataFrame(rows, "entity_norm string, entity_type string, article_id long, published_at string, source_id int, reliability double").withColumn("published_at", F.col("published_at").cast("timestamp"))
    got = {r["entity_norm"]: r["state"] for r in trends.entity_trends(m, "1998-08-01 00:00:00", 30).collect()}
    assert got == {"a": "breaking"}
    open_ = trends.entity_trends(m, "1998-08-01 00:00:00", 30, cfg=DEFAULT.but(min_articles=0, min_sources=0))
    assert {r["entity_norm"] for r in open_.collect()} == {"a", "b"}
    assert trends.entity_trends(m.where("false"), "1998-08-01 00:00:00", 30).count() == 0


def test_preference_pairs_compare_whole_answers(spark):
    from difflib import SequenceMatcher

    from newsloom.plans import content

    d, same = tmp(), "the same opening " * 30
    one, two = same + "ends in one way " * 40, same + "goes on quite differently, " * 25
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", one), (1, 2, "user", "q"), (1, 3, "assistant", two)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    r = content.d4_preference_pairs(spark, d).first()
    assert r["ratio"] == SequenceMatcher(None, one, two).ratio() < 0.95 and r["applicable"]


def test_leaders_as_a_fold(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    vecs = [(centres[i % 6] + rng.normal(scale=0.35, size=8)).tolist() for i in range(90)]
    df = spark.createDataFrame([(i, i, v, 0) for i, v in enumerate(vecs)], "id long, place long, vec array<double>, block int")
    leaders, want = [], {}
    for i, x in enumerate(vecs):
        x = np.array(x)
        found = next((j for j in leaders if np.dot(x, vecs[j]) / np.linalg.norm(x) / np.linalg.norm(vecs[j]) >= 0.75), i)
        want[i] = found
        if found == i:
            leaders.append(i)
    assert {r["id"]: r["leader"] for r in clusters.leader_clusters(df, 0.75).collect()} == want


def test_leaders_of_a_long_chain_and_of_all_blocks(spark):
    n = 120  # each is like the one before and no other
    rows = [(i, i, [float(k in (i, i + 1)) for k in range(n + 1)], i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, place long, vec array<double>, block int")
    assert {r["id"]: r["leader"] for r in clusters.leader_clusters(df, 0.49).collect()} == {i: i - i % 2 for i in range(n)}


def test_groups_that_take_too_many_rounds(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["group"] for r in entities.propagate(path, "a", "b").collect()} == {0}
    with pytest.raises(RuntimeError):
        entities.propagate(path, "a", "b", rounds=2)


def articles(spark):
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(60):
        k = rng.randrange(4)
        rows.append((i, i * 7200.0, [x + rng.gauss(0, 0.1) for x in base[k]], f"story number {k} of the day" if rng.random() < 0.9 else "other", "en" if k % 2 else "tr"))
    return spark.createDataFrame(rows, "article_id long, seconds double, vec array<double>, title string, lang string"), rows


def test_event_clusters(spark):
    df, rows = articles(spark)
    want = {}
    for lang in ("en", "tr"):
        f = clusters.EventFold()
        for a, s, v, t, _ in [r for r in rows if r[4] == lang]:
            want[a] = f.add(a, s, v, t)[0]
    got = {r["article_id"]: r["event_id"] for r in clusters.event_clusters(df, "lang").collect()}
    assert got == want and len(set(got.values())) < 60


def test_events_of_all_sources(spark, small):
    df, rows = articles(spark)
    f = clusters.EventFold()
    want = {a: f.add(a, s, v, t)[0] for a, s, v, t, _ in rows}
    want |= {1000: None}
    none = spark.createDataFrame([(1000, 5.0, None, "no vector", "en")], df.schema)
    got = {r["article_id"]: r["event_id"] for r in clusters.event_clusters(df.union(none)).collect()}
    assert got == want
    docs, es = table(spark, small, "documents").collect(), {r["vec_id"]: r["embedding"] for r in table(spark, small, "embeddings").collect()}
    f, want = clusters.EventFold(), {}
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        title = (r["text"] or "").lstrip(" ").split("\n")[0]
        want[r["doc_id"]] = f.add(r["doc_id"], r["doc_id"] * 3600.0, es[r["doc_id"]], title)[:2] if r["doc_id"] in es else (None, "skipped")
    assert {r["article_id"]: (r["event_id"], r["action"]) for r in entity_plans.c1_event_clusters(spark, small).collect()} == want


def test_forests_hang_together_what_all_pairs_do():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(2500, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = clusters._forest(v, v, None, 0.97)
    full = {(i, j) for i, j in zip(*np.nonzero(v @ v.T >= 0.97), strict=True)}

    def groups(pairs):
        up = list(range(len(v)))
        def top(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i
        for i, j in pairs:
            up[top(i)] = top(j)
        return {frozenset(i for i in range(len(v)) if top(i) == r) for r in {top(i) for i in range(len(v))}}

    assert groups(links) == groups(full) and len(links) < 2 * len(v)


def test_cluster_stream_is_the_batch(spark):
    df, _ = articles(spark)
    d = tmp()
    for i in range(3):
        df.where((F.col("article_id") >= 20 * i) & (F.col("article_id") < 20 * i + 20)).coalesce(1).write.mode("append").parquet(f"{d}/in{i}")
    got = {}
    for i in range(3):  # files in order
        df.sparkSession.read.parquet(f"{d}/in{i}").coalesce(1).write.mode("append").parquet(f"{d}/all")
    stream = jobs.read_files(spark, f"{d}/all", df)
    jobs.run_available(jobs.cluster_stream(stream, "lang"), f"{d}/cp", lambda b, n: got.update({r["article_id"]: r["event_id"] for r in b.collect()}))
    assert got == {r["article_id"]: r["event_id"] for r in clusters.event_clusters(df, "lang").collect()}


def test_cluster_stream_forgets_blocks_past_the_window(spark):
    d = tmp()
    shape = "article_id long, seconds double, vec array<double>, title string, lang string"
    days = [(1, 10, "tr"), (2, 10, "en"), (3, 14, "en"), (4, 15, "en")]
    for i, day, lang in days:
        spark.createDataFrame([(i, day * 86400.0, [1.0, 0.5], "one story", lang)], shape).coalesce(1).write.mode("append").parquet(f"{d}/in")
    got = {}
    stream = jobs.read_files(spark, f"{d}/in", spark.createDataFrame([], shape))
    jobs.run_available(jobs.cluster_stream(stream, "lang", late="2 hours"), f"{d}/cp", lambda b, n: got.update({r["article_id"]: r["event_id"] for r in b.collect()}))
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}
    assert [r["key"]["lang"] for r in spark.read.format("statestore").load(f"{d}/cp").select("key").collect()] == ["en"]


def test_closed_buckets_are_the_batch(spark, small):
    e = table(spark, small, "events")
    d, got = tmp(), {}
    e.orderBy("ts").coalesce(1).write.parquet(f"{d}/in")
    stream = jobs.read_files(spark, f"{d}/in", e)
    jobs.run_available(jobs.closed_buckets(stream, "ts", "event_type"), f"{d}/cp", lambda b, n: got.update({(r["bucket"], r["event_type"]): r["n"] for r in b.collect()}))
    batch = {(r["b"], r["event_type"]): r["n"] for r in e.groupBy((F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600).alias("b"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    last = e.agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()[0]
    assert got == {k: n for k, n in batch.items() if k[0] + 3600 <= last - 7200}  # what the watermark has passed


def test_stream_dedup_and_quota(spark, small):
    e = table(spark, small, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    d, seen, quota = tmp(), [], []
    e.orderBy("ts").coalesce(1).write.parquet(f"{d}/in")
    jobs.run_available(jobs.fresh_only(jobs.read_files(spark, f"{d}/in", e), "ts", ["event_id"], e.where("event_id < 10")), f"{d}/cp1", lambda b, n: seen.extend(r["event_id"] for r in b.collect()))
    ids = {r["event_id"] for r in e.collect()}
    assert sorted(seen) == sorted(i for i in ids if i >= 10)
    jobs.run_available(jobs.quota(jobs.read_files(spark, f"{d}/in", e), "user_id", "s", 86400 * 5, 3), f"{d}/cp2", lambda b, n: quota.extend(b.collect()))
    by, want = defaultdict(list), {}
    for r in e.orderBy("user_id", "s").collect():
        times = [t for t in by[r["user_id"]] if t > r["s"] - 86400 * 5]
        ok = len(times) < 3
        by[r["user_id"]] = [*times, r["s"]] if ok else times
        want[r["user_id"]] = want.get(r["user_id"], 0) + ok
    got = defaultdict(int)
    for r in quota:
        got[r["key"]] += r["allowed"]
    assert dict(got) == want


def test_stream_tiers(spark):
    rows = [(1, 0, 5, 9), (1, 100, 30, 40), (1, 2000, 30, 40), (1, 2100, 0, 0), (1, 2200, 30, 40)]
    df = spark.createDataFrame(rows, "key long, s long, n_24h long, n_7d long")
    d, out = tmp(), []
    df.coalesce(1).write.parquet(f"{d}/in")
    jobs.run_available(jobs.tiers(jobs.read_files(spark, f"{d}/in", df), "key"), f"{d}/cp", lambda b, n: out.extend((r["s"], r["after"]) for r in b.collect()))
    assert out[0] == (100, "hot") and (2100, "hibernate") in out and (2200, "hot") in out


def test_subset_groups(spark):
    names = [("dunya kupasi", 5), ("fifa dunya kupasi", 9), ("kupasi dunya", 1), ("a b", 1), ("a b c", 2), ("a b d", 2), ("tek", 7)]
    got = {r["norm"]: r["canonical"] for r in entities.subset_groups(spark.createDataFrame(names, "norm string, freq int")).collect()}
    assert got == {"dunya kupasi": "fifa dunya kupasi", "fifa dunya kupasi": "fifa dunya kupasi", "kupasi dunya": "fifa dunya kupasi"}


def test_parents_need_asymmetry(spark):
    rows = [(u, 1) for u in range(20)] + [(u, 2) for u in range(6)] + [(u, 3) for u in range(6)] + [(100, 1), (100, 4), (101, 1), (101, 5)]
    got = {r["child"]: r["parent"] for r in entities.infer_parents(spark.createDataFrame(rows, "user_id int, cluster int")).collect()}
    assert got == {2: 1, 3: 1}


def test_upsert_export_and_dead_letters(spark):
    d = tmp()
    old = spark.createDataFrame([(1, "a", "admin"), (2, "b", "seed")], "id int, name string, source string")
    new = spark.createDataFrame([(1, "x", "wikidata"), (2, "y", "wikidata"), (3, "z", "wikidata")], "id int, name string, source string")
    sinks.upsert_version(None, old, ["id"], f"{d}/v0")
    got = sinks.upsert_version(f"{d}/v0", new, ["id"], f"{d}/v1", F.col("source") == "admin")
    assert {r["id"]: r["name"] for r in got.collect()} == {1: "a", 2: "y", 3: "z"}
    sinks.export_samples(got.withColumn("split", curation.split_of(F.col("id"))), f"{d}/json")
    assert spark.read.json(f"{d}/json").count() == 3
    sinks.write_with_dead_letters(new, F.col("id") != 2, F.col("id") == 2, "name", f"{d}/good", f"{d}/dead")
    assert spark.read.parquet(f"{d}/dead").first()["severity"] == "critical"


def test_dense_in_blocks_is_dense(spark, small):
    e = table(spark, small, "embeddings")
    q = e.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    base = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    a = retrieval.dense(q, base, 5).collect()
    assert all(r["id"] == r["query_id"] for r in a if r["rank"] == 1) and len(a) == 15


def test_confidence_without_an_answer(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0, None), (2, 0.1, 0.1, 0.1, 0.1, None), (3, None, None, None, None, None)], "query_id int, top3 double, coverage double, sources double, freshness double, agreement double")
    got = {r["query_id"]: (r["confidence"], r["route"]) for r in retrieval.confidence(df).collect()}
    assert got[1] == (pytest.approx(1.0), "answer") and got[2] == (pytest.approx(0.1), "decline") and got[3][0] is None


def test_deduplicate_order(spark):
    rows = [(1, "u1", "s", "e1", "h1"), (2, "u1", "s", "e2", "h2"), (3, "u3", "s", "e1", "h3"), (4, "u4", "s", None, "h1"), (5, "u5", "t", None, "h1"), (6, "u6", "s", None, "h6")]
    df = spark.createDataFrame(rows, "id int, canonical_url string, source string, external_id string, content_hash string")
    assert sorted(r["id"] for r in ingest.deduplicate(df, ["id"]).collect()) == [1, 5, 6]
    history = spark.createDataFrame([("u6",)], "canonical_url string")
    assert sorted(r["id"] for r in ingest.deduplicate(df, ["id"], history).collect()) == [1, 5]


def test_hooks(spark):
    df = spark.createDataFrame([("We met Ada Lovelace and Alan Turing. Then home",)], "text string")
    assert df.select(hooks.hook("extract_entities")("text")).first()[0] == ["Ada Lovelace", "Alan Turing"]
    assert len(df.select(hooks.hook("embed")(F.col("text"))).first()[0]) == 64
    hooks.register("embed", lambda c: F.array(F.lit(1.0)))
    assert df.select(hooks.hook("embed")(F.col("text"))).first()[0] == [1.0]
    hooks.register("embed", hooks.hashed_embedding)
