"""Vector search, pattern matching, trigram joins and multi-index hashing against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.catalog import table
from newsloom.operators import codes, patterns, vectors


def plain_dense(queries, base, pool):
    def unit(v, dims):
        x = np.zeros(dims)
        x[: len(v or ())] = [c or 0.0 for c in v or ()]
        n = np.sqrt((x * x).sum())
        return x / n if n else x

    out = []
    for qid, q in queries:
        scored = sorted((-round(float(unit(q, 8) @ unit(v, 8) + 1) / 2, 6), i) for i, v in base)
        out += [(qid, i, r + 1, -s) for r, (s, i) in enumerate(scored[:pool])]
    return sorted(out)


def vector_rows(n=2500):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8))
    base = [(i, (centres[i % 12] + 0.3 * rng.normal(size=8)).tolist()) for i in range(n)]
    return base + [(n + i, base[5][1]) for i in range(60)] + [(9001, None), (9002, [0.0] * 8), (9003, []), (9004, [1.0]), (9005, [1.0, None, 2.0])]


def as_tuples(df):
    return sorted(tuple(r[c] for c in ("query_id", "id", "rank", "score")) for r in df.collect())


def close(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and abs(x[3] - y[3]) < 1.5e-6 for x, y in zip(a, b, strict=True))


def test_dense_and_all_lists_equal_brute_force(spark, monkeypatch):
    base = vector_rows()
    queries = [*base[::97], base[-1], base[-4]]
    b, q = spark.createDataFrame(base, "id long, vec array<double>"), spark.createDataFrame(queries, "query_id long, qvec array<double>")
    want = plain_dense(queries, base, 20)
    assert close(as_tuples(vectors.dense(q, b, 20)), want)
    index = vectors.build(b, lists=17)
    assert close(as_tuples(vectors.indexed(q, index, 20, 17)), want)
    assert index.lists.select(F.explode("ids")).count() == len(base)
    monkeypatch.setattr(vectors, "BATCH", 3)  # more queries than go to every task
    assert close(as_tuples(vectors.dense(q, b, 20)), want)
    assert vectors.dense(q.limit(0), b, 5).count() == 0 and vectors.dense(q, b.limit(0), 5).count() == 0
    assert vectors.build(b.limit(0)) is None


def test_deals_and_parts_equal_brute_force(spark, monkeypatch):
    """Queries in several deals, rows in several parts: the rows of one task are at most a pool for each of its queries, whatever blocks it reads."""
    base = vector_rows(900)
    queries = base[::4]
    b, q = spark.createDataFrame(base, "id long, vec array<double>"), spark.createDataFrame(queries, "query_id long, qvec array<double>")
    want = plain_dense(queries, base, 5)
    monkeypatch.setattr(vectors, "DEAL", 100)
    monkeypatch.setattr(vectors, "PART", 300)
    monkeypatch.setattr(vectors, "BATCH", 3)
    assert close(as_tuples(vectors.dense(q, b, 5)), want)
    index = vectors.build(b, lists=17)
    assert close(as_tuples(vectors.indexed(q, index, 5, 17)), want)
    scored = vectors.best_in_parts(vectors._packs(q), vectors.packed(b, "id", "vec", 8), 5, len(queries), len(base))
    assert scored.count() <= 5 * len(queries) * -(-len(base) // 300) < 5 * len(queries) * (len(base) // 8)


def test_recall_of_the_index(spark):
    e = table(spark, "/root/testdata/sf0.1", "embeddings")
    base, q = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    index = vectors.build(base)
    probes = vectors.probes_for(q, base, index, 10)
    got = vectors.recall(vectors.dense(q, base, 10), vectors.indexed(q, index, 10, probes)).agg(F.avg("recall"), F.count("*")).first()
    print(f"recall@10 {got[0]:.3f} of {got[1]} queries, {probes} of {len(index.centroids)} lists")
    assert got[0] >= 0.9 and probes < len(index.centroids)


def test_no_cosine_by_lambda_in_the_plan(spark, medium):
    from newsloom import plans

    plan = plans.QUERIES["r4_dense"](spark, medium)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "aggregate(" not in plan


def test_pattern_hits_equal_contains(spark, monkeypatch):
    words = ["ab", "b", "abc", "ca", "", "ü", "zz", "a b"]
    texts = [(1, ["xabcx", None]), (2, ["cab", "ü"]), (3, []), (4, None), (5, [None]), (6, ["a b", "a b"]), (7, ["b" * 50_000 + "ca"])]
    t, p = spark.createDataFrame(texts, "id long, fields array<string>"), spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "pattern string")
    want = sorted({(i, w) for i, fs in texts for f in fs or () for w in words if w and f and w in f})
    for most in (20_000, 3):
        monkeypatch.setattr(patterns, "AUTOMATON", most)
        assert sorted(tuple(r) for r in patterns.found(t, p).collect()) == want
    assert patterns.found(t, p.limit(0)).count() == 0 and patterns.found(t.limit(0), p).count() == 0


def test_trigram_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    sets = [(i, sorted({f"g{int(x)}" for x in rng.zipf(1.3, int(rng.integers(0, 14))) if x < 60})) for i in range(120)] + [(200 + i, ["g1", "g2", "g3"]) for i in range(20)]
    df = spark.createDataFrame(sets, "id long, grams array<string>")
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    for least in (0.3, 0.5, 1.0):
        got = {(r["left_id"], r["right_id"]): r["similarity"] for r in patterns.similar(df, df.where("id % 3 = 0"), least).collect()}
        assert got == {(i, j): like(a, b) for i, a in sets for j, b in sets if j % 3 == 0 and like(a, b) >= least}
    with pytest.raises(ValueError, match="above 0"):
        patterns.similar(df, df, 0)


@pytest.mark.parametrize("n,flips", [(3000, 6), (40, 30), (3, 20)])
def test_multi_index_hashing_equals_brute_force(spark, n, flips, monkeypatch):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 62, 20)
    base = [(i, int(centres[i % 20]) ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, flips)), replace=False))) for i in range(n)]
    words = lambda x: [x & (1 << 32) - 1, x >> 32]
    b = spark.createDataFrame([(i, words(x)) for i, x in base], "id long, bits array<long>")
    asked = base[:: max(1, n // 15)] + [(-1, 0)]
    q = spark.createDataFrame([(i, words(x)) for i, x in asked], "query_id long, qbits array<long>")
    got = sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in codes.nearest_codes(q, b, 5, 64).collect())
    want = sorted((i, r + 1, j, d) for i, x in asked for r, (d, j) in enumerate(sorted((bin(x ^ y).count("1"), j) for j, y in base)[:5]))
    assert got == want


def test_pairs_of_a_hot_user(spark):
    """The same counts however users are dealt; a hot user's pairs are spread over tiles."""
    from newsloom.operators import entities

    rows = [(u, c) for u in range(30) for c in range(40) if (u * 7 + c * 5) % 11 < 3] + [(99, c) for c in range(300)]
    df = spark.createDataFrame(rows, "user_id long, cluster int")
    by = {}
    for u, c in rows:
        by.setdefault(u, []).append(c)
    want = {}
    for cs in by.values():
        for a in cs:
            for b in cs:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    for many, tile in ((512, 256), (20, 16)):
        assert {(r["a"], r["b"]): r["support"] for r in entities.cooccurrence(df, many, tile).collect()} == want


def test_rollup_counts_any_span(spark):
    from newsloom.operators import trends

    rng = np.random.default_rng(1)
    rows = [(f"e{int(k)}", int(a) if a else None, int(s), int(t)) for k, a, s, t in zip(rng.integers(0, 6, 900), rng.integers(0, 90_000, 900), rng.integers(0, 70_000, 900), rng.integers(0, 10_000, 900), strict=True)]
    df = spark.createDataFrame(rows, "k string, article_id long, source_id long, t long").select("k", "article_id", "source_id", F.timestamp_seconds("t").alias("published_at"), F.lit(0.5).alias("reliability"))
    rolled = trends.rollup(df, F.timestamp_seconds(F.lit(0)), 1000, ("k",))
    for low, high in ((0, 10), (3, 4), (2, 7)):
        span = [r for r in rows if low * 1000 <= r[3] < high * 1000]
        for what, i in (("article", 1), ("source", 2)):
            got = {r["k"]: r["n"] for r in trends.distinct_of(rolled.where(F.col("bucket").between(low, high - 1)), what, ["k"], "n").collect()}
            assert got == {k: len({r[i] for r in span if r[0] == k} - {None}) for k in {r[0] for r in span}}


def test_postings_of_few_terms_stay_in_their_text(spark, monkeypatch):
    """Words that aren't asked for are dropped where they stand: no row for each word, no join. Beyond a batch, and from words cut before, the rows are the same."""
    from newsloom.operators import retrieval

    texts = [(1, "The cat, the CAT and a dog"), (2, None), (3, ""), (4, "dog-cat dog"), (4, "dog"), (5, "İstanbul é x1")]
    docs = spark.createDataFrame(texts, "id long, text string")
    terms = spark.createDataFrame([("cat",), ("dog",), ("dog",), ("é",), ("",), (None,)], "term string")
    want = [("cat", 1, 2), ("cat", 4, 1), ("dog", 1, 1), ("dog", 4, 3), ("é", 5, 1)]
    found = retrieval.postings(docs, terms=terms)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(found) == want
    cut = docs.select("id", F.split(F.lower("text"), r"[^\p{L}\p{N}]+").alias("w"))
    assert rows(retrieval.postings(cut, "w", terms)) == want
    assert rows(retrieval.postings(docs, terms=terms.limit(0))) == []
    monkeypatch.setattr(retrieval, "BATCH", 1)
    assert rows(retrieval.postings(docs, terms=terms)) == want


def test_chunk_search_reads_written_chunks_apart_from_vectors(spark, small, monkeypatch):
    """Texts are cut into words once, into a written table; they neither travel to their vectors nor are cut again where they are read. The same rows
    beyond a batch of words."""
    from newsloom import plans
    from newsloom.operators import retrieval

    given, search = [], retrieval.chunk_search
    monkeypatch.setattr(retrieval, "chunk_search", lambda q, chunks, *a, **k: given.append(chunks) or search(q, chunks, *a, **k))
    rows = sorted(map(tuple, plans.QUERIES["r1_chunk_search"](spark, small).collect()), key=str)
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "vec" not in given[0].columns and "Join" not in plan and "split(" not in plan
    monkeypatch.setattr(retrieval, "BATCH", 3)
    assert rows and sorted(map(tuple, plans.QUERIES["r1_chunk_search"](spark, small).collect()), key=str) == rows


def test_keyword_stream_keeps_only_words_asked_for(spark, monkeypatch):
    """Against plain loops, with nulls, repeats and no queries; the same beyond a batch. No other keyword is sent on."""
    from newsloom.operators import retrieval

    chunks = [(1, ["Red", "red", "steel", None], ["Big RED thing?", "steel"]), (2, None, ["red"]), (3, ["plated"], None), (4, [], ["no", None]), (5, ["x"] * 50 + ["steel", "other"], ["a steely red\u2003day"])]
    asked = [(1, "red thing", ["red", "steel", "red", ""]), (2, "none", ["zzz"]), (3, "x", []), (4, "a", ["plated", "x"])]
    c = spark.createDataFrame(chunks, "id long, keywords array<string>, questions array<string>")
    q = spark.createDataFrame(asked, "query_id int, phrase string, words array<string>")
    want = []
    for qid, phrase, ws in asked:
        found = []
        for i, ks, qs in chunks:
            low, qs = [k.lower() for k in ks or () if k], [x.lower() for x in qs or () if x is not None]
            if set(ws) & ({w for x in qs for w in x.split()} | set(low)):
                found.append((-any(phrase in x for x in qs), -sum(any(w in x for x in qs) for w in set(ws)), ks is None, -sum(k in ws for k in low), i))
        want += [(qid, i, n + 1, bool(m), -o, None if none else -k) for n, (m, o, none, k, i) in enumerate(sorted(found))]  # without keywords after those with none asked for
    got = lambda: sorted((r["query_id"], r["id"], r["rank"], bool(r["q_match"]), r["overlap"], r["kw_match"]) for r in retrieval.keyword_stream(q, c, 30).collect())
    assert got() == sorted(want)
    sent, cut = [], retrieval._cut
    monkeypatch.setattr(retrieval, "_cut", lambda df: sent.append(cut(df)) or sent[-1])
    assert got() == sorted(want)
    assert sorted(k for r in sent[0].collect() for k in r["kw"] or ()) == ["plated", "red", "red", "steel", "steel"] + ["x"] * 50
    assert retrieval.keyword_stream(q.limit(0), c, 30).count() == 0
    monkeypatch.setattr(retrieval, "BATCH", 2)
    assert got() == sorted(want)
