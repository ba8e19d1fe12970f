"""Rows that meet by tiles: the same as all pairs, with no pairs in a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions.query import phrases
from newsloom.functions.text import trigrams
from newsloom.operators import patterns, retrieval, tiles


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("deal,part", [(8192, 16_384), (7, 11)])
def test_similar_sets_meet_without_a_join(spark, monkeypatch, deal, part):
    monkeypatch.setattr(tiles, "DEAL", deal)
    monkeypatch.setattr(tiles, "PART", part)
    rng = np.random.default_rng(5)
    sets = [(i, sorted({f"g{int(x)}" for x in rng.integers(0, 12, 6)})) for i in range(50)] + [(90, []), (91, None), (92, [f"g{i}" for i in range(700)]), (93, [f"g{i}" for i in range(600)])]
    df = spark.createDataFrame(sets, "id long, grams array<string>")
    alike = patterns.similar(df, df, 0.3, F.col("left_id") < F.col("right_id"))
    assert "Join" not in planned(alike)
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    assert {(r["left_id"], r["right_id"]): r["similarity"] for r in alike.collect()} == {(i, j): like(a, b) for i, a in sets for j, b in sets if i < j and like(a, b) >= 0.3}


@pytest.mark.parametrize("deal,part", [(8192, 16_384), (3, 5)])
def test_phrases_meet_by_tiles(spark, monkeypatch, deal, part):
    """Copies of queries and rows, and ties that the id decides, against plain loops."""
    monkeypatch.setattr(tiles, "DEAL", deal)
    monkeypatch.setattr(tiles, "PART", part)
    rng, pool = np.random.default_rng(6), 4
    words = ["kupa", "maçı", "bugün", "saat", "sekizde", "başlıyor", "yeni", "stad"]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, [text(4), text(9), "example.com"]) for i in range(40)] + [(100 + i, ["kupa maçı bugün", "", "example.com"]) for i in range(30)]
    asked = [(i, text(3)) for i in range(8)] + [(50 + i, "kupa maçı bugün") for i in range(3)] + [(70, "!!")]
    r = spark.createDataFrame(rows, "id long, fields array<string>").withColumn("titles", F.col("fields"))
    q = spark.createDataFrame(asked, "query_id long, q string")
    grams = {i: [set(x) for x in t] for i, t in r.select("id", F.transform("titles", trigrams)).collect()}
    want = []
    for i, x, runs, own in q.select("query_id", "q", phrases(F.col("q")), trigrams(F.col("q"))).collect():
        scored = []
        for k, fields in rows:
            score = round(max(len(set(own) & g) / len(set(own) | g) if own or g else 0.0 for g in grams[k]), 6)
            phrase, n = any(x in f for f in fields), sum(any(p in f for f in fields) for p in runs)
            if phrase or n or score >= 0.3:
                scored.append((-phrase, -n, -score, k))
        want += [(i, k, rank + 1, bool(p), -n, -s) for rank, (p, n, s, k) in enumerate(sorted(scored)[:pool])]
    got = retrieval.phrase_hits(q, r, pool, 0.0)
    assert sorted((x["query_id"], x["id"], x["rank"], x["phrase"], x["grams"], x["score"]) for x in got.collect()) == sorted(want)


def test_codes_meet_without_lookups(spark, monkeypatch):
    """Copies and ties, codes of one word and of three; no table of substrings is joined."""
    from newsloom.operators import codes

    monkeypatch.setattr(tiles, "DEAL", 5)
    monkeypatch.setattr(tiles, "PART", 16)
    rng = np.random.default_rng(8)
    for n in (1, 3):
        base = [(i, [int(x) for x in rng.integers(0, 6, n)]) for i in range(60)] + [(80, None)]
        b = spark.createDataFrame(base, "id long, bits array<long>")
        q = b.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("bits").alias("qbits"))
        far = lambda x, y: sum(bin(u ^ v).count("1") for u, v in zip(x, y, strict=True))
        want = sorted((i, r + 1, j, d) for i, x in base[:60:3] for r, (d, j) in enumerate(sorted((far(x, y), j) for j, y in base[:60])[:5]))
        found = codes.nearest_codes(q, b, 5, 32 * n)
        assert sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in found.collect()) == want
        assert "flip" not in planned(found) and "piece" not in planned(found)


def test_languages_are_told_where_texts_are_read(spark):
    """Text by text as by joins, rows that repeat an id and null ids included, without a shuffle of trigrams."""
    from newsloom.operators import language

    rng = np.random.default_rng(9)
    texts = [(i, " ".join("".join(rng.choice(list("abcçğıİß𝒜é"), int(rng.integers(1, 7)))) + ",2 "[: int(rng.integers(1, 4))] for _ in range(int(rng.integers(0, 60)))), ["aa", "bb", None][i % 3]) for i in range(40)]
    texts += [(7, "abc " * 30, "aa"), (None, "abc çğı " * 20, "bb"), (60, None, "aa"), (61, "1" * 80, None), (62, "Ж" * 70, None)]
    df = spark.createDataFrame(texts, "id long, text string, lang string")
    known = language.profiles(df, most=40)
    slow = language._ranked(df.where("lang is not null"), "lang", "text", 40)
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, slow.collect()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in language.detect(df, known, most=40).collect()), key=key) == sorted((tuple(r) for r in language._by_joins(df, known, "id", "text", 40).collect()), key=key)
    assert "Window" not in planned(language.detect(df.where("id <> 7"), known, most=40))


@pytest.mark.parametrize("name", ["e5_builder", "e7_enrichment"])
def test_mentions_are_dealt_by_article(spark, small, monkeypatch, name):
    """Parts of the mentions are as many as the lines ask for, whatever else holds, and the rows stay those of the SQL."""
    from newsloom import catalog, plans
    from tests.oracle import differences

    monkeypatch.setattr(catalog, "LINES", 500)
    n = -(-spark.read.parquet(f"{small}/lineitem.parquet").count() // 500)
    df = plans.QUERIES[name](spark, small)
    assert f", {n}), REPARTITION_BY_NUM" in planned(df)
    assert differences(df, small, plans.ORACLE_SQL[name]) == []


def test_offline_embedding_looks_at_no_word_for_each_place(spark):
    """Signed counts of words by hash, as plain loops have them; no fold over the words within each of the places."""
    from newsloom.hooks import hashed_embedding

    texts = ["the cat and The dog, the end", "", None, "a a a b", "ı İ ß " * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    w = df.select("i", F.explode(F.filter(F.split(F.lower(F.coalesce("t", F.lit(""))), r"(?U)\s+"), lambda x: x != "")).alias("w"))
    want = {i: [0.0] * 64 for i in range(len(texts))}
    for i, slot, sign in w.select("i", F.pmod(F.xxhash64("w"), F.lit(64)), F.pmod(F.xxhash64("w", F.lit(1)), F.lit(2))).collect():
        want[i][slot] += -1.0 if sign else 1.0
    got = df.select("i", hashed_embedding(F.col("t")).alias("v"))
    assert {r["i"]: r["v"] for r in got.collect()} == want
    assert "aggregate(" not in planned(got)
