"""Pivot partitions and time slices against all pairs and the single fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.config import DEFAULT
from newsloom.operators import clusters


def groups(n, spread, copies=0, dims=24, seed=4, per=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // per + 1, dims))
    rows = [(i, (centres[i % len(centres)] + spread * rng.normal(size=dims)).tolist(), "ab"[i % 2]) for i in range(n)]
    return rows + [(n + i, rows[1][1], "b") for i in range(copies)] + [(90_000, [0.0] * dims, "a"), (90_001, None, "a")]


def plain_components(rows, least):
    rows = [(i, np.asarray(v), b) for i, v, b in rows if v is not None]
    x = clusters._units([v for _, v, _ in rows])
    near, parent = x @ x.T >= least, {i: i for i, _, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in np.flatnonzero(near[a]):
            if b > a and rows[a][2] == rows[b][2]:
                p, q = root(rows[a][0]), root(rows[b][0])
                parent[max(p, q)] = min(p, q)
    found = {i: root(i) for i in parent}
    sizes = {r: sum(v == r for v in found.values()) for r in found.values()}
    return {i: r for i, r in found.items() if sizes[r] > 1}


@pytest.mark.parametrize("least,spread,tile", [(0.7, 0.5, 16_384), (0.9, 0.3, 40), (0.7, 0.9, 100), (-0.1, 3.0, 16_384)])
def test_components_equal_all_pairs(spark, least, spread, tile):
    rows = groups(400, spread, copies=120)
    df = spark.createDataFrame(rows, "id long, vec array<double>, block string")
    got = {r["id"]: r["component"] for r in clusters.near_components(df, least, tile).collect()}
    assert got == plain_components(rows, least)


def test_few_pairs_are_compared(spark):
    """Rows sent stay below n to the power 1.5, pairs compared far below half of all."""
    n = 6000
    df = spark.createDataFrame([r for r in groups(n, 0.12, per=120) if r[1]], "id long, vec array<double>, block string").where("id < 90000")
    seats = clusters.dealt(df, 0.9).groupBy("block", "cell", "a", "b").agg(F.count_if("first").alias("x"), F.count_if(~F.col("first")).alias("y")).agg(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") + F.col("y"))).first()
    print(f"{seats[0]} pairs of {n * n // 2}, {seats[1]} rows sent")
    assert seats[0] < 0.05 * n * n / 2 and seats[1] < n**1.5


def test_sliced_fold_equals_the_single_one(spark):
    rng = np.random.default_rng(6)
    rows, at = [], 0.0
    for i in range(500):
        at += float(rng.exponential(3600 * 6)) + (400_000 if i % 120 == 119 else 0)
        v = np.zeros(6)
        v[i % 3] = 1
        rows.append((i % 2, i, at, (v + 0.15 * rng.normal(size=6)).tolist(), f"flood in town {i % 3}" if i % 5 else None))
    rows.append((*rows[7][:2], *rows[7][2:]))  # a repeated row
    df = spark.createDataFrame(rows, "component long, article_id long, seconds double, vec array<double>, title string")
    want = []
    for c in (0, 1):
        f = clusters.EventFold(DEFAULT)
        want += [(a, *f.add(a, s, v, t or "")[:2]) for _, a, s, v, t in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1]))]
    for most in (1_000_000, 20):
        got = [(r["article_id"], r["event_id"], r["action"]) for r in clusters.fold_in_slices(df, fold_rows=most).collect()]
        assert sorted(got) == sorted(want)


def test_vectors_without_clusters_are_sent_in_few_seats(spark):
    """Where pivots tell nothing apart, rows are seated by tiles: two seats a row and tile pair it belongs to, not one for each pivot; a seat is in single precision."""
    rng = np.random.default_rng(3)
    n, dims = 2000, 64
    df = spark.createDataFrame([(i, rng.normal(size=dims).tolist(), "") for i in range(n)], "id long, vec array<double>, block string")
    seats = clusters.dealt(df, 0.5, 500)
    assert seats.count() <= 6 * n
    assert seats.select(F.max(F.length("vec"))).first()[0] == 4 * dims
    pairs = seats.groupBy("a", "b").agg(F.count_if("first").alias("x"), F.count_if(~F.col("first")).alias("y"))
    assert pairs.agg(F.sum(F.col("x") * F.col("y"))).first()[0] < 0.75 * n * n
