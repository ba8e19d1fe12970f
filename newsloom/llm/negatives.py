"""Hard negatives: for an anchor and each of its nearest rows of the same label, the first rows of other labels in a window of scores.

The score of a row is its inner product with the anchor. All rows are indexed by vantage-point trees over norm-augmented
vectors (``vantage``): the upper tree, cut from a bounded sample, deals rows into cells; a cell's rows are dealt into blocks of
about ``BLOCK_ROWS``, each with a tree of its own. A search goes to the cell nearest to the query within its window first; the k-th
row found there narrows the window, and only the cells that the rest of the window meets are searched then. Queries travel in
packs, blocks as rows of a table, so that a task holds one block and one pack at a time.

Of rows with one vector and label, those that so many smaller ids precede that no list can reach them are not indexed: with the
order by score, then id, they stand behind those in every list.

Rows with a null label, a null vector, or a null or non-finite component take no part; shorter vectors end in zeros. Rows with a
null id come last among equal scores and are no anchors. Repeated rows stand for themselves, an anchor's repetitions each
have their results; rows of the anchor's own id are not "other" rows. Components must be small enough for exact
sums (squared lengths below 2^53), else an error is raised. An empty table gives an empty one; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, staged
from .intvectors import matrix, scaled
from .vantage import LEAF_ROWS, NO_ID, Queries, Rows, Tree, annulus, augmented, build, depth_for, leaf_bounds, search

#: Rows of a block; rows that the upper tree is cut from at most, and of them for each cell at least; queries of a pack at most.
BLOCK_ROWS, SAMPLE_ROWS, SAMPLE_PER_CELL, PACK = 4096, 4096, 16, 512


@dataclass(frozen=True)
class Index:
    blocks: DataFrame
    router: Tree
    m2: float
    dims: int

    @property
    def cells(self) -> int:
        return len(self.router.edges) - 1


def _own(c: str = "vec_id") -> Column:
    return F.coalesce(F.col(c), F.lit(int(NO_ID))).cast("long")


def index(kept: DataFrame, reach: int, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS) -> Index | None:
    """The index of ``kept`` (vec_id, label, v, vv; a written table), for searches for up to ``reach`` rows; none if it is empty."""
    told = kept.agg(F.count(F.lit(1)).alias("n"), F.max("vv").alias("m2"), F.max(F.size("v")).alias("dims")).first()
    if not told["n"]:
        return None
    m2, dims = float(told["m2"]), max(1, told["dims"])
    cells = min(depth_for(told["n"], block_rows), int(np.log2(max(1, min(told["n"], sample_rows) // SAMPLE_PER_CELL))))
    sample = kept.orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(sample_rows).select("v").collect() if cells else []
    router = build(augmented(matrix([r["v"] for r in sample], dims), m2), cells)
    # rows beyond the sample may lie anywhere: cells reach from cut to cut
    for node in range(len(router.vantage)):
        cut = router.high[2 * node + 1]
        router.low[2 * node + 1], router.low[2 * node + 2], router.high[2 * node + 2] = 0.0, cut, np.inf

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            points, node = augmented(matrix(b["v"].tolist(), dims), m2), np.zeros(len(b), int)
            for _ in range(cells):
                d = np.sqrt(((points - router.vantage[node]) ** 2).sum(1))
                node = 2 * node + 1 + (d > router.high[2 * node + 1])
            yield b.assign(cell=(node - len(router.vantage)).astype("int32"))

    equals = Window.partitionBy("v", "label").orderBy(F.asc_nulls_last("vec_id"))
    rows = kept.withColumn("_place", F.dense_rank().over(equals)).where(F.col("_place") <= reach + 1).select(_own().alias("vec_id"), "label", "v")
    placed = staged(small_batches(rows).mapInPandas(place, "vec_id long, label int, v array<long>, cell int"))
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))

    def plant(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = matrix(g["v"].tolist(), dims)
        t = build(augmented(x, m2), depth_for(len(x), LEAF_ROWS))
        packed = [a.tobytes() for a in (t.vantage, t.low, t.high, t.edges.astype(np.int64), g["vec_id"].to_numpy(np.int64)[t.order], g["label"].to_numpy(np.int64)[t.order], x[t.order].astype(np.int32))]
        return pd.DataFrame([(key[0], *packed)], columns=["cell", "vantage", "low", "high", "edges", "ids", "labels", "x"])

    # at most 256 cells: the counts of their rows are a table of fixed size
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), "parts"))
    blocks = dealt.groupBy("cell", "part").applyInPandas(plant, "cell int, vantage binary, low binary, high binary, edges binary, ids binary, labels binary, x binary")
    return Index(staged(blocks), router, m2, dims)


PACK_SCHEMA = "cell int, qid binary, own binary, label binary, lowest binary, highest binary, q binary"
FOUND = "qid long, score long, vec_id long"


def _read(row, dims: int) -> Queries:
    get = lambda k, t: np.frombuffer(row[k], t)
    q = get("q", np.int32).reshape(-1, dims).astype(float)
    return Queries(get("qid", np.int64), get("own", np.int64), q, (q * q).sum(1), get("label", np.int64), get("lowest", float), get("highest", float))


def _packs(queries: DataFrame, ix: Index, home: bool) -> DataFrame:
    """Packs of queries for each cell: the nearest one that the window of a query meets (``home``), or all others that it meets."""
    m2, dims, router = ix.m2, ix.dims, ix.router

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}

        def pack(cell: int) -> pd.DataFrame:
            part = held.pop(cell)
            cols = [np.array([p[i] for p in part], t).tobytes() for i, t in enumerate((np.int64, np.int64, np.int64, float, float))]
            return pd.DataFrame([(cell, *cols, np.array([p[5] for p in part], np.int32).tobytes())], columns=["cell", "qid", "own", "label", "lowest", "highest", "q"])

        for b in batches:
            q = matrix(b["v"].tolist(), dims)
            qq, wide, lowest, highest = (q * q).sum(1), b["widest"].to_numpy(float), b["lowest"].to_numpy(float), b["highest"].to_numpy(float)
            near, far = leaf_bounds(router, q, qq, m2)
            first, last, slack = annulus(qq, m2, wide, highest)
            key = np.maximum(near - slack[:, None], first[:, None])
            key[(near - slack[:, None] > last[:, None]) | (far + slack[:, None] < first[:, None])] = np.inf
            at_home = np.argmin(key, axis=1)
            asks = np.zeros(key.shape, bool)
            asks[np.arange(len(q)), at_home] = True
            if not home:  # the window, narrowed since, may meet fewer cells; the home is the one of the wide window
                last = annulus(qq, m2, lowest, highest)[1]
                asks = ~asks & (near - slack[:, None] <= last[:, None])
            asks &= key < np.inf
            own, label, qid = b["own"].to_numpy(np.int64), b["label"].to_numpy(np.int64), b["qid"].to_numpy(np.int64)
            for i, cell in zip(*np.nonzero(asks), strict=True):
                held.setdefault(int(cell), []).append((qid[i], own[i], label[i], lowest[i], highest[i], q[i]))
                if len(held[int(cell)]) == PACK:
                    yield pack(int(cell))
        yield from (pack(cell) for cell in list(held))

    return small_batches(queries).mapInPandas(route, PACK_SCHEMA)


def _meet(packs: DataFrame, ix: Index, k: int, same: bool) -> DataFrame:
    m2, dims = ix.m2, ix.dims

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                get = lambda c, t: np.frombuffer(row[c], t)  # noqa: B023, E731
                tree = Tree(get("vantage", float).reshape(-1, dims + 1), get("low", float), get("high", float), get("edges", np.int64), np.empty(0, int))
                rows = Rows(tree, get("ids", np.int64), get("labels", np.int64), get("x", np.int32).reshape(-1, dims).astype(float))
                qs = _read({c: row["_" + c] for c in ("qid", "own", "label", "lowest", "highest", "q")}, dims)
                at, s, i, _ = search(rows, qs, m2, k, same)
                yield pd.DataFrame({"qid": qs.qid[at], "score": s.astype(np.int64), "vec_id": i})

    named = packs.select("cell", *(F.col(c).alias("_" + c) for c in packs.columns if c != "cell"))
    return small_batches(named.join(ix.blocks, "cell")).mapInPandas(run, FOUND)


def first_rows(queries: DataFrame, ix: Index, k: int, same: bool) -> DataFrame:
    """qid, rank (from 1), score, vec_id: the first k rows of each query.

    ``queries``, a written table: qid, own (its vector's id), label, v, and the window of scores, lowest and highest."""
    ranked = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    ranks = lambda df: df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    asked = queries.withColumn("widest", F.col("lowest"))
    found = ranks(_meet(_packs(asked, ix, True), ix, k, same))
    if ix.cells == 1:
        return found
    found = staged(found)
    bound = found.where(F.col("rank") == k).select("qid", F.col("score").cast("double").alias("_kth"))
    narrowed = asked.join(bound, "qid", "left").withColumn("lowest", F.greatest("lowest", F.coalesce("_kth", "lowest"))).drop("_kth")
    rest = _meet(_packs(narrowed, ix, False), ix, k, same)
    return ranks(found.select("qid", "score", "vec_id").unionByName(rest))


def mine(embeddings: DataFrame, anchors: str | Column, *, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``anchors`` is the condition on vec_id that makes a row an
    anchor; negatives score ``low`` to ``high`` hundredths of the positive. ``embeddings``: vec_id, embedding, label."""
    spark: SparkSession = embeddings.sparkSession
    fine = scaled(embeddings.where("label is not null").select("vec_id", F.col("label").cast("int").alias("label"), "embedding"), scale)
    kept = staged(fine.select("vec_id", "label", "v", "vv"))
    ix = index(kept, max(positives, negatives), block_rows, sample_rows)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if ix is None:
        return spark.createDataFrame([], out)
    anchor = staged(
        kept.where(anchors).select(F.monotonically_increasing_id().alias("qid"), F.col("vec_id").alias("own"), "label", "v", F.lit(-float("inf")).alias("lowest"), F.lit(float("inf")).alias("highest"))
    )
    near = first_rows(anchor, ix, positives, True).select("qid", F.col("rank").alias("_place"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
    pairs = staged(near.join(anchor.drop("lowest", "highest"), "qid").withColumn("qid", F.col("qid") * positives + F.col("_place") - 1))
    p = F.col("positive_score")
    windows = pairs.where(p >= 0).select("qid", "own", "label", "v", F.ceil(p * low / 100 - 1e-6).cast("double").alias("lowest"), F.floor(p * high / 100 + 1e-6).cast("double").alias("highest"))
    found = first_rows(windows, ix, negatives, False).withColumnRenamed("score", "negative_score")
    named = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c)).alias
    return found.join(pairs, "qid").select(F.col("own").alias("anchor_id"), named("positive_id")("positive_id"), "rank", named("vec_id")("negative_id"), "positive_score", "negative_score")
