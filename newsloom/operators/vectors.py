"""Vector search: blocked products of unit vectors, exact or by an inverted-file index.

Vectors are brought to length 1 once and packed into blocks of rows; a block of rows and a pack of queries meet in
one matrix product. Beyond a batch, queries are dealt into deals and blocks into parts: a task holds one deal and one part, and the best few
of each query among all of the part's rows leave it. A vector without length, or none, scores as if it stood at right angles to everything.

The index deals rows into lists by the nearest of some centroids (spherical k-means over all rows); a query reads the lists of its nearest
centroids only. Centroids are sums of whole numbers, so an index does not depend on how rows were dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from newsloom.operators.entities import _cut

#: Rows of a block, queries of a pack, queries that are sent to every task, parts that a list is dealt into.
BLOCK, PACK, BATCH, SALT = 1024, 256, 1000, 8
#: Queries of a deal and rows of a part, about, at most; candidates that a task holds before it keeps each query's best; what rounding to six places may move a cosine.
DEAL, PART, HELD, SLACK = 16_384, 65_536, 2_000_000, 2e-6
#: Lists at most (their centroids go to every task), rounds of k-means, steps of a unit vector's components in sums.
MOST_LISTS, ROUNDS, STEPS = 1024, 6, 1 << 24


def units(vectors: pa.Array) -> np.ndarray:
    """A unit vector for each row; zeros where there is none. Shorter vectors end in zeros."""
    lists = vectors.to_pylist() if vectors.null_count or not len(vectors) else None
    lengths = np.diff(vectors.offsets.to_numpy()) if lists is None else np.array([len(v or ()) for v in lists], int)
    if lists is None and (lengths == lengths[0]).all() and not vectors.flatten().null_count:
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    else:
        lists = vectors.to_pylist() if lists is None else lists
        x = np.zeros((len(vectors), max([1, *lengths])))
        for i, v in enumerate(lists):
            if v:
                x[i, : len(v)] = [0.0 if c is None else c for c in v]
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _name(kind: DataType) -> str:
    return kind.simpleString()


def packed(df: DataFrame, key: str, vec: str, rows: int, by: str | None = None) -> DataFrame:
    """Rows packed in the order they come in: (``by``,) ids, x (unit vectors), dims. With ``by``, a block has one value of it, and rows should be sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = units(b.column(1))
            cuts = [0, *range(rows, b.num_rows, rows), b.num_rows]
            if by:
                own = b.column(2).to_numpy(zero_copy_only=False)
                cuts = sorted({*cuts, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist()})
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j > i:
                    ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i))
                    columns = [ids, pa.array([x[i:j].tobytes()]), pa.array([x.shape[1]], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, *([b.column(2).slice(i, 1)] if by else [])], ["ids", "x", "dims", *([by] if by else [])])

    schema = f"ids array<{_name(df.schema[key].dataType)}>, x binary, dims int" + (f", {by} int" if by else "")
    return df.select(key, vec, *([by] if by else [])).mapInArrow(run, schema)


def _fit(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def products(met: DataFrame, pool: int) -> DataFrame:
    """(query_id, id, score) of the first ``pool`` of each query in each block: ``met`` has a pack (qids, qx, qdims) beside a block
    (ids, x, dims). Scores are cosines moved to 0..1, rounded to six places, and ties go to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                get = lambda c: b.column(b.schema.get_field_index(c))[row]  # noqa: B023, E731
                dims = max(get("dims").as_py(), get("qdims").as_py())
                x, q = (_fit(np.frombuffer(get(c).as_py()).reshape(-1, get(d).as_py()), dims) for c, d in (("x", "dims"), ("qx", "qdims")))
                s = np.round((q @ x.T + 1) / 2, 6)
                ids, qids = get("ids").values, get("qids").values
                at = np.ones(s.shape, bool) if s.shape[1] <= pool else s >= np.partition(s, s.shape[1] - pool, axis=1)[:, -pool, None]
                r, c = np.nonzero(at)
                place = np.argsort(np.asarray(ids.take(pa.array(c)).to_numpy(zero_copy_only=False)), kind="stable")
                place = place[np.lexsort((-s[r, c][place], r[place]))]
                r, c = r[place], c[place]
                first = np.arange(len(r)) - np.searchsorted(r, r) < pool
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(r[first])), ids.take(pa.array(c[first])), pa.array(s[r[first], c[first]])], ["query_id", "id", "score"])

    of = lambda c: _name(met.schema[c].dataType.elementType)
    return met.mapInArrow(run, f"query_id {of('qids')}, id {of('ids')}, score double")


def _packs(queries: DataFrame, **by) -> DataFrame:
    return packed(queries, "query_id", "qvec", PACK, **by).withColumnsRenamed({"ids": "qids", "x": "qx", "dims": "qdims"})


def first_of_each(scored: DataFrame, pool: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= pool)


def _best_of(qx: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]], pool: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the first ``pool`` of each query among the rows of all blocks (places, x, the queries that read it or all): the
    highest scores, then the lowest places."""
    kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    held, n_held, low = [kept], 0, np.full(len(qx), -np.inf)

    def keep() -> tuple:
        q, p, s = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((p, -s, q))
        q, p, s = q[order], p[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == pool - 1
        low[q[last]] = 2 * s[last] - 1 - SLACK
        return q[place < pool], p[place < pool], s[place < pool]

    for places, x, asked in blocks:
        for at in range(0, len(qx) if asked is None else len(asked), PACK):
            own = np.arange(at, min(at + PACK, len(qx))) if asked is None else asked[at : at + PACK]
            cos = qx[own] @ x.T
            near = cos >= low[own, None]
            if cos.shape[1] > pool and np.count_nonzero(near) > 2 * pool * len(own):
                near &= cos >= np.partition(cos, -pool, axis=1)[:, -pool, None] - SLACK
            r, c = np.nonzero(near)
            held.append((own[r], places[c], np.round((cos[r, c] + 1) / 2, 6)))
            n_held += len(r)
            if n_held > HELD:
                held, n_held = [keep()], 0
    return keep()


def best_in_parts(packs: DataFrame, blocks: DataFrame, pool: int, n_queries: int, n_rows: int, reads: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, id, score) of the first ``pool`` of each query in each part: ``packs`` (qids, qx, qdims) against ``blocks`` (ids, x, dims). A deal
    of queries goes to every part and a part to every deal, so what is sent grows by deals and parts, not by packs and blocks. ``reads``
    gives the lists that each query reads, a row of flags for each; then blocks have their list as ``cell``."""
    id_kind, query_kind = (df.schema[c].dataType.elementType for df, c in ((blocks, "ids"), (packs, "qids")))
    deals = max(1, -(-n_queries // DEAL))
    tasks = 2 * blocks.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n_rows // PART), min(-(-tasks // deals), -(-n_rows // BLOCK)), 1)
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    own = lambda ids, n: F.pmod(F.xxhash64(F.element_at(ids, 1)), F.lit(n)).cast("int")
    asked = packs.withColumn("task", F.explode(F.transform(number(parts), lambda p: p * deals + own("qids", deals))))
    read = blocks.withColumn("task", F.explode(F.transform(number(deals), lambda d: own("ids", parts) * deals + d)))
    both = asked.unionByName(read, allowMissingColumns=True).repartitionById(deals * parts, "task").sortWithinPartitions("task")

    def meet(task: list[dict]) -> Iterator[pa.RecordBatch]:
        told, base = ([r for r in task if r[k] is not None] for k in ("qids", "ids"))
        if not told or not base:
            return
        dims = max(r[k] for r, k in [*((r, "qdims") for r in told), *((r, "dims") for r in base)])
        matrix = lambda r, x, d: _fit(np.frombuffer(r[x]).reshape(-1, r[d]), dims)
        qx, qids = np.concatenate([matrix(r, "qx", "qdims") for r in told]), pa.concat_arrays([r["qids"] for r in told])
        ids = pa.concat_arrays([r["ids"] for r in base])
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ends = np.cumsum([len(r["ids"]) for r in base])
        flags = reads(qx) if reads else None
        met = ((place[end - len(r["ids"]) : end], matrix(r, "x", "dims"), np.flatnonzero(flags[:, r["cell"]]) if reads else None) for r, end in zip(base, ends, strict=True))
        q, p, s = _best_of(qx, met, pool)
        yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), ids.take(pa.array(order[p])), pa.array(s)], ["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = [], None
        for b in batches:
            for row in range(b.num_rows):
                r = {}
                for name, c in zip(b.schema.names, b.columns, strict=True):
                    v = c[row]
                    r[name] = None if not v.is_valid else v.values if name in ("ids", "qids") else v.as_py()
                if r["task"] != task:
                    yield from meet(held)
                    held, task = [], r["task"]
                held.append(r)
        yield from meet(held)

    return both.mapInArrow(run, f"query_id {_name(query_kind)}, id {_name(id_kind)}, score double")


def dense(queries: DataFrame, base: DataFrame, pool: int, least: float = -1.0) -> DataFrame:
    """Nearest by cosine: ``queries`` (query_id, qvec), a stated set, against all of ``base`` (id, vec), in blocks. Exact. Up to
    ``BATCH`` queries go to every task; more meet the rows by deals and parts."""
    blocks, n = packed(base, "id", "vec", BLOCK), queries.count()
    if n <= BATCH:
        scored = products(blocks.crossJoin(F.broadcast(_packs(queries.coalesce(1)))), pool)
    else:
        scored = best_in_parts(_packs(queries), blocks, pool, n, base.count())
    return first_of_each(scored, pool).where(F.col("score") >= least)


@dataclass(frozen=True)
class InvertedFile:
    """An index: ``lists``, a written table of blocks (cell, ids, x, dims), and the centroids."""

    lists: DataFrame
    centroids: np.ndarray


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (_fit(x, centroids.shape[1]) @ centroids.T).argmax(1)


def build(base: DataFrame, lists: int | None = None, rounds: int = ROUNDS) -> InvertedFile | None:
    """An inverted-file index of ``base`` (id, vec); none if it is empty. About the root of the row count of lists, ``MOST_LISTS`` at most."""
    told = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    if not told["n"]:
        return None
    dims = max(1, told["dims"] or 1)
    n_lists = min(lists or max(1, round(told["n"] ** 0.5)), MOST_LISTS)
    first = base.where("vec is not null").orderBy(F.xxhash64("vec", "id"), "id").limit(n_lists).select("vec").collect()
    centroids = _fit(units(pa.array([r["vec"] for r in first] or [[0.0]], pa.list_(pa.float64()))), dims)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(centroids.shape, np.int64)
        for b in batches:
            x = _fit(units(b.column(0)), dims)
            np.add.at(total, _nearest(x, centroids), np.rint(x * STEPS).astype(np.int64))
        cell, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(place, pa.int32()), pa.array(total[cell, place])], ["cell", "place", "s"])

    for _ in range(rounds):
        moved = np.zeros_like(centroids)
        for r in base.select("vec").mapInArrow(sums, "cell int, place int, s long").groupBy("cell", "place").agg(F.sum("s").alias("s")).collect():  # lists x dims
            moved[r["cell"], r["place"]] = r["s"]
        norm = np.sqrt((moved * moved).sum(1, keepdims=True))
        centroids = np.where(norm > 0, moved / np.where(norm > 0, norm, 1), centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = _nearest(_fit(units(b.column(1)), dims), centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32())], ["id", "vec", "cell"])

    kind = {f.name: _name(f.dataType) for f in base.schema}
    placed = base.select("id", "vec").mapInArrow(place, f"id {kind['id']}, vec {kind['vec']}, cell int")
    dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(SALT))).sortWithinPartitions("cell")
    return InvertedFile(_cut(packed(dealt, "id", "vec", BLOCK, by="cell")), centroids)


def indexed(queries: DataFrame, index: InvertedFile, pool: int, probes: int, least: float = -1.0) -> DataFrame:
    """The first ``pool`` of each query among the rows of its ``probes`` nearest lists; of all rows if that is all lists."""
    centroids = index.centroids

    def reads(qx: np.ndarray) -> np.ndarray:
        flags = np.zeros((len(qx), len(centroids)), bool)
        for at in range(0, len(qx), BLOCK):
            s = _fit(qx[at : at + BLOCK], max(qx.shape[1], centroids.shape[1]))[:, : centroids.shape[1]] @ centroids.T
            np.put_along_axis(flags[at : at + BLOCK], np.argsort(-s, axis=1, kind="stable")[:, :probes], True, axis=1)
        return flags

    rows = index.lists.agg(F.sum(F.size("ids"))).first()[0] or 0
    found = best_in_parts(_packs(queries), index.lists, pool, queries.count(), rows, reads)
    return first_of_each(found, pool).where(F.col("score") >= least)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's exact rows that were found."""
    hit = found.select("query_id", "id").withColumn("hit", F.lit(1))
    return exact.join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


def probes_for(queries: DataFrame, base: DataFrame, index: InvertedFile, pool: int, target: float = 0.95, most: int = 200) -> int:
    """The least number of lists, doubling from 1, at which at most ``most`` of the queries, chosen by hash, find ``target`` of their exact rows on average."""
    tried = _cut(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(most))
    exact, probes = _cut(dense(tried, base, pool).select("query_id", "id")), 1
    while probes < len(index.centroids):
        got = recall(exact, indexed(tried, index, pool, probes)).agg(F.avg("recall")).first()[0]
        if got is None or got >= target:
            return probes
        probes *= 2
    return len(index.centroids)
