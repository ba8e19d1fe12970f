"""All rows of one side beside all of another, by tiles.

The left side is dealt into deals, the right side into parts; a task holds one deal and one part, and what leaves it are results, never
the pairs that met. Work grows as left times right, memory and what is sent do not: a row is sent once to each deal or part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.entities import _cut

#: Rows of a deal and of a part, about, at most; least rows of a part; bytes of a matrix of flags; rows of a result that leave at once.
DEAL, PART, LEAST_PART, FLAGS, OUT = 8192, 16_384, 256, 1 << 25, 1 << 16


def tiled(left: DataFrame, right: DataFrame, key: str, meet: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``meet`` gives of all pairs of a deal of ``left`` and a part of ``right``; rows are dealt by ``key``, and columns of the two have different names otherwise."""
    left, right = _cut(left), _cut(right)
    n, m, tasks = left.count(), right.count(), 2 * left.sparkSession.sparkContext.defaultParallelism
    deals = max(1, -(-n // DEAL))
    parts = max(1, -(-m // PART), min(-(-tasks // deals), -(-m // LEAST_PART)))
    number = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    own = lambda k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    a = left.select(F.explode(F.transform(number(parts), lambda p: p * deals + own(deals))).alias("task"), F.lit(True).alias("left"), F.struct("*").alias("a"))
    b = right.select(F.explode(F.transform(number(deals), lambda d: own(parts) * deals + d)).alias("task"), F.lit(False).alias("left"), F.struct("*").alias("b"))
    both = a.unionByName(b, allowMissingColumns=True).repartitionById(deals * parts, "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = list(batches)
        if not told:
            return
        t = pa.Table.from_batches(told)
        side = lambda flag, c: pa.Table.from_batches([pa.RecordBatch.from_struct_array(x) for x in t.filter(flag)[c].chunks], pa.schema(list(t.schema.field(c).type)))
        x, y = side(t["left"], "a"), side(pc.invert(t["left"]), "b")
        if x.num_rows and y.num_rows:
            yield from meet(x.combine_chunks(), y.combine_chunks())

    return both.mapInArrow(run, schema)


def column(t: pa.Table, name: str) -> pa.Array:
    c = t[name].combine_chunks()
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _sets(c: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Members of all sets and where each set ends."""
    return c.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False))])


class Members:
    """Which of the left sets' members are in which right sets, as flags of blocks of right sets."""

    def __init__(self, left: pa.Array, right: pa.Array):
        members, self.ends = _sets(left)
        coded = members.dictionary_encode()
        self.left, self.known = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        members, self.right_ends = _sets(right)
        at = pc.fill_null(pc.index_in(members, value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False)
        self.right, self.sizes = at, np.diff(self.right_ends)

    def rows(self, width: int = 1) -> int:
        """Rows of ``width`` right sets that make a block."""
        return max(1, min(4096, FLAGS // max(1, self.known) // max(1, width)))

    def flags(self, i: int, j: int) -> np.ndarray:
        a, b = self.right_ends[i], self.right_ends[j]
        at, row = self.right[a:b], np.repeat(np.arange(j - i), self.sizes[i:j])
        f = np.zeros((self.known, j - i), np.uint8)
        f[at[at >= 0], row[at >= 0]] = 1
        return f

    def shared(self, k: int, flags: np.ndarray) -> np.ndarray:
        """Members that left set ``k`` shares with each set of a block."""
        own = self.left[self.ends[k] : self.ends[k + 1]]
        if len(own) < 256:
            return np.add.reduce(flags[own], axis=0, dtype=np.uint8)
        return sum(np.add.reduce(flags[own[i : i + 255]], axis=0, dtype=np.uint8).astype(np.int32) for i in range(0, len(own), 255))


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id, similarity) of all pairs of sets (id, grams: distinct) that are alike by ``least``, which is above 0. Empty sets are like nothing."""
    kinds = [df.schema["id"].dataType.simpleString() for df in (left, right)]

    def meet(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        m, ids, others = Members(column(a, "grams"), column(b, "grams")), column(a, "id"), column(b, "id")
        n, rows = np.diff(m.ends), m.rows()
        held, size = [], 0

        def told() -> pa.RecordBatch:
            x, y, s = (np.concatenate([h[i] for h in held]) for i in range(3))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(x)), others.take(pa.array(y)), pa.array(s)], ["left_id", "right_id", "similarity"])

        for i in range(0, len(others), rows):
            j = min(i + rows, len(others))
            flags = m.flags(i, j)
            for k in np.flatnonzero(n):
                shared = m.shared(k, flags)
                c = np.flatnonzero(shared >= max(1, int(np.ceil(n[k] * least - 1e-9))))
                if len(c):
                    both = shared[c].astype(np.int64)
                    like = both / (n[k] + m.sizes[i + c] - both)
                    c, like = c[like >= least], like[like >= least]
                    held.append((np.full(len(c), k), i + c, like))
                    size += len(c)
                    if size > OUT:
                        yield told()
                        held, size = [], 0
        if size:
            yield told()

    sets = lambda df: df.select("id", "grams")
    return tiled(sets(left), sets(right), "id", meet, f"left_id {kinds[0]}, right_id {kinds[1]}, similarity double")


def _incidence(patterns: dict[str, int], fields: list[list[str]]) -> dict[int, np.ndarray]:
    """By pattern the rows in one of whose fields it occurs."""
    a, at = ahocorasick.Automaton(), {}
    for p, k in patterns.items():
        a.add_word(p, k)
    if not len(a):
        return {}
    a.make_automaton()
    for row, fs in enumerate(fields):
        for k in {k for f in fs if f for _, k in a.iter(f)}:
            at.setdefault(k, []).append(row)
    return {k: np.array(rows) for k, rows in at.items()}


def first_by_phrase(queries: DataFrame, rows: DataFrame, pool: int, least: float) -> DataFrame:
    """(q, ids, phrase, grams, score) of at least the first ``pool`` rows of each query in each part, by whole phrase, runs, and likeness; then by the least id.
    ``queries`` (q: distinct, runs, qt: trigrams), ``rows`` (ids: ascending, fields, ft: trigrams of each title; as many titles in every row). A row counts that holds
    the query or a run of it, or has a title like it by ``least``. Scores are rounded to six places."""
    kind = rows.schema["ids"].dataType.simpleString()

    def meet(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        q, runs = column(a, "q").to_pylist(), column(a, "runs").to_pylist()
        ids, fields = column(b, "ids"), column(b, "fields").to_pylist()
        first = pc.list_element(ids, 0).to_numpy(zero_copy_only=False)
        codes: dict[str, int] = {}
        for p in (p for x, rs in zip(q, runs, strict=True) for p in (x, *(rs or ())) if p):
            codes.setdefault(p, len(codes))
        held = _incidence(codes, fields)
        of = [[held[codes[r]] for r in rs or () if r and codes[r] in held] for rs in runs]
        ft = column(b, "ft")
        width, m = len(ft[0]), Members(column(a, "qt"), ft.flatten())
        step, n = m.rows(width), np.diff(m.ends)
        best: list[list[tuple]] = [[] for _ in q]
        nothing = np.empty(0, np.int64)
        for i in range(0, len(fields), step):
            j = min(i + step, len(fields))
            flags, sizes = m.flags(i * width, j * width), m.sizes[i * width : j * width].reshape(-1, width)
            for k, x in enumerate(q):
                shared = m.shared(k, flags).reshape(-1, width)
                whole = held.get(codes.get(x, -1), nothing)
                whole = whole[np.searchsorted(whole, i) : np.searchsorted(whole, j)] - i
                parts = [r[np.searchsorted(r, i) : np.searchsorted(r, j)] - i for r in of[k]]
                count = np.bincount(np.concatenate(parts), minlength=j - i) if parts else np.zeros(j - i, np.int64)
                there = count > 0
                there[whole] = True
                there |= (shared >= max(1, int(np.ceil(n[k] * least - 1e-9)))).any(1)
                c = np.flatnonzero(there)
                if not len(c):
                    continue
                both = shared[c].astype(np.int64)
                union = n[k] + sizes[c] - both
                # as Spark rounds: halves go up
                score = np.floor((both / np.maximum(union, 1)).max(1) * 1e6 + 0.5) / 1e6
                phrase = np.zeros(j - i, bool)
                phrase[whole] = True
                phrase, count = phrase[c], count[c]
                ok = phrase | (count > 0) | (score >= least)
                place = phrase * 1e9 + count * 10.0 + score
                if np.count_nonzero(ok) > pool:
                    ok &= place >= np.partition(place[ok], -pool)[-pool]
                found = [np.concatenate([z, w[ok]]) for z, w in zip(best[k] or [nothing, np.empty(0, bool), nothing, np.empty(0)], (i + c, phrase, count, score), strict=True)]
                order = np.lexsort((first[found[0]], -found[3], -found[2], ~found[1]))[:pool]
                best[k] = [z[order] for z in found]
        for at in range(0, len(q), 1024):
            some = [k for k in range(at, min(at + 1024, len(q))) if len(best[k])]
            if some:
                row, phrase, count, score = (np.concatenate([best[k][z] for k in some]) for z in range(4))
                names = pa.array(np.repeat(np.array([q[k] for k in some], object), [len(best[k][0]) for k in some]), pa.string())
                yield pa.RecordBatch.from_arrays([names, ids.take(pa.array(row)), pa.array(phrase), pa.array(count.astype(np.int32)), pa.array(score)], ["q", "ids", "phrase", "grams", "score"])

    asked = queries.select(F.col("q").alias("_key"), "q", "runs", "qt")
    return tiled(asked, rows.select(F.xxhash64("fields", "ft").alias("_key"), "ids", "fields", "ft"), "_key", meet, f"q string, ids {kind}, phrase boolean, grams int, score double")
