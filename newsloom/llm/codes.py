"""Compression of vectors to short codes: codebooks of whole numbers, learned by rounds of assignment and mean, one for each part of a vector.

A part's nearest entry is found by partial distances: dimensions go in descending order of the codebook's variance, and an entry
is dropped once its sum strictly exceeds the best complete distance so far. Sums are whole numbers, so results
are the same however rows are dealt.

Rows whose vector is null, or holds null or non-finite components, are left out; shorter vectors end in zeros, as do
all up to a length that the parts divide. With fewer rows than entries there are as many entries as rows. Equal distances go to the
lower entry; an entry without parts stays as it is. Ids may be null or repeat: the first entries come by id, then vector, null ids
last. Rows with null labels are a group of their own. Components must be small enough for exact sums (squared lengths below 2^53). An
empty table gives an empty one; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, small_batches, staged
from .intvectors import matrix, scaled

#: Rows that are worked on at a time.
ROWS = 4096
#: Dimensions that are added up for all entries before the first complete distance.
OPENING = 2


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` the nearest entry of ``book`` (the lower one of equals) and its squared distance; and how many
    differences were squared."""
    turn = np.argsort(-book.astype(float).var(0), kind="stable")
    head, rest = turn[:OPENING], turn[OPENING:]
    partial = ((x[:, None, head] - book[None, :, head]) ** 2).sum(2)
    # the entry that opens best is completed first: its distance is the best complete one
    lead = partial.argmin(1)
    best = ((x - book[lead]) ** 2).sum(1)
    row, entry = np.nonzero(partial <= best[:, None])
    d, spent = partial[row, entry], partial.size * len(head) + x.size
    for k in rest:
        d = d + (x[row, k] - book[entry, k]) ** 2
        spent += len(d)
        stays = d <= best[row]
        row, entry, d = row[stays], entry[stays], d[stays]
    first = np.lexsort((entry, d, row))
    first = first[np.r_[True, np.diff(row[first]) > 0]] if len(first) else first
    return entry[first], d[first], spent


def _parts(vectors: pa.Array, dims: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of the vectors as [row, part, place], with where they start."""
    for i in range(0, len(vectors), ROWS):
        yield i, matrix(vectors.slice(i, ROWS).to_pylist(), dims).astype(np.int64).reshape(-1, parts, dims // parts)


def _learn(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: assign all parts, replace each entry by the floor of its parts' mean."""
    parts, entries, width = books.shape
    names = [f"s{i}" for i in range(width)]
    schema = "part int, entry int, n long, " + ", ".join(f"{s} long" for s in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            for _, x in _parts(b.column(0), parts * width, parts):
                for p in range(parts):
                    at = nearest(x[:, p], books[p])[0]
                    n[p] += np.bincount(at, minlength=entries)
                    for k in range(width):
                        np.add.at(sums[p, :, k], at, x[:, p, k])
        p, e = np.nonzero(n)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), *(pa.array(sums[p, e, k]) for k in range(width))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *names])

    told = small_batches(kept.select("v")).mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names))
    out = books.copy()
    for r in told.collect():  # one row for each entry of a codebook
        out[r["part"], r["entry"]] = [r[s] // r["n"] for s in names]
    return out


def codebooks(kept: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray | None:
    """[part, entry, place] of ``kept`` (vec_id, v; a written table); none if it is empty."""
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    if not first:
        return None
    longest = max(1, kept.agg(F.max(F.size("v"))).first()[0])
    dims = -(-longest // parts) * parts
    books = matrix([r["v"] for r in first], dims).astype(np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _learn(kept, books)
    return books


def compress(embeddings: DataFrame, *, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (errors summed over a label), codebooks_sha256, for each row kept."""
    if entries > 256:
        raise ValueError("a part's code has two hex digits: 256 entries at most")
    kept = staged(scaled(embeddings.select("vec_id", "label", "embedding"), scale).select("vec_id", "label", "v"))
    books = codebooks(kept, parts, entries, rounds)
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    digest, dims = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest(), books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in _parts(b.column(2), dims, parts):
                told = [nearest(x[:, p], books[p])[:2] for p in range(parts)]
                codes = np.stack([t[0] for t in told], 1).astype(np.uint8)
                error = np.stack([t[1] for t in told], 1).sum(1)
                part = b.slice(i, len(x))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

    kind = dict(kept.dtypes)
    coded = staged(small_batches(kept).mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"))
    sums = staged(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    joined = coded.join(small(sums, sums.count()), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
