"""Document fingerprints: SimHash over weighted word pairs, and search by permuted block tables.

Each pair of neighbouring words is a term; its 64-bit hash votes on every bit, for a one with plus its
weight and for a zero with minus its weight, and the sign of the sum is the fingerprint's bit. The weight
of an occurrence is the pair's length in bytes, at most ``MAX_WEIGHT``, so that the short words which all
texts of a language share weigh little; repeated pairs vote again. A text of one word has that word as its
only term; a text without words has fingerprint 0.

Null texts count as empty. Null ids come first in the order of documents. Rows that repeat an id are
documents of their own, ordered by their text. Texts may be of any length: words vote in blocks. A bit whose votes are even is 0.
An empty table gives an empty result. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import partitions, small, small_batches, staged
from .wordhash import GOLDEN, mix, word_hashes

MAX_WEIGHT = 12
#: Words whose votes are unpacked at a time: 64 votes of two bytes each.
VOTERS = 1 << 15


def simhashes(texts: list[bytes]) -> np.ndarray:
    """The 64-bit fingerprints of texts."""
    words, lengths, first = word_hashes(texts)
    out = np.zeros(len(texts), np.uint64)
    weights = np.minimum(lengths, MAX_WEIGHT).astype(np.int32)
    lo = 0
    while lo < len(texts):  # as many texts as hold VOTERS words, at least one
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + VOTERS, "right")) - 1)
        sums = _votes(words[first[lo] : first[hi]], weights[first[lo] : first[hi]], first[lo : hi + 1] - first[lo])
        out[lo:hi] = np.packbits(sums > 0, axis=1).view(">u8")[:, 0]
        lo = hi
    return out


def _votes(words: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(first) - 1, 64), np.int64)
    if not len(words):
        return sums
    single = np.diff(first) == 1
    last = first[1:][np.diff(first) > 0] - 1
    terms = mix(words * GOLDEN + np.r_[words[1:], words[:1]])
    votes = np.minimum(weights + np.r_[weights[1:], weights[:1]], MAX_WEIGHT)
    terms[first[:-1][single]] = words[first[:-1][single]]
    votes[last] = 0  # a text's last word starts no pair
    votes[first[:-1][single]] = 1
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for at in range(0, len(words), VOTERS):
        part = slice(at, at + VOTERS)
        own = owner[part]
        bits = np.unpackbits(terms[part].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16)
        signed = (2 * bits - 1) * votes[part, None].astype(np.int16)
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sums[own[begin]] += np.add.reduceat(signed, begin, axis=0, dtype=np.int64)
    return sums


def fingerprint(text: Column) -> Column:
    """The fingerprint of a binary column, as a long."""

    @arrow_udf("long")
    def simhash(x: pa.Array) -> pa.Array:
        return pa.array(simhashes([t or b"" for t in x.to_pylist()]).view(np.int64), pa.int64())

    return simhash(text)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return (F.lit(64) - F.bit_count(a.bitwiseXOR(b))) / F.lit(64.0)


def _edited(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of bucket and document; each waits for the next, which a row marked ``_tail``
    may stand for."""
    held = None

    def out(done: list[tuple]) -> pa.RecordBatch:
        now = [t.encode() for _, t, _ in done]
        new = [e.encode() for _, _, (e, _) in done]
        own, edited, after = simhashes(now), simhashes(new), np.zeros(len(done), np.uint64)
        after[:-1] = own[1:]  # but where the next row belongs to another bucket
        other = [i for i, (_, _, (_, n)) in enumerate(done) if i + 1 == len(done) or n is not done[i + 1][1]]
        after[other] = simhashes([done[i][2][1].encode() for i in other])
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([d for d, _, _ in done], pa.int64()),
            "n_chars": pa.array([len(t) for _, t, _ in done], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in new], pa.string()),
            "own": pa.array(own.view(np.int64)), "edited": pa.array(edited.view(np.int64)), "after": pa.array(after.view(np.int64)),
        })

    for batch in rows:
        done, size = [], 0
        for bucket, tail, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            if held and held[0] == bucket and not held[1]:
                k = len(held[3]) // 4
                done.append((held[2], held[3], (held[3][: len(held[3]) - k] + text[:k], text)))
                size += len(held[3])
                if size > 4_000_000:
                    yield out(done)
                    done, size = [], 0
            held = (bucket, tail, doc, text)
        if done:
            yield out(done)


def fingerprints_with_next(docs: DataFrame, bucket_rows: int = 4000, max_buckets: int = 20_000) -> DataFrame:
    """For each document: n_chars, edited_sha256, and the fingerprints of its text (``own``), of its edited
    text (``edited``: the last quarter replaced by the next document's first characters) and of the next
    document's text (``after``).

    The documents are dealt into ranges of ids whose bounds are ids that occur, so the first document of a
    range is known by its id: it is sent along a second time, as the end of the range before. Each text
    moves once, and a task holds one text besides the batch it reads. The bounds, which go to every task, are at most
    ``max_buckets`` longs; beyond ``bucket_rows * max_buckets`` rows the ranges grow longer, which takes a task more time
    but no more memory, since it sorts on disk and reads row by row.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    k = int(min(max(1, n // bucket_rows, partitions(spark)), max_buckets, max(1, n)))
    found = ids.agg(
        F.min("doc_id").alias("low"),
        F.count_if(F.col("doc_id").isNull()).alias("nulls"),
        F.percentile_approx("doc_id", [i / k for i in range(1, k)] or [0.5], 10 * k).alias("cuts"),
    ).first()
    low = None if found["nulls"] else found["low"]
    cuts = sorted({c for c in (found["cuts"] or []) if c != low} if k > 1 else set())
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("_at", _place(F.col("doc_id"), cuts)) if cuts else docs.withColumn("_at", F.lit(0))
    bucket, starts = F.shiftright("_at", 1), F.col("_at").bitwiseAND(F.lit(1)) == 1
    copy = lambda to, tail: F.struct(to.cast("int").alias("_bucket"), F.lit(tail).alias("_tail"))
    also = F.when(F.col("doc_id").eqNullSafe(F.lit(low).cast("long")), F.array(copy(F.lit(len(cuts)), True))).when(starts, F.array(copy(bucket - 1, True)))
    sent = F.concat(F.array(copy(bucket, False)), F.coalesce(also, F.array().cast("array<struct<_bucket:int,_tail:boolean>>")))
    placed = docs.select(F.inline(sent), "doc_id", "text")
    return (
        placed.repartitionById(len(cuts) + 1, F.col("_bucket"))
        .sortWithinPartitions("_bucket", "_tail", F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(_edited, "doc_id long, n_chars long, edited_sha256 string, own long, edited long, after long")
    )


def _place(key: Column, cuts: list[int]) -> Column:
    """Twice the number of cuts that are at most the key, and one more if the key is a cut; by bisection."""
    table = np.array(cuts, np.int64)

    @arrow_udf("int")
    def search(x: pa.Array) -> pa.Array:
        ids = np.asarray(x.fill_null(np.iinfo(np.int64).min))
        n = np.searchsorted(table, ids, "right")
        return pa.array((2 * n + (table[np.maximum(n - 1, 0)] == ids)).astype(np.int32), pa.int32())

    return search(key)


def block_tables(radius: int, blocks: int | None = None) -> list[int]:
    """Masks of the tables: the fingerprint is cut into ``blocks`` blocks (``radius`` + 2 if not given), and
    each table keys on all blocks but ``radius`` of them. Two fingerprints within the radius differ in at
    most ``radius`` blocks, so some table gives both the same key."""
    m = blocks or radius + 2
    if not 0 <= radius < m <= 64:
        raise ValueError("blocks must outnumber the radius")
    edges = [64 * i // m for i in range(m + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, m - radius)]


def near_pairs(queries: DataFrame, base: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All (query, match, distance) of distinct fingerprints within ``radius`` bits, each once.

    ``queries`` and ``base`` have a column ``fingerprint`` (long; null ones match nothing). Equal
    fingerprints are one row here; join the documents back by fingerprint. A pair is given by the first
    table that holds it, so no further distinct is needed.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in block_tables(radius, blocks)]
    keys = F.posexplode(F.transform(F.lit(masks).cast("array<long>"), lambda m: F.col("f").bitwiseAND(m)))

    def table(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("fingerprint").alias("f")).where("f is not null").distinct()
        return one.select(keys.alias("table", "key"), F.col("f").alias(name))

    differ = F.col("query").bitwiseXOR(F.col("match"))
    earlier = F.exists(F.slice(F.lit(masks).cast("array<long>"), 1, F.col("table")), lambda m: differ.bitwiseAND(m) == 0)
    return (
        table(queries, "query")
        .join(table(base, "match"), ["table", "key"])
        .where((F.bit_count(differ) <= radius) & ~earlier)
        .select("query", "match", F.bit_count(differ).alias("distance"))
    )


def near_counts(marked: DataFrame, radius: int = 3) -> DataFrame:
    """``marked`` (a written table with ``own``, a fingerprint, and ``asked``) with ``near_fingerprints``: to how many
    other fingerprints of the table a row's fingerprint is near, by block tables; null for rows that are not asked."""
    asked, rest = marked.where("asked"), marked.where("not coalesce(asked, false)")
    pairs = near_pairs(asked.select(F.col("own").alias("fingerprint")), marked.select(F.col("own").alias("fingerprint")), radius)
    found = staged(pairs.where("distance > 0").groupBy(F.col("query").alias("own")).agg(F.count(F.lit(1)).alias("near_fingerprints")))
    counted = asked.join(small(found, found.count()), "own", "left").withColumn("near_fingerprints", F.coalesce("near_fingerprints", F.lit(0).cast("long")))
    return counted.unionByName(rest.withColumn("near_fingerprints", F.lit(None).cast("long"))).drop("asked")
