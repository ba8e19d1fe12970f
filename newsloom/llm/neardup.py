"""Near-duplicates by MinHash with tensored banding, every link confirmed on the full shingle sets.

A document's set holds its distinct runs of ``size`` words (A to Z lower-cased); with fewer words, the whole
sequence as one; without words it is empty and links with nothing.

1. Documents of one set are one class, known by its least doc_id; classes, not documents, are compared.
2. Tensored banding: two collections of ``HALVES`` half keys each are made from ``2 * HALVES * WIDTH``
   minhashes, and a table's key is a pair of half keys, one of each collection: ``HALVES ** 2`` tables for the
   minhashes of ``2 * HALVES`` bands. Two sets of similarity 0.8 miss all tables about once in 1,800.
3. In each bucket every class is proposed to the bucket's hub (a star, not all pairs): the class that shares
   most buckets with others, as the least changed text of a group does. Pairs that a packed sketch rules out are dropped, the others are compared on their full sets. The links' components are
   merged; where a bucket then still holds classes of different components, those cross pairs are proposed
   and confirmed too, so the star loses no component that all pairs of the bucket would have joined. Cross pairs
   meet on their rarest shingles (prefix and position filters), which drops no pair that has the similarity. The
   order of rarity is one for all classes that are left open, so each class's prefix is found once.
4. Components of the confirmed links are found by distributed star steps.

The sketch packs two bits of each of 32 minhashes; for a pair of similarity 0.8 or more it differs in more
than ``MAX_DIFFER`` of them less than once in 100,000.

Rows that repeat a doc_id are one document: their sets are linked. A row with a null id is linked with nothing;
its component is null and it is kept. Null and empty texts have no words: each is a component of its own. Texts may be of
any length: words are hashed in blocks. Equal texts always meet, as one class. An empty table gives an empty result.
Further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, small, small_batches, staged, text_bytes
from .components import components
from .wordhash import LOWER, groups, mix, shingles, word_hashes

SIZE, PERCENT = 5, 80
WIDTH, HALVES = 2, 8
MINHASHES = 2 * HALVES * WIDTH
MAX_DIFFER = 15
_factors = np.random.default_rng(2024).integers(0, 1 << 63, (2, MINHASHES), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def sets_of(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for group in groups(texts):
        words, _, first = word_hashes([t.translate(LOWER) for t in group])
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(shingles(words[a:b], size))


def minhashes(s: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, its upper 32 bits."""
    least = np.full(MINHASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 4096):
        h = s[None, at : at + 4096] * _factors[0][:, None]
        h ^= h >> np.uint64(32)
        h *= _factors[1][:, None]
        least = np.minimum(least, h.min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint64)


def half_keys(m: np.ndarray) -> np.ndarray:
    """The half keys of both collections, one of WIDTH minhashes each; a key's place is part of it."""
    h = np.arange(2 * HALVES, dtype=np.uint64)
    for column in m.reshape(2 * HALVES, WIDTH).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def sketch(m: np.ndarray) -> int:
    return int(np.bitwise_or.reduce((m & np.uint64(3)) << np.arange(0, 2 * MINHASHES, 2, dtype=np.uint64)).view(np.int64))


SIGNED = "doc_id long, n_shingles long, class_a long, class_b long, halves array<long>, sketch long"


def signed(docs: DataFrame, size: int) -> DataFrame:
    """Each document's set size, the 128-bit name of its set, its half keys and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for s in sets_of([t or b"" for t in b.column(1).to_pylist()], size):
                if len(s):
                    m = minhashes(s)
                    rows.append((len(s), *_name(s), half_keys(m), sketch(m)))
                else:
                    rows.append((0, None, None, None, None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_shingles", "class_a", "class_b", "halves", "sketch"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, SIGNED)


def _name(s: np.ndarray) -> list[int]:
    """The 128-bit name of a set, as two signed integers."""
    name = xxhash.xxh3_128_intdigest(s.tobytes())
    return np.array([name >> 64, name & (1 << 64) - 1], np.uint64).view(np.int64).tolist()


def _buckets(classes: DataFrame) -> DataFrame:
    """A row for each class and table: key, node, sketch, n."""
    a = F.explode(F.slice("halves", 1, HALVES)).alias("a")
    half = classes.select("node", "sketch", "n", F.slice("halves", HALVES + 1, HALVES).alias("second"), a)
    return half.select("node", "sketch", "n", "a", F.explode("second").alias("b")).select(F.xxhash64("a", "b").alias("key"), "node", "sketch", "n")


def _may_link(n: Column, sketch_n: Column, m: Column, sketch_m: Column, percent: int) -> Column:
    """What pairs of the wanted similarity nearly always fulfil: sizes within reach and like sketches."""
    x = sketch_n.bitwiseXOR(sketch_m)
    differ = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return (differ <= MAX_DIFFER) & (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """doc_id, set and the set's name for the documents that are needed; only their texts are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = list(sets_of([t or b"" for t in b.column(1).to_pylist()], size))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            names = pa.array([_name(s)[0] if len(s) else 0 for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), names], names=["doc_id", "set", "name"])

    needed = staged(needed)
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(small(needed, needed.count()), "doc_id", "left_semi")
    return staged(texts.mapInArrow(run, "doc_id long, set array<long>, name long"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the wanted similarity; ``a`` may stand in many pairs. Sides of both joins are
    plain shuffles, which Spark splits where a key is hot; so pairs that repeat an id's texts are left for later."""
    one, two = (sets.select(F.col("doc_id").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return staged(pairs.join(two, "b").join(one, "a").where((shared * 100 >= union * percent) & (shared > 0)).select("a", "b"))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Each set's rarest shingles with their places: as many as it could lack in a pair of the wanted similarity, and
    one. Two such sets share one of these. Shingles of one set alone come first; they only take up places."""
    s = sets.select(F.col("doc_id").alias("node"), "name", F.size("set").alias("n"), F.explode("set").alias("s"))
    df = staged(s.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    own = Window.partitionBy("node", "name")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "s")) - 1
    ranked = s.join(df, "s").withColumn("place", place)
    return ranked.where(F.col("place") * 100 <= F.col("n") * (100 - percent)).select("node", "n", "s", "place")


def _cross_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components under one hub that may have the similarity. They meet on their first
    shared shingle in order of rarity: what comes after it in both must be enough for the overlap."""
    prefix = staged(members.join(staged(_prefixes(sets, percent)), ["node", "n"]))
    p, q = prefix.where("not main").alias("p"), prefix.alias("q")
    left = F.least(F.col("p.n") - F.col("p.place"), F.col("q.n") - F.col("q.place"))
    enough = left * (100 + percent) >= (F.col("p.n") + F.col("q.n")) * percent
    once = F.col("q.main") | (F.col("p.node") < F.col("q.node"))
    new = (F.col("p.component") != F.col("q.component")) & (F.col("q.node") != F.col("q.hub"))
    like = _may_link(F.col("p.n"), F.col("p.sketch"), F.col("q.n"), F.col("q.sketch"), percent)
    j = p.join(q, (F.col("p.hub") == F.col("q.hub")) & (F.col("p.s") == F.col("q.s")) & new & once & enough & like)
    return j.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def _members(classes: DataFrame) -> DataFrame:
    """The classes of every bucket with more than one: key, node, sketch, n, and the bucket's hub with its sketch and size.
    What is joined by a bucket's key is a written table on either side, so Spark can split a hot bucket."""
    buckets = _buckets(classes)
    shared = staged(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    met = staged(buckets.join(shared, "key"))
    # the class that meets most others is the least changed text of its group; as the hub it links most of them at once
    score = met.groupBy("node").agg(F.sum("k").alias("score"))
    best = F.max(F.struct("score", (-F.col("node")).alias("m"), "sketch", "n")).alias("x")
    central = staged(met.join(score, "node").groupBy("key").agg(best))
    central = central.select("key", (-F.col("x.m")).alias("hub"), F.col("x.sketch").alias("hub_sketch"), F.col("x.n").alias("hub_n"))
    return staged(met.drop("k").join(central, "key"))


def _still_open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Of buckets that hold more than one component: hub, node, sketch, n, component, and whether that is the hub's."""
    placed = members.join(found, "node", "left").select("key", "hub", "node", "sketch", "n", F.coalesce("component", "node").alias("component"))
    placed = staged(placed)
    mixed = staged(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key"))
    open_ = placed.join(mixed, "key").select("hub", "node", "sketch", "n", "component").distinct()
    of_hub = staged(found.select(F.col("node").alias("hub"), F.col("component").alias("hub_component")))
    return staged(staged(open_).join(of_hub, "hub", "left").withColumn("main", F.col("component") == F.coalesce("hub_component", "hub")).drop("hub_component"))


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    every = staged(signed(docs, size))
    named = every.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("class_a", "class_b").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("halves", "sketch", "n_shingles"), "doc_id").alias("x"))
    classes = staged(classes.select("class_a", "class_b", "node", "x.halves", "x.sketch", F.col("x.n_shingles").alias("n")))

    members = _members(classes)
    like = _may_link(F.col("n"), F.col("sketch"), F.col("hub_n"), F.col("hub_sketch"), percent)
    first = staged(members.where((F.col("hub") != F.col("node")) & like).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    sets = _sets(docs, first.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), size)
    links = _confirmed(first, sets, percent)
    # rows that repeat an id with other texts tie their classes together, through the id itself
    name = F.xxhash64("class_a", "class_b")
    repeated = staged(every.where("doc_id is not null").groupBy("doc_id").agg(F.min(name).alias("low"), F.max(name).alias("high")).where("low <> high").select("doc_id"))
    ids = small(repeated, n_repeated := repeated.count())
    if n_repeated:
        tied = named.join(ids, "doc_id").join(classes.select("class_a", "class_b", "node"), ["class_a", "class_b"]).where("doc_id <> node")
        links = links.union(staged(tied.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()))
    merged = components(links)

    open_ = _still_open(members, merged)
    sets = _sets(docs, open_.select(F.col("node").alias("doc_id")).distinct(), size)
    more = _confirmed(staged(_cross_pairs(open_, sets, percent)), sets, percent)
    if not more.isEmpty():
        merged = components(merged.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))

    by_class = classes.join(merged, "node", "left").select("class_a", "class_b", F.coalesce("component", "node").alias("component_id"))
    linked = every.select("doc_id", "n_shingles", "class_a", "class_b").join(by_class, ["class_a", "class_b"], "left")
    if n_repeated:  # a row without shingles goes where its id's other rows are
        of_id = ids.join(merged, F.col("doc_id") == F.col("node")).select("doc_id", "component")
        linked = linked.join(of_id, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "component")).drop("component")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
