"""Many fixed texts looked for at once, and joins of texts by shared trigrams.

``found`` reads each text once through one automaton of all patterns (a trie with failure links), so its cost does not depend on how
many patterns there are. ``ends`` does so within groups. ``similar`` is an exact join at a threshold of trigram similarity, by tiles: at low thresholds the rarest grams that two sets
must share are most of their grams, so pairs that share one are nearly all pairs, and they are counted where they meet instead of being shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of one automaton; texts that travel together to the automata where there are several; rows of a side that is sent to every task.
AUTOMATON, TEXTS, BATCH = 20_000, 256, 1000
#: Bytes of the texts that meet an automaton in one task of ``ends``.
SLICE_BYTES = 4 << 20


def _automaton(patterns: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in patterns:
        if p:
            a.add_word(p, p)
    if len(a):
        a.make_automaton()
    return a


def _in(a: ahocorasick.Automaton, fields: list[str | None]) -> list[str]:
    if not len(a):
        return []
    return sorted({p for f in fields or () if f for _, p in a.iter(f)})


def found(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern), each once: the patterns (``pattern``) that occur in any of the ``fields`` of a text (id, fields). Empty patterns and null
    fields are in nothing. Up to ``AUTOMATON`` patterns are one automaton in every task; more are dealt into several, each of
    which reads every text."""
    kind = texts.schema["id"].dataType.simpleString()
    wanted = patterns.select("pattern").where("pattern <> ''").distinct()
    n = wanted.count()
    if n <= AUTOMATON:
        listed = sorted(r[0] for r in wanted.collect())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = _automaton(listed)
            for b in batches:
                hits = [_in(a, f) for f in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.list_(pa.string()))], ["id", "pattern"])

        return texts.select("id", "fields").mapInArrow(run, f"id {kind}, pattern array<string>").select("id", F.explode("pattern").alias("pattern"))
    parts = -(-n // AUTOMATON)
    dealt = wanted.groupBy(F.pmod(F.xxhash64("pattern"), F.lit(parts)).alias("part")).agg(F.collect_list("pattern").alias("patterns"))  # about AUTOMATON each

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                s = b.slice(i, TEXTS)
                yield pa.RecordBatch.from_arrays([pa.array([s.column(k).to_pylist()], pa.list_(s.column(k).type)) for k in (0, 1)], ["ids", "fields"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = a = None
        for b in batches:
            for r in b.to_pylist():
                if r["part"] != part:
                    part, a = r["part"], _automaton(r["patterns"])
                hits = [_in(a, f) for f in r["fields"]]
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], b.schema.field("ids").type.value_type), pa.array(hits, pa.list_(pa.string()))], ["id", "pattern"])

    packs = texts.select("id", "fields").mapInArrow(pack, f"ids array<{kind}>, fields array<array<string>>")
    met = packs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(dealt, "part")
    return met.mapInArrow(meet, f"id {kind}, pattern array<string>").select("id", F.explode("pattern").alias("pattern"))


def ends(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(group, pattern, least, most): of each of the ``n`` pairs ``wanted`` (group, pattern; distinct) the least and the greatest id of the texts (group, text, least, most) of its group
    that hold it; pairs that no text holds are left out. Groups are dealt into buckets of about ``AUTOMATON`` pairs. The pairs of a bucket are cut into parts of about that
    many and its texts into slices of about ``SLICE_BYTES``, so that no task holds a large group; every part meets every slice of its own bucket only."""
    kinds = {c: texts.schema[c].dataType.simpleString() for c in ("group", "least")}
    pairs = wanted.where("`group` is not null and pattern <> ''")
    rows = texts.where("`group` is not null and text is not null and least is not null")
    buckets = max(1, -(-n // AUTOMATON))
    bucket, cell = F.pmod(F.xxhash64("group"), F.lit(buckets)).alias("bucket"), ["bucket", "part", "slice"]
    parts = pairs.groupBy(bucket).agg(F.ceil(F.count(F.lit(1)) / AUTOMATON).alias("parts"))
    sizes = rows.groupBy(bucket).agg(F.ceil(F.greatest(F.sum(F.octet_length("text")), F.lit(1)) / SLICE_BYTES).alias("slices")).join(parts, "bucket")
    sizes = F.broadcast(sizes) if buckets <= BATCH else sizes
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = pairs.select(bucket, "group", "pattern").join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("pattern"), "parts").alias("part"), each("slices").alias("slice"), "group", "pattern")
    right = rows.select(bucket, "group", "text", "least", "most").join(sizes, "bucket")
    right = right.select("bucket", each("parts").alias("part"), F.pmod(F.xxhash64("text"), "slices").alias("slice"), "group", "text", "least", "most")

    def meet(named: pa.Table, read: pa.Table) -> pa.Table:
        asked = set(zip(named["group"].to_pylist(), named["pattern"].to_pylist(), strict=True))
        a, held = _automaton(sorted({p for _, p in asked})), {}
        for b in read.to_batches() if len(a) else ():
            for g, text, least, most in zip(*(b.column(c).to_pylist() for c in ("group", "text", "least", "most")), strict=True):
                for _, p in a.iter(text):
                    if (g, p) in asked:
                        x = held.get((g, p), (least, most))
                        held[g, p] = min(x[0], least), max(x[1], most)
        columns = zip(*((*k, *x) for k, x in held.items()), strict=True) if held else [()] * 4
        types = (*(named.schema.field(c).type for c in ("group", "pattern")), *(read.schema.field(c).type for c in ("least", "most")))
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["group", "pattern", "least", "most"])

    met = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, f"`group` {kinds['group']}, pattern string, least {kinds['least']}, most {kinds['least']}")
    return met.groupBy("group", "pattern").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def similar(left: DataFrame, right: DataFrame, least: float, keep: Column | None = None) -> DataFrame:
    """(left_id, right_id, similarity) of all pairs of sets (id, grams: distinct) with a similarity of ``least`` or more, which must be
    above 0. ``keep`` is a condition on left_id and right_id. Empty sets are like nothing."""
    if least <= 0:
        raise ValueError("a threshold above 0")
    from newsloom.operators.tiles import similar_sets

    alike = similar_sets(left, right, least)
    return alike if keep is None else alike.where(keep)
