"""Languages by the ranks of their most frequent character trigrams.

A profile holds the ranks of a language's first trigrams, counted over the texts known to be in it. A text is in the language to whose ranks
its own are nearest: the sum over its trigrams of how far the ranks are apart, and the length of a profile where one is missing.
Sums are whole numbers, so the answer does not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Trigrams of a profile; fixed values: characters that are read, and below which the answer is the default.
PROFILE, READ, LEAST, DEFAULT_CODE = 300, 5000, 50, "tr"
#: Rows of profiles that go to every task at most; texts whose trigrams are counted together.
KNOWN, TEXTS = 300_000, 64


def letter_grams(text: Column) -> Column:
    """Trigrams of the words of a text's beginning, each word between two spaces; with repetitions."""
    w = F.filter(F.split(F.lower(F.substring(text, 1, READ)), r"[^\p{L}]+"), lambda x: x != "")
    return F.flatten(F.transform(w, lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(F.concat(F.lit(" "), x, F.lit(" ")), i, F.lit(3)))))


def letters(text: Column) -> Column:
    """A text's beginning in lower case with one space for whatever is no letter."""
    return F.regexp_replace(F.lower(F.substring(text, 1, READ)), r"[^\p{L}]+", " ")


def _keys(letters: str) -> np.ndarray:
    """The trigrams of ``letter_grams`` as numbers, which sort as the trigrams do."""
    c = np.frombuffer(f" {letters.strip(' ')} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    return (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[c[1:-1] != 32]


def _gram(key: int) -> str:
    return "".join(chr(key >> s & (1 << 21) - 1) for s in (42, 21, 0))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of some texts of a language at a time."""
    for b in batches:
        held: dict[str, list[np.ndarray]] = {}
        for i, (lang, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if text:
                held.setdefault(lang, []).append(_keys(text))
            if i % TEXTS == TEXTS - 1 or i == b.num_rows - 1:
                for name, keys in held.items():
                    k, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array([_gram(x) for x in k.tolist()], pa.string()), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
                held = {}


def _ranked(texts: DataFrame, by: str, text: str, most: int) -> DataFrame:
    counts = texts.select(by, F.explode(letter_grams(F.col(text))).alias("gram")).groupBy(by, "gram").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", place).where(F.col("rank") <= most).select(by, "gram", "rank")


def profiles(texts: DataFrame, lang: str = "lang", text: str = "text", most: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of all ``texts`` whose language is known."""
    known = texts.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), letters(F.col(text)).alias("letters"))
    counts = known.mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", place).where(F.col("rank") <= most).select("lang", "gram", "rank")


def _nearest(known: list[tuple[str, str, int]], most: int, schema: list[str]):
    """From (id, letters) to (id, lang, distance, next), text by text: a text's trigrams are counted and ranked where it is read."""
    langs, code = sorted({r[0] for r in known}), lambda g: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])
    grams = np.array(sorted({code(g) for _, g, _ in known}), np.int64)
    place = np.zeros((len(grams), len(langs)), np.int64)
    for lang, g, r in known:
        place[np.searchsorted(grams, code(g)), langs.index(lang)] = r

    def near(text: str | None) -> tuple:
        if not text or not len(grams):
            return None, None, None
        k, n = np.unique(_keys(text), return_counts=True)
        k = k[np.argsort(-n, kind="stable")[:most]]
        at = np.minimum(np.searchsorted(grams, k), len(grams) - 1)
        hit = grams[at] == k
        ranks = place[at[hit]]
        there = ranks > 0
        gain = np.where(there, np.abs(np.flatnonzero(hit)[:, None] + 1 - ranks) - most, 0).sum(0) + len(k) * most
        first = sorted((int(gain[i]), langs[i]) for i in np.flatnonzero(there.any(0)))
        if not first:
            return None, None, None
        return first[0][1], first[0][0], first[1][0] if len(first) > 1 else len(k) * most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [near(t) for t in b.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], schema)

    return run


def detect(texts: DataFrame, known: DataFrame, id: str = "id", text: str = "text", most: int = PROFILE) -> DataFrame:
    """(id, code, distance, confidence): ``known`` has profiles, a table of ``most`` rows for each language. Texts shorter than ``LEAST``
    characters, and null ones, are ``DEFAULT_CODE`` with confidence 0. Ties go to the first code. Confidence is how much nearer the language is than the next."""
    names, kind = ["id", "lang", "distance", "next"], texts.schema[id].dataType.simpleString()
    if known.count() > KNOWN:
        return _by_joins(texts, known, id, text, most)
    # rows that repeat an id are one text
    repeated = texts.groupBy(F.col(id)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id)
    again, told = not repeated.isEmpty(), [tuple(r) for r in known.select("lang", "gram", "rank").collect()]
    once = texts.join(repeated, id, "left_anti") if again else texts
    own = once.select(F.col(id).alias("id"), F.when((F.length(text) >= LEAST) & F.col(id).isNotNull(), letters(F.col(text))).alias("letters"))
    near = own.mapInArrow(_nearest(told, most, names), f"id {kind}, lang string, distance long, next long")
    out = near.withColumn("confidence", F.round(1 - F.try_divide(F.col("distance"), F.col("next")), 6))
    out = out.select("id", F.coalesce("lang", F.lit(DEFAULT_CODE)).alias("code"), "distance", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return out.unionByName(_by_joins(texts.join(repeated, id, "left_semi"), known, id, text, most)) if again else out


def _by_joins(texts: DataFrame, known: DataFrame, id: str, text: str, most: int) -> DataFrame:
    """The same by joins, for many languages, or texts in several rows."""
    long = F.length(F.coalesce(text, F.lit(""))) >= LEAST
    own = _ranked(texts.where(long).select(F.col(id).alias("id"), F.col(text).alias("_text")), "id", "_text", most).withColumnRenamed("rank", "own")
    n = own.groupBy("id").agg(F.count(F.lit(1)).alias("grams"))
    met = own.join(known, "gram").groupBy("id", "lang").agg(F.sum(F.abs(F.col("own") - F.col("rank")) - most).alias("gain"))
    # a language that shares no gram lies as far as all grams missing
    far = met.join(n, "id").select("id", "lang", (F.col("gain") + F.col("grams") * most).alias("distance"), (F.col("grams") * most).alias("farthest"))
    by = Window.partitionBy("id").orderBy("distance", "lang")
    best = far.withColumn("i", F.row_number().over(by)).withColumn("next", F.coalesce(F.lead("distance").over(by), F.col("farthest"))).where("i = 1")
    found = best.select(F.col("id").alias("_id"), "lang", "distance", F.coalesce(F.round(1 - F.try_divide(F.col("distance"), F.col("next")), 6), F.lit(0.0)).alias("confidence"))
    out = texts.select(F.col(id).alias("id")).join(found, F.col("id") == F.col("_id"), "left")
    return out.select("id", F.coalesce("lang", F.lit(DEFAULT_CODE)).alias("code"), "distance", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
