"""Quality rules as a short-circuit cascade.

Counts over words, lines and symbols are taken from the whole text. The rules then reject texts one after the
other: what one rule rejects, later ones don't see. The order is chosen from a bounded sample: each rule's
time a text and its share of rejections are measured, and rules run by rejection per cost, highest first. A
text is kept if no rule rejects it, so the order changes the time taken and never the verdict.

A null or empty text has no words; it fails the base rule. Texts may be of any length. Equal texts, and rows that repeat an id,
have equal counts and verdicts, one row each; null ids are kept as they are. An empty table gives an empty result. Rules with equal
rates, and those that the sample says nothing of, run in the given order. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import slices, small_batches, text_bytes
from .wordhash import IS_SPACE, groups, mix, shingles, word_hashes

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"


@dataclass
class Text:
    """A text as the rules see it; what several rules need is worked out once, when first asked for."""

    data: bytes
    words: np.ndarray
    made: dict = field(default_factory=dict)

    def once(self, name: str, f: Callable[[], object]) -> object:
        if name not in self.made:
            self.made[name] = f()
        return self.made[name]

    @property
    def bytes_(self) -> np.ndarray:
        return self.once("bytes", lambda: np.frombuffer(self.data, np.uint8))

    @property
    def counts(self) -> np.ndarray:
        return self.once("counts", lambda: np.bincount(self.bytes_, minlength=256))

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        return int(self.counts[:0x80].sum() + self.counts[0xC0:].sum() - self.counts[IS_SPACE].sum())

    @property
    def n_symbols(self) -> int:
        return int(self.counts[list(SYMBOLS)].sum())

    @property
    def n_dup_lines(self) -> int:
        """Lines that hold a word and equal an earlier line."""

        def count() -> int:
            lines = [x for x in self.data.split(b"\n") if x.strip(b" \t\n\v\f\r")]
            return len(lines) - len(set(lines))

        return self.once("dup", count)

    @property
    def n_repeat_words(self) -> int:
        """Words in 8-word windows that occur twice or more."""

        def count() -> int:
            if len(self.words) <= WINDOW:
                return 0
            h = shingles(self.words, WINDOW)
            order = np.sort(h)
            twice = order[1:][order[1:] == order[:-1]]
            if not len(twice):
                return 0
            at = np.flatnonzero(np.isin(h, twice))
            edge = np.zeros(len(self.words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            return int((np.cumsum(edge)[:-1] > 0).sum())

        return self.once("repeat", count)

    @property
    def n_runs(self) -> int:
        """Words equal to the word before."""
        return self.once("runs", lambda: int((self.words[1:] == self.words[:-1]).sum()))

    @property
    def upper_share(self) -> float:
        """The share of capitals among ASCII letters."""
        up, low = self.counts[65:91].sum(), self.counts[97:123].sum()
        return float(up / max(1, up + low))


def too_few_words(t: Text) -> bool:
    return t.n_words < MIN_WORDS


def repeated_windows(t: Text) -> bool:
    return 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words


def symbol_heavy(t: Text) -> bool:
    """More than three symbols for ten words: markup remains, tables, noise."""
    return 10 * t.n_symbols > 3 * t.n_words


def exclamatory(t: Text) -> bool:
    """More than three exclamation marks for ten words."""
    return 10 * int(t.counts[33]) > 3 * t.n_words


def shouting(t: Text) -> bool:
    """Over half of the letters are capitals, in a text of some length."""
    return t.n_words >= MIN_WORDS and t.upper_share > 0.5


def stuttering(t: Text) -> bool:
    """Over three words of ten repeat the word before."""
    return 10 * t.n_runs > 3 * t.n_words


BASE: tuple[Callable[[Text], bool], ...] = (too_few_words, repeated_windows)
RULES: tuple[Callable[[Text], bool], ...] = (*BASE, symbol_heavy, exclamatory, shouting, stuttering)


def texts_of(batch: list[bytes]) -> Iterator[Text]:
    for group in groups(batch):
        words, _, first = word_hashes(group)
        words = mix(words)
        for i, data in enumerate(group):
            yield Text(data, words[first[i] : first[i + 1]])


def measure(docs: DataFrame, rules: tuple = RULES, sample_rows: int = 2000, seed: int = 7) -> list[Row]:
    """Each rule's seconds, rejections and texts over a sample of about ``sample_rows`` documents; the sample
    sets only the order. The figures are summed in the tasks: one row for each rule comes back."""
    n = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took, hits, seen = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for b in slices(batches, 0):
            for data, words in ((t.data, t.words) for t in texts_of([x or b"" for x in b.column(0).to_pylist()])):
                seen += 1
                for i, rule in enumerate(rules):
                    t = Text(data, words)  # each pays for what it needs
                    at = time.perf_counter()
                    hits[i] += rule(t)
                    took[i] += time.perf_counter() - at
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "seconds": took, "rejected": hits, "texts": [seen] * len(rules)})

    sample = small_batches(docs).select(text_bytes().alias("text")).sample(min(1.0, sample_rows / max(1, n)), seed=seed)
    return sample.mapInArrow(run, "rule long, seconds double, rejected long, texts long").groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("seconds", "rejected", "texts"))).collect()


def ordered(measured: list[Row], rules: tuple = RULES) -> list[Callable[[Text], bool]]:
    """Rules by rejections per second, highest first; ties and rules not measured keep the given order."""
    rate = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in measured}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-rate.get(i, 0.0), i))]


def passes(t: Text, cascade: list[Callable[[Text], bool]]) -> bool:
    return not any(rule(t) for rule in cascade)


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality(docs: DataFrame, rules: tuple = RULES, sample_rows: int = 2000) -> DataFrame:
    """The counts and the verdict for every document."""
    cascade = ordered(measure(docs, rules, sample_rows), rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for t in texts_of([x or b"" for x in b.column(1).to_pylist()]):
                failed = any(rule(t) for rule in BASE)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and passes(t, cascade)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:])],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(judge, COLUMNS)


def keeper(docs: DataFrame, rules: tuple = RULES, sample_rows: int = 2000):
    """A column function of a binary text: whether the cascade keeps it, each rule run only on what the ones
    before it have passed."""
    cascade = ordered(measure(docs, rules, sample_rows), rules)

    @F.arrow_udf("boolean")
    def keep(text: pa.Array) -> pa.Array:
        return pa.array([passes(t, cascade) for t in texts_of([x or b"" for x in text.to_pylist()])], pa.bool_())

    return keep
