"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart, one on ordinary and one on toxic text, and used apart. Every short window of
a text is compressed with either. What the toxic dictionary saves against the ordinary one is the window's gain,
counted from one byte on; a window that it can't shorten has none, so the ordinary dictionary is asked only about the
others. It shortens no window without a run of ``MATCH`` bytes that occurs in the dictionary (a frame costs more than a
shorter match saves), so those are passed over: an index of the dictionary's runs finds the rest. A document is described by its greatest gains and by how many of its windows, and which share, reach each threshold
of ``THRESHOLDS``. A logistic curve, fitted on labelled documents that the dictionaries were not trained on, calibrates what
each threshold counts for; its value is the score.

The dictionaries are loaded as what training made them, entropy tables included. The toxic dictionary is trained on the
passages of toxic documents that ordinary documents hardly have, the ordinary one on windows of ordinary documents.

The model is fitted on a bounded sample: at most ``SAMPLE`` documents of each class, of any length, by a hash of
their ids. Every third of them by length is kept back, and the curve is fitted on these documents whole. The
dictionaries are trained on the others: whole as far as ``TRAIN_BYTES`` a class allow, else on pieces of the longest
ones, chosen by hash; the ordinary one on at most ``ORDINARY_WINDOWS`` stretches of 64 bytes of these.

Scores cover whole texts of any length, a window at a time, and depend on the text alone: equal texts and repeated rows have
equal scores. A null or empty text is scored as one empty window. Without labelled documents of both classes nothing can
be fitted: every score is 0, ``fitted`` is false, and a warning is given. Rows of ``labels`` with a null id or a label other
than 0 and 1 are not used; a document labelled twice is toxic if any row says so. Empty tables give an empty result. Further
columns of either table, whatever their names, are not read.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small, small_batches, staged, text_bytes
from .wordhash import powers

SAMPLE, TRAIN_BYTES, PIECE = 1200, 6 << 20, 4096
#: Stretches of 64 bytes of the ordinary pieces that the ordinary dictionary is trained on at most, drawn evenly.
ORDINARY_WINDOWS = 30_000
#: A window holds a word or two: in a longer one the chance content of the two dictionaries outweighs a toxic word.
WINDOW, STEP = 11, 2
GRAM, MARGIN = 6, 4
ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 16384, 8192, 9
#: Bytes gained on a window.
THRESHOLDS = (1, 2, 3, 4)
#: Bytes of a frame around a window that is stored as it is: magic number, header, block header.
FRAME = 9
#: Bytes that must follow one another in the dictionary for a window to be shortened.
MATCH = 8
#: Window starts that are looked at together.
BLOCK = 1 << 20
#: Held out of all fitting: documents whose id's checksum leaves no rest.
FOLDS = 5


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the last is the constant

    def measures(self) -> Measures:
        import zstandard as z

        def of(content: bytes):
            return z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False).compress

        known = np.zeros(1 << HASH_BITS, bool)
        known[_run_hashes(self.toxic)] = True
        return Measures(of(self.ordinary), of(self.toxic), known)


@dataclass(frozen=True)
class Measures:
    ordinary: Callable[[bytes], bytes]
    toxic: Callable[[bytes], bytes]
    known: np.ndarray  # hashes of the toxic dictionary's runs of MATCH bytes


HASH_BITS = 18


def _run_hashes(text: bytes) -> np.ndarray:
    """A hash of the MATCH bytes from each place on."""
    if len(text) < MATCH:
        return np.zeros(0, np.int64)
    runs = np.ndarray(len(text) - MATCH + 1, "<u8", text, strides=(1,))
    return (runs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def gains(text: bytes, m: Measures) -> tuple[np.ndarray, int]:
    """The gains of the windows that have one, and how many windows there are."""
    found = []
    n = max(1, -(-(len(text) - WINDOW + STEP) // STEP))
    for at in range(0, n * STEP, BLOCK):
        part = text[at : at + BLOCK + WINDOW - STEP]
        hit = np.zeros(len(part) + WINDOW, bool)
        hit[: max(0, len(part) - MATCH + 1)] = m.known[_run_hashes(part)]
        first = np.flatnonzero(np.logical_or.reduce([hit[j : j + min(len(part), BLOCK) : STEP] for j in range(WINDOW - MATCH + 1)]))
        for i in (first * STEP).tolist():
            w = part[i : i + WINDOW]
            short = len(m.toxic(w))
            if at + i < n * STEP and short < len(w) + FRAME and (gain := len(m.ordinary(w)) - short) > 0:
                found.append(gain)
    return np.array(found, np.int64), n


def features(gain: np.ndarray, n: int) -> list[float]:
    top = np.sort(np.r_[gain, 0, 0, 0])[-3:]
    reach = [int((gain >= k).sum()) for k in THRESHOLDS]
    return [float(top[-1]), float(top.mean()), gain.sum() / n, *(r / n for r in reach), *(float(np.log1p(r)) for r in reach), float(np.log(n))]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % FOLDS == 0


def _grams(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte grams and in how many different contexts each occurs; copied passages count once."""
    found = []
    for at in range(0, len(docs), 64):
        buf = np.frombuffer(b"\0".join(docs[at : at + 64]), np.uint8).astype(np.uint64)
        size = GRAM + 2 * MARGIN
        if len(buf) < size:
            continue
        up, down = powers(len(buf))
        run = np.r_[np.uint64(0), np.cumsum((buf + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)]
        n = len(buf) - size + 1
        context = (run[size:] - run[:-size]) * down[:n]
        gram = sum(buf[MARGIN + j : MARGIN + j + n] << np.uint64(8 * j) for j in range(GRAM))
        found.append(np.unique(np.stack([context, gram], 1), axis=0))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every = np.concatenate(found)
    _, first = np.unique(every[:, 0], return_index=True)
    return np.unique(every[first, 1], return_counts=True)


def marked_segments(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The parts of toxic texts made of grams that toxic text has far more often than ordinary text."""
    grams, n = _grams(toxic)
    others, m = _grams(ordinary)
    at = np.searchsorted(others, grams)
    at[at == len(others)] = 0
    known = np.where((others[at] == grams) if len(others) else False, m[at] if len(others) else 0, 0)
    ratio = sum(map(len, toxic)) / max(1, sum(map(len, ordinary)))
    marks = np.sort(grams[(n >= max(4, len(toxic) // 70)) & (n > 8 * ratio * (known + 0.5))])
    out = []
    for text in toxic:
        buf = np.frombuffer(text, np.uint8).astype(np.uint64)
        if len(buf) < GRAM or not len(marks):
            continue
        gram = sum(buf[j : len(buf) - GRAM + 1 + j] << np.uint64(8 * j) for j in range(GRAM))
        i = np.minimum(np.searchsorted(marks, gram), len(marks) - 1)
        hit = np.zeros(len(buf) + 2, bool)
        for k in np.flatnonzero(marks[i] == gram):
            hit[k + 1 : k + 1 + GRAM] = True
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        out += [text[max(0, a - 2) : b + 2] for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return out


def _samples(text: bytes, size: int = 64) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; their end itself where they are too few to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples).as_bytes()
    except z.ZstdError:
        return b" ".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the last coefficient is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(keep)
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - keep * w)
    return w


def _most_pieces(sizes: list[int], total: int) -> int:
    """How many pieces a text may give so that all texts together give about ``total`` bytes; short ones leave theirs to longer ones."""
    left = total
    for i, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if size > share:
            return max(1, share // PIECE)
        left -= size
    return max(1, -(-max(sizes, default=0) // PIECE))


def _pieces(text: bytes, most: int) -> list[bytes]:
    """A text cut into pieces; of more than ``most``, those of the least hashes."""
    key, starts = zlib.crc32(text), range(0, len(text), PIECE)
    chosen = sorted(starts, key=lambda i: (zlib.crc32(b"%d" % i, key), i))[:most]
    return [text[i : i + PIECE] for i in sorted(chosen)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, train_bytes: int = TRAIN_BYTES, ordinary_windows: int = ORDINARY_WINDOWS) -> Model | None:
    """Fit on labelled documents that are not held out; none, with a warning, without documents of both classes."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).where(F.octet_length("text") > 0)
    # only labels of documents that are there count, and only they are chosen from
    present = staged(texts.select("doc_id").join(small(known, known.count()), "doc_id").distinct())
    counted = {r["toxic"]: r["n"] for r in present.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [present.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * sample rows
    drawn = staged(texts.join(ids, "doc_id").select("toxic", "text", F.sha2("text", 256).alias("key")))
    listed = drawn.select("toxic", "key", F.octet_length("text").alias("size")).distinct().collect()
    ranked = {k: sorted((r["size"], r["key"]) for r in listed if r["toxic"] == k) for k in (0, 1)}
    if min(map(len, ranked.values())) < 2:
        warnings.warn("no labelled documents of both classes: toxicity is not fitted, all scores are 0", stacklevel=2)
        return None
    train = {k: [x for i, x in enumerate(v) if i % 3 != 1] for k, v in ranked.items()}
    most = {k: _most_pieces([size for size, _ in v], train_bytes) for k, v in train.items()}
    trained = {(k, key) for k, v in train.items() for _, key in v}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            out = [(k, key, i, p) for k, t, key in rows if (k, key) in trained for i, p in enumerate(_pieces(t, most[k]))]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["toxic", "key", "i", "piece"])

    # an order by digest, without relation to the text; copies of a text count once
    pieces = sorted({(r["key"], r["i"], bytes(r["piece"]), r["toxic"]) for r in drawn.mapInArrow(cut, "toxic int, key string, i int, piece binary").collect()})
    parts = {k: [p for _, _, p, label in pieces if label == k] for k in (0, 1)}
    segments = marked_segments(parts[1], parts[0]) or [w for t in parts[1] for w in _samples(t)]  # if nothing tells them apart
    plain = [w for t in parts[0] for w in _samples(t)]
    plain = [plain[i] for i in np.random.default_rng(12).permutation(len(plain))[:ordinary_windows]]
    toxic = [b" ".join(segments[i : i + 4]) for i in range(0, len(segments), 4)]
    model = Model(_trained(ORDINARY_BYTES, plain), _trained(TOXIC_BYTES, toxic), (), (), ())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.measures()
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            out = [(k, key, features(*gains(t, m))) for k, t, key in rows if (k, key) not in trained]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.list_(pa.float64())), strict=True)], names=["toxic", "key", "x"])

    rest = sorted({(r["toxic"], r["key"], tuple(r["x"])) for r in drawn.mapInArrow(measure, "toxic int, key string, x array<double>").collect()})
    x = np.array([v for _, _, v in rest])
    y = np.array([k for k, _, _ in rest], float)
    share = counted.get(1, 0) / max(1, sum(counted.values()))
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    w = _logistic((x - mean) / scale, y, weight)
    return Model(model.ordinary, model.toxic, tuple(mean), tuple(scale), tuple(w))


_ready: dict[Model, Measures] = {}


def score(text: bytes, model: Model) -> float:
    if model not in _ready:
        _ready.clear()
        _ready[model] = model.measures()
    x = (np.array(features(*gains(text, _ready[model]))) - model.mean) / model.scale
    return float(1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30))))


def scorer(model: Model | None):
    """A column function of a binary text: its score from 0 to 1."""

    @F.arrow_udf("double")
    def scores(text: pa.Array) -> pa.Array:
        return pa.array([score(t or b"", model) if model else 0.0 for t in text.to_pylist()], pa.float64())

    return scores


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and fitted for every document."""
    model = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            s = [score(t or b"", model) if model else 0.0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array([model is not None] * len(s))],
                names=["doc_id", "held_out", "score", "predicted", "fitted"],
            )

    return (
        small_batches(docs)
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), text_bytes().alias("text"))
        .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, fitted boolean")
    )
