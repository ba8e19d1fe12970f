"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A block is kept or left out. Its features are the tags, class names and ids of all elements around it, its text (words, share
of links, how it ends, its place in the page) and its neighbours' text; the chain has weights for going from label to label within
one element, between children of one element, and across. Weights are learned from labelled pages (html, text) by the likelihood of
whole pages, with forward and backward sums; a page is decoded by Viterbi.

A null or empty page, and one without a block that is kept, gives an empty text. Very long pages are read in linear time. Repeated
rows give repeated rows; null ids and urls are kept; further columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, Element, blocks
from .common import slices, small_batches
from .layouts import page

#: Labelled pages that a model is fitted on at most; rounds, step and penalty of the fit; a feature must occur on so many pages.
FIT_PAGES, ROUNDS, STEP, PENALTY, LEAST_PAGES = 1500, 100, 0.12, 0.3, 3
#: Invented pages that the standard model learns from.
LAYOUTS = 800

EDGES = 3  # ways from block to block: within an element, between children of one element, any other


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    moves: list[list[list[float]]]  # [way][label before][label]


def _size(n: int, steps: tuple[int, ...]) -> int:
    return sum(n >= s for s in steps)


def _kind(b: Block) -> tuple[int, int]:
    """Length and share of links of a block, in steps."""
    return _size(b.text.count(" ") + 1, (2, 5, 10, 25)), min(3, 4 * b.link_chars // max(1, len(b.text)))


def text_features(bs: list[Block]) -> list[list[str]]:
    """Features of each block's own text, of its place and of its neighbours' text."""
    kinds, out, n = [_kind(b) for b in bs], [], len(bs)
    for i, (b, (words, links)) in enumerate(zip(bs, kinds, strict=True)):
        f = ["bias", f"words {words}", f"links {links}", f"words {words} links {links}", f"place {4 * i // n}", f"titled {b.after_title}", f"ends {b.text[-1] if b.text[-1] in '.?!:…' else b.text[-1].isalnum()}"]
        if any(c in b.text for c in "©|·›"):
            f.append("marks")
        f.append(f"before {kinds[i - 1]}" if i else "first")
        f.append(f"after {kinds[i + 1]}" if i + 1 < n else "last")
        out.append(f)
    return out


def element_features(e: Element) -> list[str]:
    """Of the element that a block stands in: all names around it, and its own once more."""
    found = ["P" + f for f in e.own]
    while e:
        found += e.fresh
        e = e.up
    return found


def way(a: Element, b: Element) -> int:
    return 0 if a is b else 1 if a.up is b.up else 2


def labels(bs: list[Block], text: str) -> list[int] | None:
    """1 for the blocks that make up the text, in page order; none if the text is not made of blocks of the page."""
    want, at, out = text.split("\n\n") if text else [], 0, []
    for b in bs:
        hit = at < len(want) and b.text == want[at]
        out.append(int(hit))
        at += hit
    return out if at == len(want) else None


class Chains:
    """Pages as padded chains, for sums over all of them at once."""

    def __init__(self, pages: list[tuple[list[list[int]], list[int], list[int]]], n_features: int):
        self.n, self.most, self.n_features = len(pages), max(len(p[0]) for p in pages), n_features
        shape = (self.most, self.n)
        self.real, self.y, self.way = np.zeros(shape, bool), np.zeros(shape, int), np.zeros(shape, int)
        cell, feature = [], []
        for j, (fs, ways, ys) in enumerate(pages):
            self.real[: len(fs), j], self.y[: len(fs), j], self.way[: len(fs), j] = True, ys, ways
            for i, f in enumerate(fs):
                cell += [i * self.n + j] * len(f)
                feature += f
        self.cell, self.feature = np.array(cell), np.array(feature)

    def gradient(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Log-likelihood of all pages' labels, and its derivative by the weights of features and moves."""
        moves = w[self.n_features :].reshape(EDGES, 2, 2)
        score = np.zeros((self.most, self.n, 2))
        score[..., 1] = np.bincount(self.cell, w[self.feature], self.most * self.n).reshape(self.most, self.n)
        step = moves[self.way]  # [block, page, before, label]
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[0] = score[0]
        for t in range(1, self.most):
            new = np.logaddexp(ahead[t - 1, :, :1] + step[t, :, 0], ahead[t - 1, :, 1:] + step[t, :, 1]) + score[t]
            ahead[t] = np.where(self.real[t][:, None], new, ahead[t - 1])
        total = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
        for t in range(self.most - 2, -1, -1):
            later = score[t + 1] + back[t + 1]
            new = np.logaddexp(step[t + 1, :, :, 0] + later[:, :1], step[t + 1, :, :, 1] + later[:, 1:])
            back[t] = np.where(self.real[t + 1][:, None], new, back[t + 1])
        here = np.exp(ahead[..., 1] + back[..., 1] - total)
        slope = np.zeros_like(w)
        slope[: self.n_features] = np.bincount(self.feature, np.where(self.real, self.y - here, 0.0).ravel()[self.cell], self.n_features)
        later = score + back
        pair = np.exp(ahead[:-1, :, :, None] + step[1:] + later[1:, :, None, :] - total[:, None, None])
        pair[~self.real[1:]] = 0
        both = self.real[1:]
        seen = np.bincount((self.way[1:] * 4 + self.y[:-1] * 2 + self.y[1:])[both], minlength=EDGES * 4)
        slope[self.n_features :] = seen - np.concatenate([pair[both & (self.way[1:] == k)].sum(0).ravel() for k in range(EDGES)])
        gold = (score[..., 1] * self.y)[self.real].sum() + moves[self.way[1:], self.y[:-1], self.y[1:]][both].sum()
        return float(gold - total.sum()), slope


def learn(labelled: list[tuple[str, str]]) -> Model:
    """Weights that make the labels of the pages likely, under a quadratic penalty. Pages whose text is not made of their blocks teach nothing."""
    read = []
    for html, text in labelled:
        bs = blocks(html)
        ys = labels(bs, text or "") if bs else None
        if ys is not None:
            fs = [t + element_features(b.at) for t, b in zip(text_features(bs), bs, strict=True)]
            read.append((fs, [0, *(way(a.at, b.at) for a, b in zip(bs, bs[1:], strict=False))], ys))
    if not read:
        raise ValueError("no page whose text is made of its blocks: nothing to learn from")
    pages_with: dict[str, int] = {}
    for fs, _, _ in read:
        for f in {x for f in fs for x in f}:
            pages_with[f] = pages_with.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in pages_with.items() if n >= LEAST_PAGES))}
    chains = Chains([([[index[x] for x in f if x in index] for f in fs], ways, ys) for fs, ways, ys in read], len(index))
    w = np.zeros(len(index) + EDGES * 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, ROUNDS + 1):
        g = chains.gradient(w)[1] - PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += STEP * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model(dict(zip(index, w[: len(index)].tolist(), strict=True)), w[len(index) :].reshape(EDGES, 2, 2).tolist())


def fit(labelled: DataFrame, most: int = FIT_PAGES) -> Model:
    """A model from labelled pages (html, text), at most ``most`` of them, chosen by hash."""
    rows = labelled.where("html is not null").orderBy(F.xxhash64("html", "text"), "html").limit(most).select("html", "text").collect()
    return learn([tuple(r) for r in rows])


@functools.cache
def standard_model() -> Model:
    """Learned from the invented pages of ``layouts``; the same on every machine and for every table."""
    return learn([page(seed) for seed in range(LAYOUTS)])


def scores(model: Model, bs: list[Block]) -> list[float]:
    """What speaks for keeping each block, without the chain."""
    get = model.weights.get

    def around(e: Element) -> float:
        rise = []
        while e and e.score is None:
            rise.append(e)
            e = e.up
        total = e.score if e else 0.0
        for e in reversed(rise):
            total = e.score = total + sum(get(f, 0.0) for f in e.fresh)
        return total

    return [sum(get(f, 0.0) for f in t) + around(b.at) + sum(get("P" + f, 0.0) for f in b.at.own) for t, b in zip(text_features(bs), bs, strict=True)]


def viterbi(model: Model, bs: list[Block]) -> list[int]:
    """The likeliest labels of a page's blocks taken together; of equal ones the one that leaves out."""
    out, kept, came, last = 0.0, 0.0, [], None
    for i, (b, s) in enumerate(zip(bs, scores(model, bs), strict=True)):
        if i:
            (oo, ok), (ko, kk) = model.moves[way(last, b.at)]
            came.append((kept + ko > out + oo, kept + kk > out + ok))
            out, kept = max(out + oo, kept + ko), max(out + ok, kept + kk) + s
        else:
            kept = s
        last = b.at
    path = [int(kept > out)] if bs else []
    for c in reversed(came):
        path.append(int(c[path[-1]]))
    return path[::-1]


def main_text(model: Model, html: str | None) -> str:
    bs = blocks(html)
    return "\n\n".join(b.text for b, y in zip(bs, viterbi(model, bs), strict=True) if y)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, the main text and its length in code points, for every row of ``pages``."""
    schema = pages.select("page_id", "url").schema
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            text = pa.array([main_text(model, h.as_py()) for h in b.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), text], schema=out)

    read = small_batches(pages.select("page_id", "url", "html"))
    return read.mapInArrow(run, "page_id long, url string, text string").select(
        F.col("page_id").cast(schema["page_id"].dataType).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def extracted(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract(pages, standard_model())
