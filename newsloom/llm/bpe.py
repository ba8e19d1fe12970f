"""BPE encoding by a segment tree over adjacent pair ranks, and decoding.

For a vocabulary whose words end in a suffix and whose texts are lower-cased, with white space dropped.
Encoding one word: the leaves of the tree are the merge ranks of adjacent symbols, each inner node holds the
less of its two children (the left one if equal), so the root is the leftmost pair of lowest rank. A merge
changes three leaves and the nodes above them; it stops when no pair is left that has a rank. The trees of many words of like
length are the rows of one array and merge in step; a long word has a tree of its own.

Null and empty texts: no ids, and the decoded text is empty. Of equal ranks the leftmost pair is merged. Texts may be of any length,
as may words. Each row gives one row, also if it repeats an id or has none; an empty table gives an empty result. Further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Bytes that the words may take whose ids a task keeps; and about what an entry takes beside its text and its ids.
WORD_BYTES, ENTRY_BYTES = 160 << 20, 200
#: Bytes of a word up to which its tree is a row among others, and how many words merge in step.
ROW_BYTES, ROWS = 64, 1 << 14


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class MinTree:
    """Keys of adjacent pairs at the leaves; the least key of each span above. Keys order by rank, then
    position, so equal ranks give the leftmost."""

    def __init__(self, keys: list[int], none: int):
        self.size = 1 << max(0, len(keys) - 1).bit_length()
        self.node = [none] * self.size + keys + [none] * (self.size - len(keys))
        for i in range(self.size - 1, 0, -1):
            a, b = self.node[2 * i], self.node[2 * i + 1]
            self.node[i] = a if a <= b else b

    def set(self, at: int, key: int) -> None:
        node, i = self.node, at + self.size
        node[i] = key
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            least = a if a <= b else b
            if node[i] == least:
                return
            node[i] = least
            i >>= 1

    @property
    def root(self) -> int:
        return self.node[1]


class Bpe:
    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        # rank and result of each pair, by the pair's ids
        self.merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[self.ids[a] << 32 | self.ids[b]] = (rank, self.ids[a + b])
        pairs = sorted((pair, *found) for pair, found in self.merges.items())
        self.pairs, self.ranks = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([made for _, made in sorted(self.merges.values())], np.int64)
        self.symbols = byte_symbols()
        self.inner = [self.ids.get(s) for s in self.symbols]
        self.last = [self.ids.get(s + self.suffix) for s in self.symbols]
        # names by id, each with the space that parts it from the next
        self.spaced = pa.array([self.names[i] + " " if i in self.names else "" for i in range(max(self.names) + 1)], pa.large_string())
        # lines and special tokens in tabs (see ``_words``) stand apart from words
        self.split = regex.compile(r"\n|\t\d+\t|" + _pattern(spec["pre_tokenizer"]))
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        """Drop what is kept, as a task does at its end."""
        self.words: dict[str, int] = {"\n": 0}
        self.coded, self.held = pa.array([b""], pa.large_binary()), 0

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word."""
        data = word.encode()
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        none, shift = 1 << 62, n.bit_length()
        found = [merges.get(ids[i] << 32 | ids[i + 1]) for i in range(n - 1)]
        tree = MinTree([none if f is None else f[0] << shift | i for i, f in enumerate(found)], none)
        after, before, low = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << shift) - 1
        while (key := tree.root) != none:
            i = key & low
            j = after[i]
            k = after[j]
            ids[i] = found[i][1]
            ids[j] = -1
            after[i] = k
            if j < n - 1:
                tree.set(j, none)
            if k < n:
                before[k] = i
                f = found[i] = merges.get(ids[i] << 32 | ids[k])
                tree.set(i, none if f is None else f[0] << shift | i)
            else:
                tree.set(i, none)
            h = before[i]
            if h >= 0:
                f = found[h] = merges.get(ids[h] << 32 | ids[i])
                tree.set(h, none if f is None else f[0] << shift | h)
        return [x for x in ids if x >= 0]

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge ranks of pairs; past all ranks where a pair has none. Beyond a word's end the symbol is -1."""
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], len(self.made))

    def _in_step(self, sym: np.ndarray) -> np.ndarray:
        """The symbols of words, one in a row, merged in place; -1 where none is left. A row has a power of two of places, and one
        more that no word reaches. ``node`` holds a row's tree as ``MinTree`` does: node i above 2i and 2i + 1, leaves behind."""
        n, size = len(sym), sym.shape[1] - 1
        none, low = len(self.made) * size, size - 1
        place = np.arange(size)
        node = np.empty((n, 2 * size), np.int64)
        rank = self._ranked(sym[:, :-1], sym[:, 1:])
        node[:, size:] = np.where(rank < len(self.made), rank * size + place, none)
        half = size
        while half > 1:
            node[:, half // 2 : half] = np.minimum(node[:, half : 2 * half : 2], node[:, half + 1 : 2 * half : 2])
            half //= 2
        after, before = np.tile(np.arange(1, size + 2), (n, 1)), np.tile(np.arange(-1, size), (n, 1))
        tree, symbol, right, left = node.reshape(-1), sym.reshape(-1), after.reshape(-1), before.reshape(-1)
        row = np.arange(n)

        def put(row: np.ndarray, at: np.ndarray, key: np.ndarray | int) -> None:
            top, at = row * (2 * size), at + size
            tree[top + at] = key
            while at[0] > 1:
                at = at >> 1
                two = top + 2 * at
                tree[top + at] = np.minimum(tree[two], tree[two + 1])

        def pair(row: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            rank = self._ranked(a, b)
            put(row, at, np.where(rank < len(self.made), rank * size + at, none))

        while len(row := row[tree[row * (2 * size) + 1] < none]):
            key = tree[row * (2 * size) + 1]
            base, i, made = row * (size + 1), key & low, self.made[key // size]
            j = right[base + i]
            k = right[base + j]
            symbol[base + i], symbol[base + j] = made, -1
            right[base + i], left[base + k] = k, i
            put(row, j, none)
            pair(row, i, made, symbol[base + k])
            h = left[base + i]
            if len(some := np.flatnonzero(h >= 0)):
                pair(row[some], h[some], symbol[base[some] + h[some]], made[some])
        return sym

    def _learn(self, words: list[str]) -> None:
        """Have the ids of these words, none of which is kept yet, in the table."""
        texts = pa.array(words, pa.large_string())
        edge = np.frombuffer(texts.buffers()[1], np.int64)[: len(words) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        length = np.diff(edge)
        inner, last = (np.array([-1 if x is None else x for x in t], np.int64) for t in (self.inner, self.last))
        special = np.array([w[0] == "\t" for w in words])
        coded = [self.coded]

        def keep(at: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
            offsets = np.concatenate([[0], np.cumsum(count)]) * 4
            self.words.update(zip([words[i] for i in at], range(len(self.words), len(self.words) + len(at)), strict=True))
            coded.append(pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]))

        less = 0
        while less < ROW_BYTES:
            size = max(2, 2 * less)
            these = np.flatnonzero((length > less) & (length <= size) & ~special)
            for at in np.split(these, range(ROWS, len(these), ROWS)) if len(these) else ():
                place = np.arange(size + 1)
                here = place < length[at, None]
                byte = data[np.where(here, edge[at, None] + place, 0)]
                sym = np.where(here, np.where(place == length[at, None] - 1, last[byte], inner[byte]), -1)
                merged = self._in_step(sym)
                keep(at, merged[merged >= 0], (merged >= 0).sum(axis=1))
            less = size
        rest = np.flatnonzero((length > ROW_BYTES) | special)
        if len(rest):
            ids = [[int(words[i])] if special[i] else self.encode_word(words[i]) for i in rest]
            keep(rest, np.concatenate([np.array(x, np.int64) for x in ids]), np.array(list(map(len, ids))))
        self.coded = pa.concat_arrays(coded)
        self.held += int(edge[-1]) + len(words) * ENTRY_BYTES

    def _words(self, chunks: list[str]) -> np.ndarray:
        """Where the words of these runs, which have no white space of ASCII, stand in the table; the empty word 0 ends each run.
        A special token is its id in tabs."""
        lines = "\n".join([f"\t{self.special[c]}\t" if c in self.special else c for c in chunks]) + "\n"
        # lower-cased by single characters: a sigma at a word's end is one as others
        found = self.split.findall(unicodedata.normalize("NFC", lines).replace("Σ", "σ").lower())
        if self.held > WORD_BYTES:
            self.forget()
        if new := set(found).difference(self.words):
            self._learn(list(new))
        return np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """For each text all ids as little-endian unsigned 32-bit integers, and the decoded text with a space behind; the vocabulary has no
        decoder: names in order, a space between. Runs that repeat among the texts are looked at once."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.cut_special and pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pa.array([self.cut_special.sub(r" \1 ", t) if "<|" in t else t for t in texts.to_pylist()], pa.large_string())
        runs = pc.ascii_split_whitespace(texts)
        kinds = runs.flatten().dictionary_encode()
        at = self._words(kinds.dictionary.to_pylist())
        ids = _joined(self.coded.take(pa.array(at)), np.concatenate([[0], np.flatnonzero(at == 0) + 1]))
        edges = np.frombuffer(ids.buffers()[1], np.int64) // 4
        names = self.spaced.take(pa.array(np.frombuffer(ids.buffers()[2] or b"", "<u4")))
        bounds = runs.offsets.to_numpy()
        return tuple(_joined(x.take(kinds.indices), bounds) for x in (ids, _joined(names, edges)))


def _joined(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The values between each two bounds as one, without copying them."""
    edges = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(edges[bounds]), values.buffers()[2] or pa.py_buffer(b"")])


def _pattern(pre: dict) -> str:
    for p in pre.get("pretokenizers", [pre]):
        if p["type"] == "Split":
            return p["pattern"]["Regex"]
    raise ValueError("the tokenizer has no splitting expression")


def _views(values: pa.Array, less: int) -> Iterator[memoryview]:
    """The bytes of each value but the last ``less``."""
    edges, data = np.frombuffer(values.buffers()[1], np.int64).tolist(), memoryview(values.buffers()[2])
    return (data[i : max(i, j - less)] for i, j in zip(edges[:-1], edges[1:], strict=True))


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One for each worker process."""
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        coder.forget()
        for b in slices(batches):
            ids, said = coder.encode(b.column(1))
            n = np.diff(np.frombuffer(ids.buffers()[1], np.int64)) // 4
            digests = ([hashlib.sha256(x).hexdigest() for x in parts] for parts in (_views(ids, 0), _views(said, 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(d, pa.string()) for d in digests)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        coder.forget()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
