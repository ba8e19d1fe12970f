"""Packing documents into fixed-size token sequences: shortest-pack-first over the length histogram.

1. Every document is encoded once, ended by token 0, and cut into pieces of ``capacity`` tokens and one or two for the rest.
   Only the pieces' sizes and checksums are kept (staged), never the ids.
2. The histogram of piece lengths, at most ``capacity`` rows however large the corpus, goes to the driver.
   There, lengths are placed longest first. The pieces of a length go to the shortest open packs that have
   room for them; packs of one composition are one pattern with a count, split when only some of its packs
   get a piece. The number of patterns depends on the capacity, not on the corpus.
3. The patterns are joined back by rank: the pieces of a length are numbered without gaps, and the pattern
   table says which numbers fill which place of which pattern.

Null and empty texts: their document is the end token alone. Rows that repeat an id are packed like others, each once; null ids are
kept. A text of any length is cut into pieces; its ids are held while it is cut. Pieces of equal length are ordered by id, start and
checksum; those that agree in all three are alike. An empty table gives an empty result. Further columns, whatever their names, are
not read. The file must split as ``SPLIT`` does (a byte-level step with its own expression); any other file is refused.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, slices, small_batches, staged

CAPACITY = 1024
#: Bytes that the distinct chunks of text (a word and its punctuation) whose ids a worker keeps may take, in each of two
#: generations, and about what an entry takes beside its text and its ids.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 180
#: Fixed value: the published splitting expression of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def check_split(spec: dict) -> None:
    """An error if a tokenizer file changes or splits texts in another way than ``SPLIT`` does."""
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("the tokenizer file does not split as the byte-level expression does")


class ChunkEncoder:
    """Ids of whole texts by a byte-level BPE file of the ``tokenizers`` library, through a cache of chunks.

    The tokenizer's expression never joins a character that isn't white space to white space after it. A text
    may so be cut wherever a space follows such a character; the ids of the chunks, one after the other, are
    the text's ids. Chunks repeat, as words do: each is encoded once while it stays in the cache. New chunks go
    through ``tiktoken`` with the file's own vocabulary, which gives the same ids in a third of the time; chunks
    that may hold a special token's name go through ``tokenizers``, which knows those.
    """

    #: Where a space follows a character that is surely no white space (Python's class is the wider one).
    CUT = re.compile(r"(?<=\S)(?= )")
    UNSAFE = re.compile(r"\s ")

    def __init__(self, path: str):
        import tiktoken

        from .bpe import byte_symbols

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_split(spec)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.encode_chunk = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.forget()

    def forget(self) -> None:
        """Drop the cache, as a task does at its end: a worker that goes on to other work keeps the vocabulary only."""
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_padding()
        t.no_truncation()
        return t

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if any(t in text for t in self.special):
            return [text]  # a special token may stand anywhere, also within a chunk
        if text[0] != " " and "\0" not in text and not self.UNSAFE.search(text):
            return text.replace(" ", "\0 ").split("\0")
        return self.CUT.split(text)

    def ids(self, chunk: str) -> bytes:
        if any(t in chunk for t in self.special):
            found = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        else:
            found = self.encode_chunk(chunk)
        return struct.pack(f"<{len(found)}I", *found)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and size < 2_000_000:
                cut.append(self.chunks(texts[at]))
                size += len(texts[at])
                at += 1
            if self.held > CACHE_BYTES:
                self.known, self.older, self.held = {}, self.known, 0
            known, older = self.known, self.older
            for c in set().union(*cut).difference(known):
                ids = known[c] = older.get(c) or self.ids(c)
                self.held += len(c) + len(ids) + ENTRY_BYTES
            for chunks in cut:
                yield b"".join(map(known.__getitem__, chunks))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Where a document of n tokens is cut: whole sequences, then half a one if the rest is longer than that. A
    rest over half the capacity could share its sequence with few others, which costs padding."""
    ends = [*range(capacity, n + 1, capacity)]
    at = ends[-1] if ends else 0
    if n - at > capacity // 2:
        ends.append(at + capacity // 2)
    if not ends or ends[-1] < n:
        ends.append(n)
    return list(zip([0, *ends], ends, strict=False))


PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """The pieces of all documents, in tokens: doc_id, start, length, ids_crc32, doc_tokens."""
    last = int(end).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        enc.forget()
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for doc, data in zip(ids, enc.encode(texts), strict=True):
                data += last
                n = len(data) // 4
                view = memoryview(data)
                rows += [(doc, a, b - a, zlib.crc32(view[4 * a : 4 * b]), n) for a, b in cuts(n, capacity)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )
        enc.forget()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns (their lengths with how often each occurs, in order of placing) and how many packs have each.

    Longest lengths first; each piece goes to the open pack that is shortest, all packs of a pattern at once. If
    no open pack has room a new one opens, and takes pieces of this length while it has room.
    """
    shortest: list[tuple[int, int, tuple]] = []  # (filled, serial, lengths): a heap of open patterns
    count: dict[int, int] = {}
    done: list[tuple[tuple, int]] = []
    serial = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if shortest and shortest[0][0] + length <= capacity:
                filled, key, lengths = heapq.heappop(shortest)
                packs, times = count.pop(key), 1
            else:  # a new pack is the shortest until it has no room left, so it takes all it can
                times = min(left, capacity // length)
                filled, lengths, packs = 0, (), left // times
            used = min(packs, left // times)
            if used < packs:  # the others stay as they are
                heapq.heappush(shortest, (filled, serial, lengths))
                count[serial] = packs - used
                serial += 1
            left -= used * times
            filled += times * length
            if lengths and lengths[-1][0] == length:
                lengths = (*lengths[:-1], (length, lengths[-1][1] + times))
            else:
                lengths = (*lengths, (length, times))
            if filled == capacity:
                done.append((lengths, used))
            else:
                heapq.heappush(shortest, (filled, serial, lengths))
                count[serial] = used
                serial += 1
    return [(list(p), n) for p, n in done + [(x[2], count[x[1]]) for x in sorted(shortest)]]


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """The pattern table by rank, in order of (length, first): the pieces of a length numbered from ``first``
    on go to the packs numbered from ``sequence`` on, one to each of ``packs``, at ``offset``; when each has
    got one, the next go ``length`` further on."""
    first: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, packs in patterns:
        offset = 0
        for length, times in lengths:
            at = first.get(length, 0)
            rows.append((length, at, sequence, packs, offset))
            first[length] = at + times * packs
            offset += times * length
        sequence += packs
    rows.sort()
    names = ("length", "first", "sequence", "packs", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset``. ``pieces_`` is read twice: stage it first."""
    histogram = {r["length"]: r["n"] for r in pieces_.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = places(shortest_pack_first(histogram, capacity))
    key = table["length"] * (1 << 48) + table["first"]
    ranked = gapless_rank(pieces_, ["length"], ["doc_id", "start", "ids_crc32"], "rank", sum(histogram.values()))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column(2)).astype(np.int64), np.asarray(b.column(5))
            i = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            at = rank - table["first"][i]
            sequence = table["sequence"][i] + at % table["packs"][i]
            offset = table["offset"][i] + at // table["packs"][i] * length
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(length), b.column(3), b.column(4), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Pack all documents: one row for each piece."""
    return pack(staged(pieces(docs, tokenizer, capacity, end)), capacity)


def padding(patterns: list[tuple[list[tuple[int, int]], int]], capacity: int) -> float:
    """The padded share of all sequences."""
    used = sum(sum(a * b for a, b in p) * n for p, n in patterns)
    total = sum(n for _, n in patterns) * capacity
    return 1 - used / total if total else 0.0
