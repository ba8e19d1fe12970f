"""Word hashes over UTF-8 bytes, many texts at a time, in numpy.

A word is a run of bytes other than the six ASCII white-space bytes, i.e. ``[^\\x20\\x09-\\x0D]+``; bytes
of multi-byte characters never equal one of those, so the bytes need no decoding. All words of a block
are hashed by one running sum of ``byte * BASE**position`` modulo 2**64: ``BASE`` is odd, so dividing by
``BASE**start`` makes a word's hash free of its position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed values of the 64-bit finalizer by Steele, Lea and Flood (SplitMix64), and an odd base.
GOLDEN, MIX1, MIX2, BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x5851F42D4C957F2D))
#: Bytes hashed at a time; the arrays are eight times that.
BLOCK = 1 << 19

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + 2)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(b), np.uint64)], dtype=np.uint64) for b in (int(BASE), pow(int(BASE), -1, 1 << 64))]
    return _powers[0], _powers[1]


def _hashed(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of a block."""
    space = np.r_[True, IS_SPACE[buf], True]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(buf))
    run = np.empty(len(buf) + 1, np.uint64)
    run[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=run[1:])
    return mix((run[end] - run[start]) * down[start]), start, end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, the words' lengths in bytes, and where each text's
    words start (one entry more than texts). Works through blocks of about BLOCK bytes; only a single
    word longer than that makes a larger block."""
    hashes, lengths, firsts, total = [], [], [np.zeros(1, np.int64)], 0
    for texts_of_block in _blocks(texts):
        joined = b"\n".join(texts_of_block)
        sizes = np.fromiter(map(len, texts_of_block), np.int64, len(texts_of_block))
        ends = np.cumsum(sizes + 1)
        if len(joined) <= 2 * BLOCK:
            h, start, end = _hashed(np.frombuffer(joined, np.uint8)) if joined else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            hashes.append(h)
            lengths.append(end - start)
            firsts.append(total + np.searchsorted(start, ends))
            total += len(h)
        else:  # one very long text
            n = 0
            for part in _parts(joined):
                h, start, end = _hashed(np.frombuffer(part, np.uint8))
                hashes.append(h)
                lengths.append(end - start)
                n += len(h)
            total += n
            firsts.append(np.array([total]))
    none = [np.zeros(0, np.int64)]
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate(none + lengths), np.concatenate(firsts)


def groups(texts: list[bytes], size: int = 8 * BLOCK) -> Iterator[list[bytes]]:
    """Texts in groups of about ``size`` bytes, so that what is worked out for a group stays small."""
    return _blocks(texts, size)


def _blocks(texts: list[bytes], most: int = BLOCK) -> Iterator[list[bytes]]:
    block: list[bytes] = []
    size = 0
    for t in texts:
        if block and size + len(t) > most:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t) + 1
    if block:
        yield block


def _parts(text: bytes) -> Iterator[bytes]:
    """Cut at white space, so that no word is split."""
    at = 0
    while at < len(text):
        end = min(at + BLOCK, len(text))
        while end < len(text) and not IS_SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; with fewer words, the whole sequence as one."""
    if not len(words):
        return words
    k = min(size, len(words))
    n = len(words) - k + 1
    h = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        h = mix(h * GOLDEN + words[i : i + n])
    return h
