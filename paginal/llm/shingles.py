"""Word shingles of whole texts as sorted 64-bit hashes, in numpy.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return, after lower-casing A-Z.  The hash of a word is the
sum of its bytes' random values times powers of an odd base, freed of its
position and mixed; that of a shingle combines its words' hashes in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes hashed together, but for a longer text on its own; bounds the memory of a batch.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Random values of lower-cased bytes; which bytes part words."""
    code = np.arange(256, dtype=np.uint64)
    upper = (code >= 65) & (code <= 90)
    value = mix((code + np.where(upper, 32, 0).astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
    space = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
    return value, space


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every word of a run of bytes."""
    value, space = _bytes()
    word = ~space[raw]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(19, int(len(raw)).bit_length())
    up, down = powers(size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[raw] * up[: len(raw)])])
    h = (total[end] - total[start]) * down[start]
    return start, mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, sorted."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    start, h = word_hashes(raw)
    bounds = np.searchsorted(start, first)
    words = np.diff(bounds)
    # With fewer words than a shingle has, the whole sequence is the one shingle.
    n = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    row = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)
    long_enough = (words >= width)[row]
    out = np.zeros(len(row), dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    for k in range(width):
        there = long_enough | (k < words[row])
        step = mix(padded[place + k] + np.uint64((k + 1) * _BASE & _MASK))
        out = np.where(there, mix(out * np.uint64(0x2545F4914F6CDD1D) + step), out)
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (out[1:] != out[:-1])
    return row[fresh], out[fresh]


def shingle_sets(texts: list[str | None], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: the first one's index, the sets' ends, and the sorted sets one after another."""
    held: list[bytes] = []
    size = begin = 0
    for k, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= CHUNK or k == len(texts) - 1:
            row, h = _sets(held, width)
            yield begin, np.searchsorted(row, np.arange(1, len(held) + 1)), h
            held, size, begin = [], 0, k + 1
