"""Words of whole texts as 64-bit hashes, in numpy.

A word is a run of letters, digits, marks of numbers and underscores (``\\w``),
each character lower-cased on its own.  Texts are read in chunks of bounded
size; a longer text is cut between words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from paginal.llm.shingles import mix, powers

#: Characters that are read together.
CHUNK = 1 << 18
_GAP, _WORD = re.compile(r"\W"), re.compile(r"\w")
_STEP = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it belongs to a word; its lower case, if that is one character."""
    word = np.fromiter((_WORD.match(chr(c)) is not None for c in range(0x110000)), dtype=bool, count=0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(word).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return word, lower


@dataclass
class Words:
    """The words of a chunk: text of each, place in the lower-cased characters, hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    code: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return self.end - self.start


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    rows: list[int] = []
    held: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            gap = _GAP.search(text, at + CHUNK) if len(text) - at > CHUNK else None
            stop = gap.start() if gap else len(text)
            rows.append(row)
            held.append(text[at:stop] if at or stop < len(text) else text)
            size += stop - at
            at = stop
            if size >= CHUNK:
                yield rows, held
                rows, held, size = [], [], 0
    if rows:
        yield rows, held


def words(texts: list[str | None]) -> Iterator[Words]:
    """The words of the texts in order, chunk by chunk."""
    known, lower = _characters()
    for rows, held in _pieces(texts):
        raw = np.frombuffer(("\n".join(held) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = known[raw]
        code = lower[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        up, down = powers(1 << max(19, int(len(raw)).bit_length()))
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((code + np.uint32(1)) * np.uint64(_STEP) * up[: len(raw)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        h = mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        sizes = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) + 1
        ends = np.cumsum(sizes)
        per = np.diff(np.searchsorted(start, np.concatenate([[0], ends])))
        yield Words(np.repeat(np.asarray(rows, dtype=np.int64), per), start, end, h, code)


def hash_of(word: str) -> int:
    """The hash of one word."""
    return int(next(words([word])).hash[0])


def summed(h: np.ndarray, n: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, n, size) with equal hashes added up, ascending."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n[order], first) if len(first) else n[:0], size[order][first]


class Lookup:
    """Finds hashes among known ones: tables by some of their bits, what collides goes on to the next table."""

    BITS = 16

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.asarray(hashes, dtype=np.uint64)
        self.tables: list[np.ndarray] = []
        left = np.arange(len(self.hashes))
        while len(left) or not self.tables:
            table = np.full(1 << self.BITS, -1, dtype=np.int32)
            slot = self._slot(self.hashes[left], len(self.tables))
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]

    def _slot(self, h: np.ndarray, level: int) -> np.ndarray:
        step = np.uint64((2 * level + 1) * _STEP & (1 << 64) - 1)
        return ((h * step) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each one's place among the known hashes, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1, dtype=np.int64)
        out = self.tables[0][self._slot(h, 0)].astype(np.int64)
        out[self.hashes[out] != h] = -1
        for level in range(1, len(self.tables)):
            rest = np.flatnonzero(out < 0)
            got = self.tables[level][self._slot(h[rest], level)].astype(np.int64)
            got[self.hashes[got] != h[rest]] = -1
            out[rest] = got
        return out


def utf8(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the characters, first byte of each character and the end)."""
    raw = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(raw) == len(code):
        return raw, np.arange(len(code) + 1)
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    return raw, np.concatenate([[0], np.cumsum(width)])
