"""Token ids of whole texts by the tokenizers library, found in numpy.

Byte-level BPE never merges across pre-tokens, so the ids of a text are those
of its pre-tokens.  Runs of texts are cut into pre-tokens in numpy, by classes
of bytes; a pre-token of up to 24 bytes is its own key in a table of known
ones, and what is not known goes to the library's model, one by one.  This is
exact: keys are compared whole.

What the numpy path does not know goes to the library as a whole: texts with
characters other than printable ASCII, line ends, Latin letters and common
punctuation, texts that hold the string of an added token, and all texts where
the file's pre-tokenizer, normalizer or model has another form.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are cut together; ids held for known pre-tokens, beyond which a worker starts afresh.
CHUNK, HELD_IDS = 1 << 18, 1 << 22
#: Bits of the number of slots of known pre-tokens, which go in pairs; most bytes of a pre-token that has a slot.
SLOT_BITS, KEY_BYTES = 20, 24
#: Longer pre-tokens that are kept beside them.
LONGER = 1 << 14
#: Bytes of one id.
WIDTH = 4
#: Classes of bytes: letter, number, other mark, white space, blank; a part of what lies before; unknown.
LETTER, NUMBER, MARK, SPACE, BLANK, PART, ODD = range(7)
#: A place where a long text can be cut: a pre-token ends before the blank, whatever lies around.
_CUT = re.compile(rb"[0-9A-Za-z] [0-9A-Za-z]")
#: What follows an apostrophe in a pre-token of its own.
ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others take the code points from 256 on, in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def _char_class(c: str) -> int:
    """Class of a character that the numpy path knows."""
    if c == " ":
        return BLANK
    if c.isspace():
        return SPACE
    if c.isalpha():
        return LETTER
    return NUMBER if c.isnumeric() else MARK


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of single bytes; classes by the low bits of two-byte characters (U+0080 on) and of U+2000 on."""
    one = np.full(256, ODD, dtype=np.uint8)
    for b in (9, 10, 13, *range(32, 127)):
        one[b] = _char_class(chr(b))
    one[0x80:0xC0] = PART
    two = np.full(0x800, ODD, dtype=np.uint8)
    for c in range(0xA0, 0x250):
        two[c] = _char_class(chr(c))
    three = np.full(64, ODD, dtype=np.uint8)
    three[0x10:0x27] = MARK
    return one, two, three


_ONE, _TWO, _THREE = _tables()
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def classes(raw: np.ndarray) -> np.ndarray:
    """The class of every byte; a character's later bytes are PART, or ODD as its first one is."""
    kind = _ONE[raw]
    wide = np.flatnonzero(raw >= 0xC0)
    if len(wide):
        padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64)
        lead, second, third = padded[wide], padded[wide + 1], padded[wide + 2]
        two = (lead & 0xE0) == 0xC0
        general = (lead == 0xE2) & (second == 0x80)
        kind[wide] = np.where(two, _TWO[(lead & 0x1F) << 6 | second & 0x3F], np.where(general, _THREE[third & 0x3F], ODD))
    return kind


def starts(raw: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each byte; first: whether a text does."""
    # Every byte takes the class of its character.
    part = np.flatnonzero(kind == PART)
    for _ in range(3):
        kind[part] = kind[part - 1]
    n = len(raw)
    space = kind >= SPACE
    before = np.empty(n, dtype=np.uint8)
    before[0] = ODD
    before[1:] = kind[:-1]
    # A mark, letter or number starts one unless its like or a blank lies before it.
    start = ~space & (before != kind) & (before != BLANK)
    # White space starts one after anything else; its last character does before anything else.
    was_space = before >= SPACE
    was_space[0] = False
    start |= space & ~was_space
    head = np.ones(n, dtype=bool)
    head[part] = False
    next_solid = np.zeros(n, dtype=bool)
    next_solid[:-1] = ~space[1:] & ~first[1:]
    last = space & next_solid
    # The last character of white space may have two bytes: its first byte starts.
    at = np.flatnonzero(last & ~head)
    last[at] = False
    last[at - 1] = True
    start |= last
    start &= head
    start |= first
    # An apostrophe that starts a pre-token takes certain endings with it.
    quote = np.flatnonzero(start & (raw == 39))
    if len(quote):
        padded = np.concatenate([raw, np.zeros(2, np.uint8)])
        a, b = padded[quote + 1], padded[quote + 2]
        ends_text = np.concatenate([first, np.ones(2, bool)])
        inside = ~ends_text[quote + 1]
        inside2 = inside & ~ends_text[quote + 2]
        size = np.zeros(len(quote), dtype=np.int64)
        for ending in ENDINGS:
            if len(ending) == 1:
                size[(a == ending[0]) & inside] = 1
            else:
                size[(a == ending[0]) & (b == ending[1]) & inside2] = 2
        got = size > 0
        start[quote[got] + 1] = False
        after = quote[got] + size[got] + 1
        start[after[after < n]] = True
    return start


class Encoder:
    """Encodes texts with one tokenizer file.

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.
    With ``special_as_text``, the strings of added tokens are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.known_form = self._known_form(form)
        added = form.get("added_tokens") or []
        self.added = [t["content"].encode() for t in added if not (special_as_text and t.get("special"))]
        self.tokenize = self.tokenizer.model.tokenize
        self.letter = dict(enumerate(byte_letters()))
        self._afresh()

    @staticmethod
    def _known_form(form: dict) -> bool:
        """Plain byte-level BPE, split by the usual pattern, without a change of the text."""
        before, model = form.get("pre_tokenizer") or {}, form.get("model") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        bpe = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        return bool(plain and bpe and not form.get("normalizer") and not form.get("truncation") and not form.get("padding"))

    def _afresh(self) -> None:
        self.longer: dict[bytes, tuple[int, int]] = {}
        self.pool, self.held = np.zeros(1 << 16, dtype=np.uint32), 0
        # A slot: three parts of the key; place in the pool above, number of ids in the low byte.  A line of the cache holds a pair.
        self.slots = np.zeros((1 << SLOT_BITS, 4), dtype=np.uint64)

    def _library(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype=np.uint32)

    def _unknown(self, words: list[bytes]) -> np.ndarray:
        """(place in the pool, number of ids) of pre-tokens without a slot; equal ones are asked for once."""
        fresh = dict.fromkeys(words)
        for word in fresh.keys() & self.longer.keys():
            fresh[word] = self.longer[word]
        asked = [word for word, got in fresh.items() if got is None]
        # No pre-token that the numpy path knows holds a zero byte, so it parts them while all are spelled at once.
        spelled = b"\0".join(asked).decode("latin-1").translate(self.letter).split(self.letter[0]) if asked else []
        ids: list[int] = []
        for word, letters in zip(asked, spelled):
            found = self.tokenize(letters)
            fresh[word] = (self.held + len(ids), len(found))
            ids += [t.id for t in found]
        if self.held + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.held : self.held + len(ids)] = ids
        self.held += len(ids)
        if len(self.longer) > LONGER:
            self.longer.clear()
        self.longer.update((w, fresh[w]) for w in asked if KEY_BYTES < len(w) <= 8 * KEY_BYTES)
        return np.array([fresh[w] for w in words], dtype=np.int32)

    def _ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of the pre-tokens; data ends with KEY_BYTES more bytes."""
        size = end - start
        eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))
        key = np.zeros((len(start), 3), dtype=np.uint64)
        key[:, 0] = eight[start] & _MASKS[np.minimum(size, 8)]
        longer = np.flatnonzero(size > 8)
        for part in (1, 2):
            key[longer, part] = eight[start[longer] + 8 * part] & _MASKS[np.minimum(size[longer] - 8 * part, 8)]
            longer = longer[size[longer] > 16]
        mixed = key[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ key[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ key[:, 2] * np.uint64(0x165667B19E3779F9)
        slot = (mixed >> np.uint64(65 - SLOT_BITS)).astype(np.int64) * 2
        got = self.slots.take(slot, axis=0)
        hit = (got[:, 0] == key[:, 0]) & (got[:, 1] == key[:, 1]) & (got[:, 2] == key[:, 2])
        # What isn't in the first slot of its pair may be in the second.
        other = np.flatnonzero(~hit)
        beside = self.slots.take(slot[other] + 1, axis=0)
        there = (beside[:, :3] == key[other]).all(axis=1)
        got[other[there]] = beside[there]
        # What is met again moves to the first slot, where the rare ones that come and go don't reach it.
        again = slot[other[there]]
        self.slots[again + 1] = self.slots[again]
        self.slots[again] = beside[there]
        hit[other[there]] = True
        hit &= size <= KEY_BYTES
        at, n = (got[:, 3] >> np.uint64(8)).astype(np.int64), (got[:, 3] & np.uint64(0xFF)).astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            whole = data.tobytes()
            found = self._unknown([whole[a:b] for a, b in zip(start[miss].tolist(), end[miss].tolist())])
            at[miss], n[miss] = found[:, 0], found[:, 1]
            kept = miss[size[miss] <= KEY_BYTES]
            where = slot[kept]
            where += self.slots[where, 0] != 0
            self.slots[where] = np.concatenate([key[kept], (at[kept] << 8 | n[kept]).astype(np.uint64)[:, None]], axis=1)
        if n.max(initial=0) <= 1:
            return self.pool[at], n
        begin = np.cumsum(n, dtype=np.int64) - n
        total = int(begin[-1] + n[-1])
        return self.pool[np.repeat(at - begin, n) + np.arange(total)], n

    def _run(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each text) of texts that lie one after another in raw and end at ``ends``."""
        if self.held > HELD_IDS:
            self._afresh()
        n = len(raw)
        sizes = np.diff(ends, prepend=0)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        whole = raw.tobytes() if self.added or not self.known_form else b""
        begin = ends - sizes
        apart = np.zeros(len(ends), dtype=bool)
        if not self.known_form:
            apart = sizes > 0
        elif any(t in whole for t in self.added):
            apart = np.array([any(t in whole[a:b] for t in self.added) for a, b in zip(begin.tolist(), ends.tolist())])
        kind = classes(raw)
        filled = np.flatnonzero(sizes)
        apart[filled] |= np.maximum.reduceat(kind, begin[filled]) == ODD
        first = np.zeros(n, dtype=bool)
        first[begin[filled]] = True
        start = np.flatnonzero(starts(raw, kind, first))
        end = np.append(start[1:], n)
        data = np.concatenate([raw, np.zeros(KEY_BYTES, np.uint8)])
        if apart.any():
            keep = ~apart[np.searchsorted(ends, start, side="right")]
            start, end = start[keep], end[keep]
        ids, each = self._ids(data, start, end)
        edge = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])[np.searchsorted(start, np.concatenate([[0], ends]))]
        counts = np.diff(edge)
        if not apart.any():
            return ids, counts
        parts = [self._library(data[begin[k] : ends[k]].tobytes()) if apart[k] else ids[edge[k] : edge[k + 1]] for k in range(len(ends))]
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """The ids of one long text, cut where a pre-token surely ends."""
        whole = raw.tobytes()
        if not self.known_form or any(t in whole for t in self.added):
            return self._library(whole)
        parts, at = [], 0
        while at < len(whole):
            found = _CUT.search(whole, at + CHUNK)
            stop = found.start() + 1 if found else len(whole)
            parts.append(self._run(raw[at:stop], np.array([stop - at]))[0])
            at = stop
        return np.concatenate(parts)

    def runs(self, column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Runs of whole texts of an Arrow column of strings: (rows, ids, number of each); null is empty."""
        column = column.fill_null("") if column.null_count else column
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        if not len(column):
            return
        buffer = column.buffers()[2]
        raw = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(column):
            stop = int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1
            if stop <= row:
                ids = self._long(raw[offsets[row] : offsets[row + 1]])
                yield slice(row, row + 1), ids, np.array([len(ids)])
                row += 1
                continue
            stop = min(stop, len(column))
            ids, counts = self._run(raw[offsets[row] : offsets[stop]], offsets[row + 1 : stop + 1] - offsets[row])
            yield slice(row, stop), ids, counts
            row = stop

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text as 32-bit little-endian bytes; null counts as empty."""
        out: list[bytes] = []
        for _, ids, counts in self.runs(pa.array(texts, pa.string())):
            flat, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * WIDTH).tolist()
            out += [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of each text) with the end id after each text's ids."""
    sizes = counts + 1
    out = np.full(len(ids) + len(counts), end_id, dtype=np.uint32)
    inside = np.ones(len(out), dtype=bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = ids
    return out, sizes


def binary(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of runs of ids, 32-bit little-endian."""
    ends = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes * WIDTH, out=ends[1:])
    if ends[-1] >= 2**31:
        raise ValueError("a batch of ids exceeds 2 GiB")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
