"""SentencePiece encoding by forward filtering and backward sampling; lossless decoding.

A text's lattice holds every way to cut it into pieces of a SentencePiece
model.  Forward filtering sums the weights of all ways that lead to each
position; backward sampling draws a piece at a time from the end, each with
its share of that sum, so a whole segmentation comes with its probability.
The draws are hashes of the row's key and the position: the same row always
gives the same segmentation, in any batch and on any machine.

Blanks and line ends part the lattice, because no piece crosses from other
characters to a blank.  A worker keeps the lattices of the parts that it has
met, up to a bound; new parts are filtered, and all occurrences sampled, in
numpy.

A piece of rank r weighs ``(r + 2) ** -alpha``.  A character without a piece
falls back to its UTF-8 bytes.

Defined results
---------------
* A null or empty text has no pieces.  A null key counts as a key of its own.
* Blanks become the mark U+2581, with one more in front; that mark itself,
  where a text holds it, is written as bytes: decoding always restores the text.
* Rows with equal key and text get equal pieces.
* A run without blanks (or of blanks) of more than ``LONGEST`` characters is drawn in runs of that length, one after another.
* ``encode`` replaces a column named ids, ``decode`` one named decoded; other columns pass through.
* An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paginal.llm.common import small_batches, spare_name
from paginal.llm.shingles import mix

MARK = "▁"
#: Exponent of the weights; characters whose texts are worked on together; edges that a worker keeps, roughly.
ALPHA, GROUP, EDGES = 1.0, 1 << 18, 2_500_000
#: Rank that a byte of a character without a piece counts as.
BYTE_RANK = 1_000_000
#: Characters of a part at most: what has no blank for longer is sampled in pieces of that length.
LONGEST = 4096
#: Rows of an Arrow batch.
ROWS = 512


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Index(dict):
    """Numbers for keys in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Pieces:
    """A SentencePiece model as a character tree in hash tables."""

    def __init__(self, path: str, alpha: float = ALPHA):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.surface: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, dtype=np.int32)
        tree: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        self.weight = np.zeros(n)
        known: set[str] = set()
        for i in range(n):
            if model.is_byte(i):
                byte = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[byte] = i
                self.surface[i] = bytes([byte])
            elif not (model.is_control(i) or model.is_unknown(i)):
                piece = model.id_to_piece(i)
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece crosses a blank")
                self.surface[i] = piece.replace(MARK, " ").encode()
                self.weight[i] = -alpha * np.log(2 - model.get_score(i))
                node = 0
                for c in piece.replace(MARK, " "):
                    node = tree.setdefault((node, c), len(tree) + 1)
                ends[node] = i
                known.update(piece)
        self.byte_weight = -alpha * np.log(BYTE_RANK)
        known -= {MARK, " "}
        inside = "".join(map(re.escape, sorted(known)))
        # Characters of pieces with the blanks before them; blanks alone; any other character.
        self.parts = re.compile(f" {{0,{LONGEST}}}[{inside}]{{1,{LONGEST}}}| {{1,{LONGEST}}}|.", re.DOTALL).findall
        self.piece_at = np.full(len(tree) + 1, -1, dtype=np.int64)
        self.piece_at[list(ends)] = list(ends.values())
        self.forget()
        keys = np.array([node << 21 | ord(c) for node, c in tree], dtype=np.uint64)
        self._table(keys, np.array(list(tree.values()), dtype=np.int64))

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, filled in rounds."""
        self.bits = int(len(keys)).bit_length() + 2
        self.keys = np.full(1 << self.bits, 2**64 - 1, dtype=np.uint64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values = keys[~placed], values[~placed]
            slot = (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Children of tree nodes by characters, -1 where there is none."""
        key = node.astype(np.uint64) << np.uint64(21) | char.astype(np.uint64)
        slot = self._slot(key)
        out = np.full(len(key), -1, dtype=np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            held = self.keys[slot]
            hit = held == key
            out[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (held != np.uint64(2**64 - 1))
            open_, key, slot = open_[more], key[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def lattice(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """First and last node of each part; a node's first edge; per edge: start node, piece (or -1 - code point), summed share.

        A part of n characters has n + 1 nodes.  The edges that end at a node
        follow each other; their shares are summed up to 1.
        """
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        last = np.cumsum(size + 1) - 1
        part = np.repeat(np.arange(len(parts)), size)
        node = np.arange(len(code)) + part
        at = np.arange(len(code))
        room = np.repeat(np.cumsum(size), size) - at
        starts: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        pieces: list[np.ndarray] = []
        state = np.zeros(len(code), dtype=np.int64)
        single = np.zeros(len(code), dtype=bool)
        depth = 0
        while len(at):
            state = self.step(state, code[at + depth])
            depth += 1
            piece = np.where(state >= 0, self.piece_at[state], -1)
            hit = np.flatnonzero(piece >= 0)
            starts.append(node[at[hit]])
            ends.append(node[at[hit]] + depth)
            pieces.append(piece[hit])
            if depth == 1:
                single[at[hit]] = True
            going = (state >= 0) & (room[at] > depth)
            at, state = at[going], state[going]
        bare = np.flatnonzero(~single)
        starts.append(node[bare])
        ends.append(node[bare] + 1)
        pieces.append(-1 - code[bare])
        start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)
        order = np.argsort(end, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        weight = np.where(piece >= 0, self.weight[np.maximum(piece, 0)], self.byte_weight * utf8_size(np.maximum(-1 - piece, 0)))
        # Forward filtering, all parts at once, by the end's distance from the part's start.
        begin = last - size
        distance = end - np.repeat(begin, size + 1)[end]
        by = np.argsort(distance, kind="stable")
        bounds = np.searchsorted(distance[by], np.arange(1, int(size.max(initial=0)) + 2))
        total = np.zeros(int(last[-1]) + 1 if len(last) else 0)
        for a, b in zip(bounds[:-1], bounds[1:]):
            edges = by[a:b]
            to = end[edges]
            value = total[start[edges]] + weight[edges]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            most = np.maximum.reduceat(value, first)
            count = np.diff(np.append(first, len(to)))
            total[to[first]] = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, count)), first))
        share = np.exp(total[start] + weight - total[end])
        first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(end)))
        # Edge by edge of every node, so that a part's sums don't depend on the other parts.
        summed = share.copy()
        rank = 1
        while len(more := first[count > rank]):
            summed[more + rank] += summed[more + rank - 1]
            rank += 1
        summed[first + count - 1] = 1.0
        entry = np.zeros(len(total), dtype=np.int64)
        entry[end[first]] = first
        return begin, last, entry, start, piece, summed

    def known(self, texts: list[str | None]) -> list[list[int]]:
        """The parts of each text by number; lattices of new parts join those kept."""
        if self.n_edges > EDGES:
            self.forget()
        rows: list[list[int]] = [list(map(self.index.__getitem__, self.parts(" " + text))) if text else [] for text in texts]
        fresh = list(islice(self.index, self.n_parts, None))
        if fresh:
            begin, last, entry, start, piece, summed = self.lattice(fresh)
            n, e = self.n_nodes, self.n_edges
            for name, values, at in (
                ("begin", begin + n, self.n_parts), ("last", last + n, self.n_parts), ("entry", entry + e, n),
                ("start", start + n, e), ("piece", piece, e), ("summed", summed, e),
            ):
                held = getattr(self, name)
                if len(held) < at + len(values):
                    grown = np.empty(max(2 * len(held), at + len(values)), dtype=held.dtype)
                    grown[:at] = held[:at]
                    setattr(self, name, held := grown)
                held[at : at + len(values)] = values
            self.n_parts += len(fresh)
            self.n_nodes += len(entry)
            self.n_edges += len(start)
        return rows

    def forget(self) -> None:
        """Starts the kept lattices afresh."""
        self.index = _Index()
        self.n_parts = self.n_nodes = self.n_edges = 0
        self.begin, self.last, self.entry, self.start, self.piece = (np.zeros(0, dtype=np.int32) for _ in range(5))
        self.summed = np.zeros(0)

    def sample(self, texts: list[str | None], keys: np.ndarray) -> list[np.ndarray]:
        """A segmentation of each text, drawn by its key: ids as int32."""
        rows = self.known(texts)
        counts = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        if not counts.sum():
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        begin, last, entry, start, piece, summed = self.begin, self.last, self.entry, self.start, self.piece, self.summed
        part = np.fromiter(chain.from_iterable(rows), dtype=np.int64, count=int(counts.sum()))
        row = np.repeat(np.arange(len(rows)), counts)
        size = (last - begin).astype(np.int64)
        # The draw at a node is a hash of the row's key and the place in the text.
        place = np.cumsum(size[part])
        ahead = np.concatenate([[0], place[np.cumsum(counts)[:-1] - 1] * (np.cumsum(counts)[:-1] > 0)])
        place = place - size[part] - ahead[row] - begin[part]
        seed = mix(keys.astype(np.uint64))[row]
        live, node = np.arange(len(part)), last[part]
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        taken = np.zeros(len(part), dtype=np.int64)
        while len(live):
            h = mix(seed[live] + (place[live] + node).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            u = (h >> np.uint64(22)).astype(np.float64) / 2.0**42
            edge = entry[node]
            behind = np.flatnonzero(summed[edge] <= u)
            while len(behind):
                edge[behind] += 1
                behind = behind[summed[edge[behind]] <= u[behind]]
            drawn.append((live, piece[edge]))
            taken[live] += 1
            node = start[edge]
            going = node > begin[part[live]]
            live, node = live[going], node[going]
        stop = np.cumsum(taken)
        out = np.zeros(int(stop[-1]), dtype=np.int64)
        for depth, (which, ids) in enumerate(drawn):
            out[stop[which] - 1 - depth] = ids
        ends = np.concatenate([[0], stop])[np.cumsum(counts)]
        return self._with_bytes(out, ends)

    def _with_bytes(self, ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Splits ids by text and writes fallback characters as bytes."""
        bare = ids < 0
        if bare.any():
            point = np.maximum(-1 - ids, 0)
            width = np.where(bare, utf8_size(point), 1)
            stop = np.cumsum(width)
            which = np.repeat(np.arange(len(ids)), width)
            k = np.arange(len(which)) - (stop - width)[which]
            value = ids[which]
            byte = utf8_byte(point[which], width[which], k)
            ids = np.where(value < 0, self.byte_id[byte], value)
            ends = np.concatenate([[0], stop])[ends]
        return np.split(ids.astype(np.int32), ends[:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, whichever segmentation they are."""
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "surrogatepass")


def utf8_size(point: np.ndarray) -> np.ndarray:
    return 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)


def utf8_byte(point: np.ndarray, size: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th byte of a code point's UTF-8 form."""
    tail = point >> (6 * (size - 1 - k))
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    return np.where(k > 0, 0x80 | tail & 0x3F, np.where(size == 1, point, lead | tail))


_models: dict[tuple[str, float], Pieces] = {}


def pieces(path: str, alpha: float = ALPHA) -> Pieces:
    """The worker's model for a file; made once."""
    if (path, alpha) not in _models:
        _models[path, alpha] = Pieces(path, alpha)
    return _models[path, alpha]


def groups(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of about GROUP characters."""
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= GROUP or k == len(texts) - 1:
            yield slice(first, k + 1)
            first, size = k + 1, 0


def encode(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, seed: int = 0, model: str | None = None) -> DataFrame:
    """Adds ids: a segmentation of each whole text, drawn by the row's key."""
    small_batches(docs.sparkSession, ROWS)
    path = model or default_path()
    kept = [c for c in docs.columns if c.lower() != "ids"]
    read, drawn = spare_name([*kept, "ids"]), spare_name([*kept, "ids"], "key")
    source = docs.select(*kept, F.col(text_col).cast("string").alias(read), F.xxhash64(F.lit(seed), F.col(key_col)).alias(drawn))
    schema = docs.select(*kept, F.array().cast("array<int>").alias("ids")).schema

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path, alpha)
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            keys = batch.column(len(kept) + 1).to_numpy().view(np.uint64)
            for part in groups(texts):
                got = own.sample(texts[part], keys[part])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got)))
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], lists], names=[*kept, "ids"])

    return source.mapInArrow(draw, schema)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds decoded: the text that the ids stand for."""
    path = model or default_path()
    kept = [c for c in encoded.columns if c.lower() != "decoded"]
    schema = encoded.select(*kept, F.lit("").alias("decoded")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            column = batch.column("ids")
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [own.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return encoded.mapInArrow(read, schema)
