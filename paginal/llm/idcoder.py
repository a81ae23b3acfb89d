"""Token-id files by an adaptive context-mixing range coder.

A file is a run of blocks.  Each block resets the model, carries a directory of
its documents and checksums, and can be decoded alone.

Model.  Order-1 and order-2 contexts predict one next id each, with a
confidence that grows on hits and halves on misses.  The chances of the
order-2 guess as seen by orders 2, 1 and 0 are mixed in the logistic domain by
weights that learn from the error; the order-1 guess has an adaptive chance by
confidence; what is left goes to adaptive order-0 frequencies of the block's ids.  A
carryless range coder codes the outcome in one step.

Lanes.  The ids of a block are cut into equal runs, one per lane.  All lanes
share the model and advance together, so that each step is a handful of numpy
operations; every lane has a coder and an output of its own.  All arithmetic
is in whole numbers, so that any machine decodes what another has written.

Symbols.  A block has an alphabet of its own, the ids that occur in it, so the
ids may be any 32-bit numbers.

Block layout, little-endian: magic ``CMR2``; u32 documents, ids, lanes,
letters of the alphabet, bytes of its table; u32 crc32 of the ids (as u32),
u32 crc32 of all that follows; directory: i64 document ids, u8 null flags, u32
numbers of ids; table: steps between the ascending letters, u32 by planes of
bytes, deflated; payload: u32 words of each lane, then the lanes' u16 words.

Defined results
---------------
* A null text is empty (its end id only); a null document id sorts first.
* Rows with equal ids keep separate entries, ordered by a hash of the text, then the text.
* A text of any length is one document of one block, which then is as long as it.
* An empty table gives no blocks and no rows.  Extra columns are not carried.
* A damaged block raises ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paginal.llm import bpe
from paginal.llm.common import small_batches, written

MAGIC = b"CMR2"
HEAD = struct.Struct("<4sIIIIIII")
#: Ids after which a block closes (a document is never cut), most lanes, fewest ids of a lane.
BLOCK_IDS, LANES, LANE_IDS = 1 << 20, 4096, 128
#: Scale of the coder, gain of an order-0 count, steps between refreshes of its sums.
TOTAL_BITS, GAIN, REFRESH = 24, 24, 8
TOTAL = 1 << TOTAL_BITS
#: Scale of the order-0 sums: at least what the guesses leave, so that every symbol has a share.
SUM_BITS = TOTAL_BITS - 1
#: Most of the scale for both guesses, and its unit: chances have 12 bits.
GUESSES, UNIT = TOTAL // 2, TOTAL // 2 // 4096
#: Bits of the order-2 table's size; most symbols of a block; greatest confidence, and its shift in a guess.
SLOT_BITS, MOST_SYMBOLS, CONFIDENT, SHIFT = 18, 1 << 22, 15, 26
#: Greatest sum of order-0 counts; beyond it they are halved.
MOST = 1 << 26
#: Shift of the mixing weights' steps.
RATE = 14
#: Greatest mixing weight, and how far a mix of three inputs can reach.
HEAVIEST = 1 << 18
REACH = (3 * HEAVIEST * 2047 >> 16) + 1
LEVELS = CONFIDENT + 1


@lru_cache(maxsize=1)
def _curves() -> tuple[np.ndarray, np.ndarray]:
    """stretch of 12-bit chances (8 bits of fraction), and squash of -REACH..REACH back."""
    p = (np.arange(4096) + 0.5) / 4096
    stretch = np.clip(np.rint(np.log(p / (1 - p)) * 256), -2047, 2047).astype(np.int32)
    x = np.clip(np.arange(-REACH, REACH + 1), -2047, 2047) / 256
    squash = np.clip(np.rint(4096 / (1 + np.exp(-x))), 1, 4095).astype(np.int32)
    return stretch, squash


_LEVELS = np.arange(LEVELS)
#: The next confidence, without and with a hit.
NEXT = (np.concatenate([np.where(_LEVELS > 1, _LEVELS >> 1, 1), np.minimum(_LEVELS + 1, CONFIDENT)]) << SHIFT).astype(np.int32)
_ID = np.int32((1 << SHIFT) - 1)


class Mixer:
    """The adaptive state of a block over its own alphabet; encoder and decoder run it alike."""

    def __init__(self, symbols: int) -> None:
        self.stretch, self.squash = _curves()
        self.symbols = symbols
        self.counts = np.ones(symbols, dtype=np.int64)
        # Guesses of orders 1 and 2: the symbol, and above it the confidence.
        self.order1, self.order2 = np.zeros(symbols, dtype=np.int32), np.zeros(1 << SLOT_BITS, dtype=np.int32)
        # Misses and hits by confidence: order 2, order 1.
        self.seen = np.zeros((2, 2 * LEVELS), dtype=np.int64)
        self.weights = np.array([40000, 20000, 5000], dtype=np.int64)
        self.step = 0
        self._refresh()

    def _refresh(self) -> None:
        sums = np.zeros(self.symbols + 1, dtype=np.int64)
        np.cumsum(self.counts, out=sums[1:])
        if sums[-1] > MOST:
            self.counts = (self.counts + 1) >> 1
            np.cumsum(self.counts, out=sums[1:])
        # Scaled to 2**SUM_BITS at most by a factor in 30 bits, so that the coder needs shifts only; every symbol keeps a share.
        spare = (1 << SUM_BITS) - self.symbols
        sums *= (spare << 30) // int(sums[-1]) if sums[-1] < 1 << 30 else 0
        sums >>= 30
        sums += np.arange(self.symbols + 1)
        sums[-1] = 1 << SUM_BITS
        self.sums = sums
        self.by0 = self.stretch[np.minimum((sums[1:] - sums[:-1]) >> (SUM_BITS - 12), 4095)]

    def predict(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Guesses a and b of each lane and their shares of the scale, in units of UNIT."""
        self.one = one
        mixed = two.view(np.uint32) * np.uint32(0x9E3779B1)
        mixed += one.view(np.uint32) * np.uint32(0x85EBCA6B)
        self.slot = (mixed >> np.uint32(32 - SLOT_BITS)).astype(np.intp)
        guess2, guess1 = self.order2[self.slot], self.order1[one]
        a, b = guess2 & _ID, guess1 & _ID
        s2, s1 = guess2 >> SHIFT, guess1 >> SHIFT
        hits, trials = self.seen[:, LEVELS:], self.seen[:, LEVELS:] + self.seen[:, :LEVELS]
        chance = (2 * hits + 1) * 4095 // (2 * trials + 3)
        steep = self.stretch[chance].astype(np.int64)
        w = self.weights
        same = a == b
        # What both orders' confidences add to the mix, by whether they agree.
        self.pair = ((same.astype(np.int32) * LEVELS + s2) * LEVELS + s1).astype(np.intp)
        table = np.broadcast_to((steep[0] * w[0])[None, :, None], (2, LEVELS, LEVELS)).copy()
        table[1] += (steep[1] * w[1])[None, :]
        self.zero = self.by0[a]
        mix = self.zero * w[2]
        mix += table.reshape(-1)[self.pair]
        mix >>= 16
        mix += REACH
        share_a = self.squash[mix]
        self.asked = s2 > 0
        share_a *= self.asked
        own = chance[1].astype(np.int32)
        own[0] = 0
        # An order-1 guess that agrees with an asked order-2 guess has no share of its own.
        by_pair = np.broadcast_to(own, (2, LEVELS, LEVELS)).copy()
        by_pair[1, 1:] = 0
        share_b = np.minimum(by_pair.reshape(-1)[self.pair], 4096 - share_a)
        self.a, self.b, self.s2, self.s1, self.share, self.steep = a, b, s2, s1, share_a, steep
        return a, b, share_a, share_b

    def update(self, symbols: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """hit2, hit1: where the guesses were right."""
        n = int(np.count_nonzero(self.asked))
        if n:
            # The mean gradient of the lanes moves the weights once a step; sums by pair of confidences are exact.
            error = ((hit2.astype(np.int32) << 12) - self.share) * self.asked
            by_pair = np.bincount(self.pair, error, minlength=2 * LEVELS * LEVELS).astype(np.int64).reshape(2, LEVELS, LEVELS)
            slopes = [int(by_pair.sum(axis=(0, 2)) @ self.steep[0]), int(by_pair[1].sum(axis=0) @ self.steep[1]), int(np.dot(self.zero.astype(np.int64), error))]
            self.weights += np.array([s * 4 // n >> (RATE - 12) for s in slopes])
            np.clip(self.weights, -HEAVIEST, HEAVIEST, out=self.weights)
        for row, (table, at, guess, sure, hit) in enumerate(((self.order2, self.slot, self.a, self.s2, hit2), (self.order1, self.one, self.b, self.s1, hit1))):
            state = sure + hit * np.int32(LEVELS)
            self.seen[row] += np.bincount(state, minlength=2 * LEVELS)
            # A sure guess stays; a right one is the symbol anyway.
            table[at] = np.where(sure > 1, guess, symbols) | NEXT[state]
        np.add.at(self.counts, symbols, GAIN)
        self.step += 1
        if self.step % REFRESH == 0:
            self._refresh()


TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
WORD, ZERO, DOWN = np.uint64(16), np.uint64(0), np.uint64(TOTAL_BITS)


def _lanes(n: int) -> tuple[int, int]:
    """Lanes and steps for n ids."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    return lanes, -(-n // lanes)


def _settled(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The lanes whose top word is known; where an interval stays tight across a word's edge, it is cut there first."""
    done = (low ^ (low + span)) < TOP
    tight = span < BOTTOM
    if tight.any():
        tight &= ~done
        cut = np.flatnonzero(tight)
        span[cut] = (ZERO - low[cut]) & (BOTTOM - np.uint64(1))
        done |= tight
    return np.flatnonzero(done)


def encode_symbols(symbols: np.ndarray, size: int) -> tuple[bytes, int]:
    """The payload of a run of symbols of an alphabet, and its number of lanes."""
    n = len(symbols)
    if not n:
        return b"", 0
    lanes, steps = _lanes(n)
    # What fills the last lanes up is coded as zeros and cut off by the reader.
    grid = np.zeros(lanes * steps, dtype=np.int32)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Mixer(size)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 2**64 - 1, dtype=np.uint64)
    one = two = np.zeros(lanes, dtype=np.int32)
    out_lane: list[np.ndarray] = []
    out_word: list[np.ndarray] = []
    for now in grid:
        a, b, share_a, share_b = model.predict(one, two)
        hit2, hit1 = a == now, b == now
        by_a = hit2 & (share_a > 0)
        by_b = hit1 & (share_b > 0) & ~by_a
        start = share_a * by_b * UNIT
        width = (share_a * by_a + share_b * by_b) * UNIT
        rest = np.flatnonzero(~(by_a | by_b))
        guesses = (share_a[rest] + share_b[rest]).astype(np.int64) * UNIT
        left = TOTAL - guesses
        which = now[rest]
        first = left * model.sums[which] >> SUM_BITS
        width[rest] = (left * model.sums[which + 1] >> SUM_BITS) - first
        start[rest] = first + guesses
        span >>= DOWN
        low += span * start.astype(np.uint64)
        span *= width.astype(np.uint64)
        moving = _settled(low, span)
        while len(moving):
            l, s = low[moving], span[moving]
            out_lane.append(moving)
            out_word.append((l >> np.uint64(48)).astype("<u2"))
            l <<= WORD
            s <<= WORD
            more = _settled(l, s)
            low[moving], span[moving] = l, s
            moving = moving[more]
        model.update(now, hit2, hit1)
        two, one = one, now
    # Two words name a value inside the last interval, which is wider than 32 bits.
    last = (low + (BOTTOM - np.uint64(1))) & ~(BOTTOM - np.uint64(1))
    for shift in (48, 32):
        out_lane.append(np.arange(lanes))
        out_word.append(((last >> np.uint64(shift)) & np.uint64(0xFFFF)).astype("<u2"))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    order = np.argsort(lane.astype(np.uint16) if lanes <= 1 << 16 else lane, kind="stable")
    return np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + word[order].tobytes(), lanes


def _found(sums: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The last place of ``sums`` that is not above each of ``asked``; the search is faster in order."""
    bits = max(1, len(asked) - 1).bit_length()
    keys = asked << bits | np.arange(len(asked))
    keys.sort()
    out = np.empty(len(asked), dtype=np.int64)
    out[keys & ((1 << bits) - 1)] = np.searchsorted(sums, keys >> bits, side="right") - 1
    return out


def decode_symbols(payload: bytes, n: int, lanes: int, size: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.int32)
    if (lanes, -(-n // lanes)) != _lanes(n):
        raise ValueError("the lanes don't fit the number of ids")
    steps = -(-n // lanes)
    sizes = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
    # Past a lane's words the decoder reads zeros, as the encoder assumes.
    words = np.concatenate([np.frombuffer(payload, "<u2", offset=4 * lanes).astype(np.uint64), np.zeros(1, np.uint64)])
    ends = np.cumsum(sizes)
    if ends[-1] != len(words) - 1:
        raise ValueError("the lanes don't fill the payload")
    at = ends - sizes
    code = np.zeros(lanes, dtype=np.uint64)

    def word(which: np.ndarray) -> np.ndarray:
        place = at[which]
        at[which] = place + 1
        return words[np.where(place < ends[which], place, len(words) - 1)]

    every = np.arange(lanes)
    for _ in range(4):
        code = code << WORD | word(every)
    model = Mixer(size)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 2**64 - 1, dtype=np.uint64)
    one = two = np.zeros(lanes, dtype=np.int32)
    grid = np.zeros((steps, lanes), dtype=np.int32)
    for step in range(steps):
        a, b, share_a, share_b = model.predict(one, two)
        span >>= DOWN
        target = np.minimum((code - low) // span, np.uint64(TOTAL - 1)).astype(np.int32)
        edge_a = share_a * UNIT
        edge_b = edge_a + share_b * UNIT
        by_a = target < edge_a
        by_b = (target < edge_b) & ~by_a
        now = np.where(by_a, a, b)
        start = edge_a * by_b
        width = edge_a * by_a + (edge_b - edge_a) * by_b
        rest = np.flatnonzero(target >= edge_b)
        guesses = edge_b[rest].astype(np.int64)
        left = TOTAL - guesses
        asked = (((target[rest] - guesses + 1) << SUM_BITS) - 1) // left
        which = np.minimum(_found(model.sums, asked), size - 1)
        first = left * model.sums[which] >> SUM_BITS
        width[rest] = (left * model.sums[which + 1] >> SUM_BITS) - first
        start[rest] = first + guesses
        now[rest] = which
        low += span * start.astype(np.uint64)
        span *= width.astype(np.uint64)
        moving = _settled(low, span)
        while len(moving):
            l, s = low[moving] << WORD, span[moving] << WORD
            code[moving] = code[moving] << WORD | word(moving)
            more = _settled(l, s)
            low[moving], span[moving] = l, s
            moving = moving[more]
        model.update(now, a == now, b == now)
        two, one = one, now
        grid[step] = now
    return grid.T.reshape(-1)[:n]


def _alphabet(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids that occur, ascending; each id's place among them)."""
    top = int(flat.max(initial=0))
    if top >= MOST_SYMBOLS:
        return np.unique(flat, return_inverse=True)
    seen = np.zeros(top + 1, dtype=bool)
    seen[flat] = True
    letters = np.flatnonzero(seen)
    place = np.zeros(top + 1, dtype=np.int32)
    place[letters] = np.arange(len(letters))
    return letters, place[flat]


def encode_block(doc_ids: list[int | None], sizes: np.ndarray, flat: np.ndarray) -> bytes:
    """One block of whole documents; sizes: number of each one's ids, which lie one after another in flat."""
    flat = np.ascontiguousarray(flat, dtype="<u4")
    letters, symbols = _alphabet(flat)
    if len(letters) > MOST_SYMBOLS:
        raise ValueError(f"more than {MOST_SYMBOLS} different ids in a block")
    payload, lanes = encode_symbols(symbols, len(letters))
    table = zlib.compress(np.diff(letters, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    directory = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + null.tobytes() + np.asarray(sizes, dtype="<u4").tobytes()
    body = directory + table + payload
    return HEAD.pack(MAGIC, len(doc_ids), len(flat), lanes, len(letters), len(table), zlib.crc32(flat.tobytes()), zlib.crc32(body)) + body


def decode_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The documents of a block: their ids, the number of token ids of each, and these one after another."""
    if len(block) < HEAD.size:
        raise ValueError("a block is cut off")
    magic, docs, n, lanes, letters, size, crc, body_crc = HEAD.unpack_from(block)
    body = memoryview(block)[HEAD.size :]
    if magic != MAGIC or len(body) < docs * 13 + size or zlib.crc32(body) != body_crc:
        raise ValueError("a block is damaged")
    doc_ids = np.frombuffer(body, "<i8", docs).tolist()
    null = np.frombuffer(body, np.uint8, docs, 8 * docs)
    for k in np.flatnonzero(null).tolist():
        doc_ids[k] = None
    sizes = np.frombuffer(body, "<u4", docs, 9 * docs).astype(np.int64)
    at = 13 * docs
    planes = np.frombuffer(zlib.decompress(body[at : at + size]), np.uint8)
    if len(planes) != 4 * letters or int(sizes.sum()) != n:
        raise ValueError("a block is damaged")
    table = np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1), dtype=np.int64)
    flat = table[decode_symbols(bytes(body[at + size :]), n, lanes, letters)].astype("<u4") if n else np.zeros(0, "<u4")
    if zlib.crc32(flat.tobytes()) != crc:
        raise ValueError("a block's ids don't match their checksum")
    return doc_ids, sizes, flat


FILE_SCHEMA = "part int, block long, n_docs int, n_ids long, data binary"


def write_files(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tokenizer: str | None = None, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """Writes all documents in ascending order of id and returns the table of files.

    A file (``part``) is the concatenation of its blocks; files ascend too.
    The table lies in the shared folder, written by Spark's own committer.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or bpe.default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Rows of one id, or without one, may be many: they spread by the hash of the text, and equal rows by their place.
    keyed = rows.select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    ordered = keyed.repartitionByRange("id", "h", "m").sortWithinPartitions("id", "h", "text").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(path)
        part, block, held = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        sizes: list[np.ndarray] = []
        tokens: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            data = encode_block(doc_ids, np.concatenate(sizes), np.concatenate(tokens))
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "block": [block], "n_docs": pa.array([len(doc_ids)], pa.int32()), "n_ids": [held], "data": pa.array([data], pa.binary())}
            )

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for rows, found, counts in encode.runs(batch.column("text")):
                flat, each = bpe.ended(found, counts, end_id)
                ends = np.cumsum(each)
                first = 0
                while first < len(each):
                    # The block closes with the document that fills it.
                    behind = int(ends[first - 1]) if first else 0
                    stop = min(int(np.searchsorted(ends, behind + block_ids - held)) + 1, len(each))
                    doc_ids += ids[rows.start + first : rows.start + stop]
                    sizes.append(each[first:stop])
                    tokens.append(flat[behind : ends[stop - 1]])
                    held += int(ends[stop - 1]) - behind
                    if held >= block_ids:
                        yield close()
                        doc_ids, sizes, tokens, held, block = [], [], [], 0, block + 1
                    first = stop
        if doc_ids:
            yield close()

    return written(ordered.mapInArrow(write, FILE_SCHEMA), "id-files")


def read_files(files: DataFrame) -> DataFrame:
    """Decodes the files: part, block, place (in the block), doc_id, before (ids ahead in the block), ids."""
    small_batches(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs, sizes, flat = decode_block(batch.column("data")[k].as_py())
                n = len(docs)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(n, batch.column("part")[k].as_py(), dtype=np.int32)),
                        "block": pa.array(np.full(n, batch.column("block")[k].as_py(), dtype=np.int64)),
                        "place": pa.array(np.arange(n, dtype=np.int32)),
                        "doc_id": pa.array(docs, pa.int64()),
                        "before": pa.array(np.cumsum(sizes) - sizes),
                        "ids": bpe.binary(flat, sizes),
                    }
                )

    return files.select("part", "block", "data").mapInArrow(read, "part int, block long, place int, doc_id long, before long, ids binary")


def block_starts(files: DataFrame) -> DataFrame:
    """(part, block, block_start): the ids of all blocks before each block.

    Files are summed first, so that the one ordered window sees a row per file.
    """
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = files.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("in_part"))
    return blocks.join(parts, blocks["part"] == parts["p"]).select("part", "block", (F.col("part_start") + F.col("in_part")).alias("block_start"))
