"""Exact Jaccard self-join of word-shingle sets on a prefix tree.

1. Equal sets are one class, found by a digest; only its first document goes on.
2. A sketch of fixed size counts all shingles by hash.  The global order of
   shingles is by the logarithm of that count, rare ones first, then by hash.
   Any order is right; this one keeps frequent passages out of the prefixes.
3. Two sets can only be similar if they share a shingle among the first
   ``n - ceil(threshold * n) + 1`` of either: these prefixes are the upper
   edges of the tree, and they are the join key between tasks.
4. On edges with many sets, the set that shares most is tried against those of
   other components, each set with its best such centre (a star); what links
   is one component from then on.  So near copies of one text are not paired
   with each other, and no link between components is lost.
5. The sets that share an edge and lie in different components are dealt to
   one task as the tree below that edge: what follows the edge in each set's
   prefix, as far as other components share it.  The tree is walked once for
   all probes of the edge together.  A node's overlaps with all probes come
   from its parent's, and a subtree is left when its remaining length can lift
   no probe to what the rest of the sets would have to add.  Edges with more
   than ``CELL`` sets are dealt in tiles of blocks by component; a tile within
   one component has nothing to find and is not made.
6. The pairs that remain meet in cells, a probe and a bounded number of whole
   sets, and a second walk of the same kind yields their exact overlaps.

Defined results
---------------
* Every row stays.  A document with fewer words than a shingle has its whole
  sequence as the one shingle; without words or text its set is empty, it has
  0 shingles and links with nothing.
* component_id is the least id that links reach, the own id included; a row
  without an id has that of its set, if a row with an id has the set too, else none.
* Repeated rows are in the same class.  An empty table gives an empty result.
* Rows that share an id count as one document, which is linked with all that any of
  its texts is similar to; each row has the size of its own set.
* Texts of any length are read whole.  Extra columns are not carried; their names are free.
* Ties between centres go to the greater size, then the greater id; they decide nothing but the order of work.
* Sets are equal by all 64 bits of their shingles' hashes (through a digest);
  similarities are counted on 50 of them, beside the level.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paginal.llm.common import small_batches, written
from paginal.llm.components import connected_components
from paginal.llm.shingles import mix, shingle_sets

#: Least and most bits of the sketch, of the bitmap of ids; counters in one row of them; partitions that a task sums up.
LEAST_BITS, MOST_BITS, MOST_ID_BITS, CHUNK, SUMMED = 16, 24, 28, 1 << 12, 4
#: Bits of the bitmap of copies.
ID_BITS = 22
#: Share of all rows from which on a class is broadcast: so there are ten thousand such classes at most.
HOT_SHARE = 1e-4
#: Bits of a page of the bitmap of copies, as bitmap_construct_agg has them.
PAGE_BITS = 32768
#: Bits of a hash that remain beside the level in a key.
LEVEL_SHIFT = 58
#: Sets in one cell; tokens that the walk looks up at once.
CELL, STRIDE = 256, 64
#: Rounds of stars, and sets of an edge from which on it takes part in them.
STARS, HOT = 3, 8


def _least(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """ceil(percent / 100 * n)."""
    return -(-percent * n // 100)


def sketch(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """Counts of 64-bit keys by their upper bits; keys_of takes them from a batch of rows.

    Each task sums in an array of 2**bits counters over a few partitions (all,
    where there are few), so that its work is bounded and what it sends is
    small beside what it reads.  The driver gets the logarithms, a byte for
    each counter.
    """
    parts = rows.rdd.getNumPartitions()
    few = rows.coalesce(max(2, 2 * rows.sparkSession.sparkContext.defaultParallelism, -(-parts // SUMMED)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for keys in keys_of(batch):
                np.add.at(total, (keys >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        for first in range(0, 1 << bits, CHUNK):
            part = total[first : first + CHUNK]
            if part.any():
                packed = zlib.compress(part.tobytes(), 1)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([first // CHUNK], pa.int32()), "counts": pa.array([packed], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(min(CHUNK, 1 << bits), dtype=np.uint64)
        for run in group.column("counts"):
            total += np.frombuffer(zlib.decompress(run.as_py()), "<u4")
        level = np.where(total > 0, np.floor(np.log2(np.maximum(total, 1))) + 1, 0).astype(np.uint8)
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "levels": pa.array([level.tobytes()], pa.binary())})

    rows = few.mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, levels binary").collect()
    out = np.zeros(1 << bits, dtype=np.uint8)
    for r in rows:
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["levels"], np.uint8)
    return out


def ordered_keys(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Keys whose order is the global order: level, then hash."""
    bits = int(len(levels)).bit_length() - 1
    level = levels[(hashes >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    return level << np.uint64(LEVEL_SHIFT) | hashes >> np.uint64(64 - LEVEL_SHIFT)


def _shingle_keys(width: int) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, h in shingle_sets(batch.column(0).to_pylist(), width):
            yield h

    return keys


def _id_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield mix(batch.column(0).to_numpy().astype(np.uint64))


def _prefixes(docs: DataFrame, sent: object, width: int, percent: int) -> DataFrame:
    """id, n, digest, prefix (ordered keys as longs) of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in batches:
            n_all: list[int] = []
            digests: list[bytes | None] = []
            flat: list[np.ndarray] = []
            for _, ends, h in shingle_sets(batch.column("text").to_pylist(), width):
                keys = ordered_keys(h, levels)
                first = 0
                for end in ends.tolist():
                    n = end - first
                    n_all.append(n)
                    digests.append(hashlib.md5(h[first:end].tobytes()).digest() if n else None)
                    flat.append(np.sort(keys[first:end])[: n - _least(n, percent) + 1] if n else keys[:0])
                    first = end
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)),
                pa.array(np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)),
            )
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_all, pa.int64()), pa.array(digests, pa.binary()), lists], names=["id", "n", "digest", "prefix"])

    return docs.mapInArrow(read, "id long, n long, digest binary, prefix array<long>")


def _sets_of(docs: DataFrame, wanted: DataFrame, sent: object, width: int) -> DataFrame:
    """(id, keys): whole ordered sets of the wanted ids.

    A bitmap of hashed ids of fixed size passes over other rows before their
    text is touched; the join that follows is exact.
    """
    spark = docs.sparkSession
    # About 32 bits for each wanted row, within fixed bounds.
    bits = max(LEAST_BITS, min(MOST_ID_BITS, max(1, wanted.count()).bit_length() + 5))
    seen = np.packbits(sketch(wanted.select("id"), _id_keys, bits) > 0)
    bitmap = spark.sparkContext.broadcast(seen)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in batches:
            at = (mix(batch.column("id").to_numpy().astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            hit = bitmap.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            part = batch.filter(pa.array(hit.astype(bool)))
            ids = part.column("id").to_pylist()
            for begin, ends, h in shingle_sets(part.column("text").to_pylist(), width):
                keys = ordered_keys(h, levels)
                sets = [packed(np.sort(x)) for x in np.split(keys, ends[:-1])]
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[begin : begin + len(sets)], pa.int64()), "keys": pa.array(sets, pa.binary())})

    return docs.where(F.col("id").isNotNull()).mapInArrow(read, "id long, keys binary")


def _first_of_class(held: DataFrame, classes: DataFrame) -> DataFrame:
    """id, n, prefix of the first document of each class.

    Copies are few as a rule, so a bitmap of their hashed ids (fixed size) lets
    most rows stay where they are; rows that it marks are told apart by a join.
    """
    known = _with_class(held.select("id", "digest"), classes, ["rep"])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << ID_BITS))
    copies = known.where(F.col("id") != F.col("rep")).select((place % PAGE_BITS).alias("bit"), F.floor(place / PAGE_BITS).alias("page"))
    bitmap = copies.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    at = (place % PAGE_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = held.withColumn("p", F.floor(place / PAGE_BITS)).join(F.broadcast(bitmap), F.col("p") == F.col("page"), "left")
    marked = F.coalesce(F.getbit(byte, at % 8), F.lit(0)) == 1
    rest = rows.where(marked).join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    return rows.where(~marked).select("id", "n", "prefix").unionByName(rest.select("id", "n", "prefix"))


def _with_class(rows: DataFrame, classes: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a digest and their class's columns, null where no row with an id has the set.

    The classes of many rows, ten thousand at most, are broadcast, so that the
    copies of one text stay where they are; the others meet in an exchange.
    """
    own = classes.select(F.col("digest").alias("d"), "copies", *columns)
    least = max(1000, int(HOT_SHARE * (classes.agg(F.sum("copies").alias("n")).first()["n"] or 0)))
    hot = F.broadcast(own.where(F.col("copies") > least).drop("copies"))
    near = rows.join(hot, F.col("digest") == F.col("d")).drop("d")
    far = rows.join(hot.select("d"), F.col("digest") == F.col("d"), "left_anti")
    far = far.join(own.where(F.col("copies") <= least).drop("copies"), F.col("digest") == F.col("d"), "left").drop("d")
    return near.unionByName(far)


def packed(keys: np.ndarray) -> bytes:
    """Keys without their last 8 bits, in 7 bytes each."""
    return (keys >> np.uint64(8)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), dtype=np.uint8)
    out[:, :7] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 7)
    return out.view("<u8").reshape(-1)


def tree_links(probe: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Which sets have the similarity with the probe: one walk over their prefix tree.

    The sets, sorted as sequences, are the tree's paths from left to right; a
    path shares with its left neighbour what both begin with, so depth-first
    search keeps the overlap and the probe's position at each depth of the
    current path, and goes on from where the next path leaves it.
    """
    if not len(probe):
        return []
    order = sorted((k for k in range(len(sets)) if len(sets[k])), key=lambda k: sets[k].astype(">u8").tobytes())
    n_x = len(probe)
    out: list[int] = []
    path = np.zeros(0, dtype=np.uint64)
    overlap = np.zeros(1, dtype=np.int64)
    passed = np.zeros(1, dtype=np.int64)
    for k in order:
        s = sets[k]
        n_y = len(s)
        # 100 * common >= percent * (n_x + n_y - common)
        need = -(-percent * (n_x + n_y) // (100 + percent))
        known = min(len(path), n_y, len(overlap) - 1)
        differ = np.flatnonzero(path[:known] != s[:known])
        depth = int(differ[0]) if len(differ) else known
        overlap, passed = overlap[: depth + 1], passed[: depth + 1]
        path = s
        while depth < n_y and overlap[-1] + min(n_y - depth, n_x - int(passed[-1])) >= need:
            part = s[depth : depth + STRIDE]
            at = np.searchsorted(probe, part)
            hit = probe[np.minimum(at, n_x - 1)] == part
            overlap = np.concatenate([overlap, overlap[-1] + np.cumsum(hit)])
            passed = np.concatenate([passed, at + hit])
            depth += len(part)
        if depth == n_y and overlap[-1] >= need:
            out.append(k)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, sent: object, width: int, percent: int) -> DataFrame:
    """The pairs (x, y) that have the similarity, from whole sets."""
    pairs = written(pairs.select("x", "y"), "pairs")
    if pairs.isEmpty():
        return pairs
    per_probe = pairs.groupBy(F.col("x").alias("px")).agg(F.count("*").alias("m"))
    cells = pairs.join(per_probe, pairs["x"] == per_probe["px"]).select(
        "x", "y", F.pmod(F.xxhash64("y"), F.ceil(F.col("m") / CELL)).alias("cell")
    )
    # The probe's own set goes to each of its cells, ahead of the others.
    own = cells.select("x", "cell").distinct().select("x", "cell", F.col("x").alias("y"))
    members = written(cells.select("x", "cell", "y").unionByName(own), "cells")
    sets = _sets_of(docs, members.select(F.col("y").alias("id")).distinct(), sent, width)
    rows = members.join(sets, members["y"] == sets["id"]).select("x", "cell", "y", (F.col("x") != F.col("y")).alias("other"), "keys")
    dealt = rows.repartition("x", "cell").sortWithinPartitions("x", "cell", "other")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        # Texts that share an id are probes of their own.
        probes: list[np.ndarray] = []
        ids: list[int] = []
        sets: list[np.ndarray] = []

        def found() -> pa.RecordBatch:
            ys = sorted({ids[k] for probe in probes for k in tree_links(probe, sets, percent)})
            return pa.RecordBatch.from_pydict({"x": pa.array([at[0]] * len(ys), pa.int64()), "y": pa.array(ys, pa.int64())})

        for batch in batches:
            for x, cell, y, keys in zip(*(batch.column(c).to_pylist() for c in ("x", "cell", "y", "keys"))):
                if (x, cell) != at:
                    if ids:
                        yield found()
                    at, probes, ids, sets = (x, cell), [], [], []
                if x == y:
                    probes.append(unpacked(keys))
                else:
                    ids.append(y)
                    sets.append(unpacked(keys))
        if ids:
            yield found()

    return dealt.mapInArrow(walk, "x long, y long")


def _need(percent: int) -> Column:
    """The least number of common shingles of sets of sizes nx and ny."""
    return F.ceil(F.lit(percent) * (F.col("nx") + F.col("ny")) / (100 + percent))


def _enough(shared: Column | str, percent: int) -> Column:
    """Whether so many shared prefix shingles, with all that lies behind, allow the similarity.

    What a pair shares beyond the shorter-reaching prefix is at most what that
    set has left, hence the greater of both remainders.
    """
    rest = F.greatest(*(F.ceil(F.lit(percent) * F.col(c) / 100) - 1 for c in ("nx", "ny")))
    return (F.col(shared) if isinstance(shared, str) else shared) + rest >= _need(percent)


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings with their component c."""
    return postings.join(labels, postings["id"] == labels["v"], "left").select(*postings.columns, F.coalesce("c", "id").alias("c"))


def _star(hot: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of an edge's centre and a set of another component; the best centre of each set."""
    known = written(_labelled(hot, labels), "labelled")
    centres = known.groupBy(F.col("g").alias("h")).agg(F.max(F.struct("pull", "n", "id", "c")).alias("centre"))
    pairs = known.join(centres, F.col("g") == F.col("h")).where(F.col("c") != F.col("centre.c"))
    pairs = pairs.select(F.col("centre.id").alias("x"), F.col("centre.n").alias("nx"), F.col("id").alias("y"), F.col("n").alias("ny"))
    near = pairs.where(_sizes_fit("nx", "ny", percent)).groupBy("x", "nx", "y", "ny").agg(F.count("*").alias("c"))
    return near.where(_enough("c", percent)).groupBy("y").agg(F.max(F.struct("c", "x")).alias("best")).select("best.x", "y")


def _wanted(nx: Column, ny: Column, percent: int) -> Column:
    """How much sets of these sizes must share of their prefixes below their first common edge."""
    need = F.ceil(F.lit(percent) * (nx + ny) / (100 + percent))
    return need - F.greatest(F.ceil(F.lit(percent) * nx / 100), F.ceil(F.lit(percent) * ny / 100))


def _tails(known: DataFrame, percent: int) -> DataFrame:
    """(g, m, id, n, at, c, tail): sets of edges that different components share, and what follows on such edges.

    Of edges with the same sets, only the first leads anywhere: below it, the
    others are part of the tails.  Sets of ids are told apart by two xors of
    64-bit hashes and their size.  A set also leaves an edge where its tail is
    too short for any size that the edge's sets have: what must be shared
    grows, then falls with the partner's size, so it is least at the ends of
    the sizes that fit (less one for rounding).
    """
    stats = known.groupBy(F.col("g").alias("h")).agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.bit_xor(F.xxhash64("id")).alias("one"), F.bit_xor(F.xxhash64(F.lit("two"), "id")).alias("two"),
    )
    # Less by 2**63, keys are in their global order, that of unsigned numbers.
    place = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    alike = Window.partitionBy("one", "two", "m")
    stats = stats.where(F.col("lo") != F.col("hi")).withColumn("first", F.min(place).over(alike) == place).drop("lo", "hi", "one", "two")
    live = known.join(stats, F.col("g") == F.col("h"))
    path = F.array_sort(F.collect_list(F.struct("at", "g", "m", "least", "most", "first")))
    paths = live.groupBy("id", "n", "c").agg(path.alias("path"))
    low = F.greatest(F.col("e.least"), F.ceil(F.lit(percent) * F.col("n") / 100))
    high = F.least(F.col("e.most"), F.floor(F.lit(100) * F.col("n") / percent))
    wanted = F.least(_wanted(F.col("n"), low, percent), _wanted(F.col("n"), high, percent)) - 1
    each = paths.select("id", "n", "c", F.transform("path", lambda e: e["g"]).alias("keys"), F.posexplode("path").alias("i", "e"))
    kept = each.where(F.col("e.first") & (low <= high) & (F.size("keys") - F.col("i") - 1 >= wanted))
    return kept.select("e.g", "e.m", "id", "n", "e.at", "c", F.slice("keys", F.col("i") + 2, F.size("keys")).alias("tail"))


def _tiled(big: DataFrame) -> DataFrame:
    """Rows of edges with many sets, dealt to tiles: (b1, b2) and the row's own block b.

    A component with many sets has blocks of its own, the others share blocks;
    each two blocks make a tile unless both hold one and the same component.
    """
    big = written(big, "big")
    held = big.groupBy(F.col("g").alias("h"), F.col("c").alias("hc")).agg(F.count("*").alias("mc"))
    whole = F.col("mc") >= CELL
    of_own = F.xxhash64(F.lit("own"), "c", F.pmod(F.xxhash64("id"), F.ceil(F.col("mc") / CELL)))
    of_many = F.xxhash64(F.lit("many"), F.pmod(F.xxhash64("c"), F.ceil(F.col("m") / CELL)))
    rows = written(big.join(held, (F.col("g") == F.col("h")) & (F.col("c") == F.col("hc"))).withColumn("b", F.when(whole, of_own).otherwise(of_many)).drop("h", "hc", "mc"), "blocks")
    blocks = rows.groupBy("g", "b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    one = blocks.select(F.col("g").alias("f"), F.col("b").alias("b1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    two = blocks.select(F.col("g").alias("h"), F.col("b").alias("b2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    same = (F.col("lo1") == F.col("hi1")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo1") == F.col("lo2"))
    tiles = one.join(two, (F.col("f") == F.col("h")) & (F.col("b1") <= F.col("b2")) & ~same)
    asked = tiles.select("f", "b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("own"))
    return rows.join(asked, (F.col("g") == F.col("f")) & (F.col("b") == F.col("own"))).select(*big.columns, "b1", "b2", "b")


def edge_pairs(n: np.ndarray, ids: np.ndarray, at: np.ndarray, comp: np.ndarray, block: np.ndarray, tails: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of sets of different components below one edge whose prefixes share enough: one walk of their tree.

    The tree holds what follows the edge in each set, in the global order of
    keys (the order in which they stand).  With several blocks, only pairs of
    different blocks count.
    """
    members = len(ids)
    size = np.fromiter(map(len, tails), dtype=np.int64, count=members)
    rest = _least(n, percent) - 1
    several = (block != block[:1]).any()

    def asked(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For some sets, which probes can link with each, and the overlap below the edge that each must have at least."""
        y = some[:, None]
        need = -(-percent * (n + n[y]) // (100 + percent))
        want = need - np.maximum(rest, rest[y]) - 1
        mask = (comp != comp[y]) & ((n < n[y]) | ((n == n[y]) & (ids < ids[y])))
        mask &= (100 * n >= percent * n[y]) & (100 * n[y] >= percent * n) & (at + need <= n) & (at[y] + need <= n[y])
        mask &= np.minimum(size, size[y]) >= want
        return (mask & (block != block[y]) if several else mask), want

    masks: list[np.ndarray] = []
    wants: list[np.ndarray] = []
    for first in range(0, members, 64):
        mask, want = asked(np.arange(first, min(first + 64, members)))
        masks += list(mask)
        wants += list(want)
    if not any(mask.any() for mask in masks):
        return []
    flat = np.concatenate(tails)
    keys, place = np.unique(flat.view(np.uint64), return_inverse=True)
    has = np.zeros((len(keys), members), dtype=np.int32)
    has[place, np.repeat(np.arange(members), size)] = 1
    ends = np.cumsum(size)
    paths = [place[a:b] for a, b in zip(ends - size, ends)]
    order = sorted(range(members), key=lambda k: paths[k].astype(">u4").tobytes())
    out: list[tuple[int, int]] = []
    probes = [(masks[y], wants[y]) for y in order]
    least = np.array([int(want[mask].min()) if mask.any() else 1 << 40 for mask, want in probes])
    stack = [(0, members, 0, np.zeros(members, dtype=np.int64))]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        left = int(size[order[lo:hi]].max()) - depth
        if not (overlap + np.minimum(left, size - overlap) >= least[lo:hi].min()).any():
            continue
        # Sets that end at this node stand first.
        while lo < hi and (size[order[lo]] == depth or hi - lo == 1):
            mask, want = probes[lo]
            path = paths[order[lo]][depth:]
            total = overlap + has[path].sum(axis=0) if len(path) else overlap
            y = int(ids[order[lo]])
            out += [(x, y) for x in ids[mask & (total >= want)].tolist()]
            lo += 1
        if lo == hi:
            continue
        heads = np.array([paths[k][depth] for k in order[lo:hi]])
        cuts = [0, *(np.flatnonzero(heads[1:] != heads[:-1]) + 1).tolist(), len(heads)]
        stack += [(lo + a, lo + b, depth + 1, overlap + has[heads[a]]) for a, b in zip(cuts[:-1], cuts[1:])]
    return out


#: Overlap counts that a tile of an edge may hold in memory; beyond it, probes are walked in parts.
COUNTS = 1 << 26


def _rest(shared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share an edge and can reach the similarity, by walks below the edges."""
    rows = written(_tails(written(_labelled(shared, labels), "labelled"), percent), "tails")
    few = rows.where(F.col("m") <= CELL).select("*", *(F.lit(0).cast("long").alias(b) for b in ("b1", "b2", "b")))
    big = rows.where(F.col("m") > CELL)
    dealt = few if big.isEmpty() else few.unionByName(_tiled(big))
    sorted_ = dealt.drop("m").repartition("g", "b1", "b2").sortWithinPartitions("g", "b1", "b2")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[tuple] = []

        def found() -> pa.RecordBatch:
            ids, n, first, comp, block = (np.array(x, dtype=np.int64) for x in zip(*(h[:5] for h in held)))
            tails = [h[5] for h in held]
            pairs: list[tuple[int, int]] = []
            # Blocks of probes and members, so that what a walk holds is bounded; every two meet in one of the walks.
            step = max(1, COUNTS // max(1, sum(map(len, tails))) // 2)
            parts = [np.arange(a, min(a + step, len(ids))) for a in range(0, len(ids), step)]
            for i, one in enumerate(parts):
                for other in parts[i:]:
                    both = one if other is one else np.concatenate([one, other])
                    side = block[both] if other is one else np.where(np.arange(len(both)) < len(one), 0, 1)
                    got = edge_pairs(n[both], ids[both], first[both], comp[both], side, [tails[k] for k in both], percent)
                    if other is not one and len(set(block.tolist())) > 1:
                        of = dict(zip(ids[both].tolist(), block[both].tolist()))
                        got = [(x, y) for x, y in got if of[x] != of[y]]
                    pairs += got
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["x", "y"])

        for batch in batches:
            lists = batch.column("tail")
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            columns = [batch.column(c).to_pylist() for c in ("g", "b1", "b2", "id", "n", "at", "c", "b")]
            for k, (g, b1, b2, *row) in enumerate(zip(*columns)):
                if (g, b1, b2) != at:
                    if len(held) > 1:
                        yield found()
                    at, held = (g, b1, b2), []
                held.append((*row, values[ends[k] : ends[k + 1]].copy()))
        if len(held) > 1:
            yield found()

    return sorted_.mapInArrow(walk, "x long, y long").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: components of components, one link for each pair of them."""
    old = labels.select(F.col("v").alias("k"), F.col("c").alias("kc"))
    one = links.join(old, links["x"] == old["k"], "left").select(F.coalesce("kc", "x").alias("a"), "y")
    both = one.join(old, one["y"] == old["k"], "left").select("a", F.coalesce("kc", "y").alias("b"))
    fresh = connected_components(both.where(F.col("a") != F.col("b")).distinct(), "a", "b").select(F.col("v").alias("u"), F.col("c").alias("uc"))
    # A component's label is the label of its label; what had none becomes linked.
    moved = labels.join(fresh, labels["c"] == fresh["u"], "left").select("v", F.coalesce("uc", "c").alias("c"))
    added = fresh.join(labels, fresh["u"] == labels["v"], "left_anti").select(F.col("u").alias("v"), F.col("uc").alias("c"))
    return written(moved.unionByName(added), "labels")


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return (F.lit(100) * F.col(a) >= F.lit(percent) * F.col(b)) & (F.lit(100) * F.col(b) >= F.lit(percent) * F.col(a))


def _shared(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, object, DataFrame, DataFrame, DataFrame]:
    """Rows, the sent sketch, each row's prefix, classes, and the postings of edges with two sets at least."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # About 16 counters a document, within fixed bounds.
    bits = max(LEAST_BITS, min(MOST_BITS, max(1, rows.count()).bit_length() + 4))
    sent = spark.sparkContext.broadcast(sketch(rows.select("text"), _shingle_keys(width), bits))
    own = written(_prefixes(rows, sent, width, percent), "prefixes")
    held = own.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = written(held.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = written(_first_of_class(held, classes), "classes")
    postings = reps.select("id", "n", F.posexplode("prefix").alias("at", "g"))

    # Edges with two sets at least.
    edges = postings.groupBy(F.col("g").alias("h")).agg(F.count("*").alias("m")).where(F.col("m") > 1)
    shared = written(postings.join(edges, F.col("g") == F.col("h")).select("g", "id", "n", "at", "m"), "postings")
    return rows, sent, own, classes, shared


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(x, y) of all pairs of classes, by their class_id, that have the similarity; x < y, each pair once.

    Documents of one class are equal and not listed: with class_id of
    ``jaccard_components`` the links are those of all documents.  The result
    has all pairs of near copies, so it can grow with the square of a group.
    """
    rows, sent, _, _, shared = _shared(docs, id_col, text_col, width, percent)
    apart = docs.sparkSession.createDataFrame([], "v long, c long")
    found = _verified(_rest(shared.drop("m"), apart, percent), rows, sent, width, percent)
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, class_id (least id of equal sets), component_id of every row."""
    spark = docs.sparkSession
    rows, sent, own, classes, shared = _shared(docs, id_col, text_col, width, percent)
    hot = shared.where(F.col("m") >= HOT)
    # What shares most is nearest to the middle of a group of near copies.
    weight = hot.groupBy(F.col("id").alias("w")).agg(F.sum("m").alias("pull"))
    hot = written(hot.join(weight, hot["id"] == weight["w"]).select("g", "id", "n", "pull"), "hot")

    labels = written(spark.createDataFrame([], "v long, c long"), "labels")
    for _ in range(STARS):
        found = written(_verified(_star(hot, labels, percent), rows, sent, width, percent), "links")
        if found.isEmpty():
            break
        labels = _merged(labels, found)
    found = written(_verified(_rest(shared.drop("m"), labels, percent), rows, sent, width, percent), "links")
    labels = _merged(labels, found.unionByName(_same_id(own, classes)))

    known = written(classes.join(labels, F.col("rep") == F.col("v"), "left").select("digest", "copies", "rep", "c"), "components")
    sizes = own.select("id", "n", "digest")
    none = F.lit(None).cast("long")
    member = sizes.where(F.col("digest").isNull()).select(*sizes.columns, none.alias("rep"), none.alias("c"))
    member = member.unionByName(_with_class(sizes.where(F.col("digest").isNotNull()), known, ["rep", "c"]))
    return member.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("c", "rep", "id").alias("component_id"))


def _same_id(own: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (x, y) between the classes of texts that share an id; none where ids are unique."""
    held = own.where(F.col("id").isNotNull() & F.col("digest").isNotNull()).select("id", "digest")
    several = held.groupBy(F.col("id").alias("i")).agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where(F.col("least") != F.col("most"))
    several = written(several.select("i"), "same-id")
    if several.isEmpty():
        return held.sparkSession.createDataFrame([], "x long, y long")
    found = _with_class(held.join(several, F.col("id") == F.col("i"), "left_semi"), classes, ["rep"]).select("id", "rep").distinct()
    least = found.groupBy(F.col("id").alias("i")).agg(F.min("rep").alias("x"))
    return found.join(least, F.col("id") == F.col("i")).where(F.col("x") != F.col("rep")).select("x", F.col("rep").alias("y"))
