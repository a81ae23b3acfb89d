"""Sequence packing: shortest-pack-first over the length histogram.

1. Documents become token ids; those longer than a sequence are cut into full
   pieces and a rest.
2. The histogram of piece lengths (at most ``size`` bins) goes to the driver.
   Lengths are placed longest first, each into the pattern with the most room,
   whole counts at a time; patterns split when counts differ.
3. Every piece gets its rank among the pieces of its length, from sorted
   buckets and the sums of the buckets before, so that a hot length spreads
   over many tasks; runs of ranks map back to places in the patterns.

Defined results
---------------
* A null text is empty: one piece, the end id alone.  Rows with equal ids are
  packed as documents of their own.
* sequence_id runs from 0 without gaps, offsets within a sequence too.
* An empty table gives no pieces.  Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paginal.llm import bpe
from paginal.llm.common import small_batches, written

#: Ids in a sequence, and the id that ends each document.
SIZE, END_ID = 1024, 0
#: Rows of one length that are ranked together, roughly; least and most buckets of a length.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 100_000, 256, 1 << 16


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (32-bit little-endian) of every piece."""
    small_batches(docs.sparkSession)
    path = tokenizer or bpe.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(path)
        for batch in batches:
            for rows, ids, counts in encode.runs(batch.column("text")):
                flat, sizes = bpe.ended(ids, counts, end_id)
                n = -(-sizes // size)
                which = np.repeat(np.arange(len(sizes)), n)
                start = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(sizes[which] - start, size)
                doc = batch.column("id").slice(rows.start, len(sizes)).take(pa.array(which))
                columns = [doc, pa.array(start), pa.array(length), pa.array(sizes[which]), bpe.binary(flat, length)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first: (lengths of a pattern, how many sequences use it)."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    most = np.zeros(size + 1, dtype=bool)

    def put(pattern: tuple[int, ...], left: int, count: int) -> None:
        room.setdefault(left, []).append((pattern, count))
        most[left] = True

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} ids")
        while count:
            fitting = np.flatnonzero(most[length:])
            if not len(fitting):
                # No pattern has room: fresh ones take as many of this length as they hold.
                deep = size // length
                whole, rest = divmod(count, deep)
                if whole:
                    put((length,) * deep, size - length * deep, whole)
                if rest:
                    put((length,) * rest, size - length * rest, 1)
                break
            left = length + int(fitting[-1])
            pattern, held = room[left].pop()
            most[left] = bool(room[left])
            taken = min(held, count)
            put((*pattern, length), left - length, taken)
            if held > taken:
                put(pattern, left, held - taken)
            count -= taken
    return sorted(((p, n) for group in room.values() for p, n in group), reverse=True)


def places(found: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length, runs of ranks: (first rank, first sequence, offset)."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for pattern, count in found:
        offset = 0
        for length in pattern:
            at = ranks.get(length, 0)
            out.setdefault(length, []).append((at, first, offset))
            ranks[length] = at + count
            offset += length
        first += count
    return out


def assign(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces; cut is read several times."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, total // BUCKET_ROWS))
    runs = places(patterns(histogram, size))
    # At most a few patterns per length: a step fills up a length or a pattern.
    table = spark.createDataFrame(
        [(length, [r[0] for r in got], [r[1] for r in got], [r[2] for r in got]) for length, got in runs.items()],
        "length long, ranks array<long>, firsts array<long>, offsets array<long>",
    )
    dealt = cut.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    held = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("length", "__bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__before"))
    order = Window.partitionBy("length", "__bucket").orderBy("doc_id", "start")
    ranked = dealt.withColumn("__rank", F.row_number().over(order) - 1).join(before, ["length", "__bucket"])
    rank = F.col("__rank") + F.col("__before")
    run = F.size(F.filter("ranks", lambda r: r <= rank))
    return (
        ranked.join(F.broadcast(table), "length")
        .withColumn("__run", run)
        .withColumn("sequence_id", F.element_at("firsts", F.col("__run")) + rank - F.element_at("ranks", F.col("__run")))
        .withColumn("offset", F.element_at("offsets", F.col("__run")))
        .select(*cut.columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Places every id of every document: pieces with sequence_id and offset.

    ids_crc32 is the checksum of a piece's ids; ``with_ids`` carries the ids too.
    """
    cut = pieces(docs, size=size, end_id=end_id, tokenizer=tokenizer).withColumn("ids_crc32", F.crc32("ids"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    return assign(written(cut.select(*columns), "pieces"), size).select(*columns[:5], "sequence_id", "offset", *columns[5:])


def sequences(packed: DataFrame) -> DataFrame:
    """The filled part of each sequence, from pieces with ids: sequence_id, ids, n_ids.

    A sequence has at most ``size`` pieces, so a group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda all, x: F.concat(all, x["ids"]))
    out = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_ids"))
    return out.select("sequence_id", joined.alias("ids"), "n_ids")
