"""The positional index: occurrences, vocabulary, postings, dictionary, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paginal.functions.text import hash64_bits, tokens, unsigned
from paginal.operators.prefix import prefix_sums

# Fixed values of the storage model: bytes of a block's length field, of a page entry, of a position, of the file header.
LENGTH_BYTES, PAGE_BYTES, POSITION_BYTES, HEADER_BYTES = 4, 8, 4, 52
#: Page numbers of a block of a term's postings; values summed at once; leading characters that group terms in order.
BLOCK_PAGES, RUN, LEAD = 1 << 16, 256, 3
#: Tokens whose postings are gathered at once; a longer page goes alone.
GATHERED = 1 << 18


def occurrences(pages: DataFrame) -> DataFrame:
    """(term, page_id, pos) of every token of every page."""
    return pages.where(F.col("text") != "").select("page_id", F.posexplode(tokens("text")).alias("pos", "term")).select("term", "page_id", "pos")


def vocabulary(occ: DataFrame) -> DataFrame:
    """Distinct terms."""
    return occ.select("term").distinct()


def hash_collisions(occ: DataFrame) -> DataFrame:
    """Hashes that different terms share, with the terms; empty on sound data."""
    # Counted first, in order of the hash alone; only terms of a shared one are collected.
    hashed = vocabulary(occ).select(hash64_bits("term").alias("bits"), "term")
    shared = hashed.withColumn("n", F.count("*").over(Window.partitionBy("bits"))).where(F.col("n") > 1)
    return shared.groupBy("bits").agg(F.collect_set("term").alias("terms")).select(unsigned("bits").alias("word_hash"), "terms")


def page_terms(pages: DataFrame) -> DataFrame:
    """(term): the terms of pages, each once for some pages that lie together; for a vocabulary, without a row a token."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends = lists.offsets.to_numpy()
            for low, high in cut_lengths(np.diff(ends)):
                yield pa.RecordBatch.from_arrays([lists.values.slice(int(ends[low]), int(ends[high] - ends[low])).unique()], names=["term"])
            del batch, lists, ends

    return pages.where(F.col("text") != "").select(tokens("text").alias("words")).mapInArrow(gather, "term string")


def postings(occ: DataFrame) -> DataFrame:
    """(term, page_id, tf, positions) of occurrences in any order: positions ascend.

    Occurrences are dealt and ordered by page alone; lots of whole pages then
    become postings at once.  Memory holds GATHERED occurrences, or one page.
    """
    schema = occ.select("term", "page_id", F.lit(0).alias("tf"), F.array("pos").alias("positions")).schema

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, GATHERED
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= enough:
                lot = pa.Table.from_batches(held).combine_chunks()
                pages = numbers(lot["page_id"])[1]
                whole = int(np.flatnonzero(pages != pages[-1])[-1]) + 1 if pages[0] != pages[-1] else 0
                if whole:
                    yield grouped(lot.slice(0, whole))
                # The last page may go on; its rows are copied, so that the lot is freed.
                held = lot.take(pa.array(np.arange(whole, size))).to_batches()
                size -= whole
                enough = max(GATHERED, 2 * size)
        if size:
            yield grouped(pa.Table.from_batches(held).combine_chunks())

    def numbers(values: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        coded = values.chunk(0).dictionary_encode(null_encoding="encode")
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64)

    def grouped(lot: pa.Table) -> pa.RecordBatch:
        (terms, code), (ids, page), pos = numbers(lot["term"]), numbers(lot["page_id"]), lot["pos"].chunk(0)
        known = pos.is_valid().to_numpy(zero_copy_only=False)
        code += page * len(terms)
        order = np.lexsort((pos.fill_null(0).to_numpy(), code))
        code, known = code[order], known[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        ends = np.append(first, len(order))
        edges = np.append(0, np.cumsum(known))[ends].astype(np.int32)
        positions = pa.ListArray.from_arrays(pa.array(edges), pos.take(pa.array(order[known])))
        columns = [terms.take(pa.array(code[first] % len(terms))), ids.take(pa.array(code[first] // len(terms))), pa.array(np.diff(ends).astype(np.int32)), positions]
        return pa.RecordBatch.from_arrays(columns, names=["term", "page_id", "tf", "positions"])

    return occ.select("term", "page_id", "pos").repartition("page_id").sortWithinPartitions("page_id").mapInArrow(gather, schema)


def cut_lengths(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lists that hold GATHERED elements at most, or one list."""
    total, low = np.cumsum(size, dtype=np.int64), 0
    while low < len(size):
        done = int(total[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(total, done + GATHERED, side="right")))
        yield low, high
        low = high


def page_postings(pages: DataFrame) -> DataFrame:
    """The same from pages, one row a page: a page's postings are made where its row lies, so that no token moves.

    Texts are split by built-in expressions; the tokens of some pages then
    become numbers, and one stable sort by page and number brings equal ones
    together.  So many pages are taken at once as have GATHERED tokens, however
    many rows a batch has, so memory does not grow with the batch.  (Grouping
    tokens in an exchange, or in the row by array expressions, takes some four
    times as long.)
    """
    schema = pages.select(F.lit("").alias("term"), "page_id", F.lit(0).alias("tf"), F.array().cast("array<int>").alias("positions")).schema

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.columns
            ends = lists.offsets.to_numpy()
            for low, high in cut_lengths(np.diff(ends)):
                yield grouped(ids.slice(low, high - low), ends[low : high + 1], lists.values)
            # Else the batch lives on while the next one is read.
            del batch, ids, lists, ends

    def grouped(ids: pa.Array, ends: np.ndarray, values: pa.Array) -> pa.RecordBatch:
        ends = ends.astype(np.int64)
        size = np.diff(ends)
        words = values.slice(int(ends[0]), int(ends[-1] - ends[0])).dictionary_encode()
        code, letters = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
        page = np.repeat(np.arange(len(size)), size)
        order = np.argsort(page * letters + code, kind="stable")
        page, code = page[order], code[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (page[1:] != page[:-1]) | (code[1:] != code[:-1])
        first = np.flatnonzero(fresh)
        edges = np.append(first, len(order)).astype(np.int32)
        pos = (order - (ends[:-1] - ends[0])[page]).astype(np.int32)
        positions = pa.ListArray.from_arrays(pa.array(edges), pa.array(pos))
        columns = [words.dictionary.take(pa.array(code[first])), ids.take(pa.array(page[first])), pa.array(np.diff(edges)), positions]
        return pa.RecordBatch.from_arrays(columns, names=["term", "page_id", "tf", "positions"])

    return pages.where(F.col("text") != "").select("page_id", tokens("text").alias("words")).mapInArrow(gather, schema)


def _by_block(post: DataFrame) -> DataFrame:
    """Postings with their block of pages, dealt by (term, block): a frequent term spreads over its blocks."""
    return post.withColumn("block", F.floor(F.col("page_id") / BLOCK_PAGES)).repartition("term", "block")


def _blocks(dealt: DataFrame, value: Column, name: str) -> DataFrame:
    """(t, b, name) of every block of every term."""
    return dealt.groupBy(F.col("term").alias("t"), F.col("block").alias("b")).agg(value.alias(name))


def _with(dealt: DataFrame, blocks: DataFrame) -> DataFrame:
    # Each row has its block; an inner join's filter for null keys would part the exchanges of the two sides.
    return dealt.join(blocks, (F.col("term") == F.col("t")) & (F.col("block") == F.col("b")), "left").drop("t", "b")


def encode_deltas(post: DataFrame, starts: bool = False) -> DataFrame:
    """(term, page_id, page_delta, tf, position_deltas): each number less the one before.

    starts adds block and behind: the block of pages, and the last page of the
    term before it, from which decoding can begin at any block.
    """
    dealt = _by_block(post)
    order = Window.partitionBy("t").orderBy("b")
    # All columns are named, so that blocks and postings read one exchange; else pages are split once more for the narrower one.
    page = F.coalesce(F.when(F.size("positions") == F.col("tf"), F.col("page_id")), F.col("page_id"))
    last = _blocks(dealt, F.max(page), "last").select("t", "b", F.coalesce(F.lag("last").over(order), F.lit(0)).alias("behind"))
    inside = Window.partitionBy("term", "block").orderBy("page_id")
    before = F.concat(F.array(F.lit(0)), F.slice("positions", 1, F.size("positions") - 1))
    # The first position is its own delta.
    moved = F.when(F.size("positions") > 1, F.zip_with("positions", before, lambda a, b: a - b)).otherwise(F.col("positions"))
    return _with(dealt.withColumn("lagged", F.lag("page_id").over(inside)), last).select(
        "term", "page_id", (F.col("page_id") - F.coalesce("lagged", "behind")).alias("page_delta"), "tf", moved.alias("position_deltas"), *(("block", "behind") if starts else ())
    )


def _running(values: Column, start: Column) -> Column:
    """Running sums of a short array."""
    return F.aggregate(
        values, F.array().cast("array<int>"),
        lambda all, d: F.concat(all, F.array(F.coalesce(F.element_at(all, F.when(F.size(all) > 0, F.lit(-1))), start) + d)),
    )


def running_sums(values: str) -> Column:
    """Running sums of an array of any length: runs of RUN values on top of the sums before, so time grows with the length."""
    n = F.ceil(F.size(values) / RUN).cast("int")
    runs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * RUN + 1, F.lit(RUN)))
    sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, d: a + d))
    starts = F.concat(F.array(F.lit(0)), _running(F.slice(sums, 1, n - 1), F.lit(0)))
    long = F.flatten(F.zip_with(runs, starts, lambda r, s: _running(r, s)))
    return F.when(F.size(values) <= 1, F.col(values)).when(F.size(values) <= RUN, _running(F.col(values), F.lit(0))).otherwise(long)


def decode_deltas(deltas: DataFrame) -> DataFrame:
    """Postings again: running sums of page deltas per term and of position deltas.

    With the blocks' starts (``encode_deltas(post, starts=True)``) sums run
    within blocks alone; without them the starts are sums of the blocks before.
    """
    dealt = deltas if "behind" in deltas.columns else _by_block(deltas)
    inside = Window.partitionBy("term", "block").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("own", F.sum("page_delta").over(inside))
    if "behind" not in deltas.columns:
        ahead = Window.partitionBy("t").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        placed = _with(placed, _blocks(dealt, F.sum("page_delta"), "moved").select("t", "b", F.coalesce(F.sum("moved").over(ahead), F.lit(0)).alias("behind")))
    return placed.select("term", (F.col("behind") + F.col("own")).alias("page_id"), "tf", running_sums("position_deltas").alias("positions"))


def dictionary(occ: DataFrame) -> DataFrame:
    """(term, cf, df): occurrences and pages of each term, from occurrences."""
    return occ.groupBy("term", "page_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def posting_dictionary(post: DataFrame) -> DataFrame:
    """The same from postings: one narrow exchange of partial sums."""
    return post.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def block_sizes(words: DataFrame) -> DataFrame:
    """Adds block_bytes: the encoded size of a term's postings, from its cf and df."""
    return words.withColumn("block_bytes", F.lit(LENGTH_BYTES) + PAGE_BYTES * F.col("df") + POSITION_BYTES * F.col("cf"))


def stored_dictionary(words: DataFrame) -> DataFrame:
    """A dictionary (term, cf, df) with word_hash, block_index and postings_offset, in order of the unsigned hash.

    Numbers and offsets sum up within the 65536 ranges of the hash's top two
    bytes, on top of the ranges before.
    """
    hashed = block_sizes(words).withColumn("bits", hash64_bits("term"))
    # Less by 2**63, signed bits are in the order of the unsigned ones.
    keyed = hashed.withColumn("range", F.shiftrightunsigned("bits", 48)).withColumn("at", F.col("bits").bitwiseXOR(F.lit(-(1 << 63))))
    placed = prefix_sums(keyed, "range", ["at"], {"postings_offset": LENGTH_BYTES + F.col("block_bytes"), "block_index": F.lit(1)})
    return placed.select("term", unsigned("bits").alias("word_hash"), "cf", "df", "block_bytes", (F.lit(HEADER_BYTES) + F.col("postings_offset")).alias("postings_offset"), "block_index")


def stored_blocks(stored: DataFrame) -> DataFrame:
    """One row for each block of postings in order: index, offset, encoded and plain bytes, ratio.

    Blocks are stored as they are, without compression: no plain size is kept, and the ratio is 1.
    """
    return stored.select("block_index", "postings_offset", F.col("block_bytes").alias("stored_bytes"), F.lit(0).cast("long").alias("plain_bytes"), F.lit(1.0).alias("ratio"))


def sorted_occurrences(post: DataFrame) -> DataFrame:
    """Every occurrence of postings with its rank in order of term, page, position.

    Blocks of a term's pages are placed by their sums, pages within their
    block, positions within their page: no task orders all rows, nor all rows
    of a term, and occurrences are made last.
    """
    dealt = _by_block(post)
    blocks = _blocks(dealt, F.sum("tf"), "n").withColumn("lead", F.left("t", F.lit(LEAD)))
    starts = prefix_sums(blocks, "lead", ["t", "b"], {"start": F.col("n")}).select("t", "b", "start")
    ahead = Window.partitionBy("term", "block").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = _with(dealt.withColumn("in_block", F.coalesce(F.sum("tf").over(ahead), F.lit(0))), starts)
    base = F.col("start") + F.col("in_block")
    return placed.select("term", "page_id", base.alias("base"), F.posexplode("positions").alias("i", "pos")).select("term", "page_id", "pos", (F.col("base") + F.col("i") + 1).cast("long").alias("rank"))


def block_stats(words: DataFrame) -> DataFrame:
    """One row of totals of a dictionary: terms, occurrences, bytes encoded with and without length fields."""
    return block_sizes(words).agg(
        F.count("*").alias("blocks"),
        F.sum("cf").alias("occurrences"),
        F.sum("block_bytes").alias("block_bytes"),
        F.sum(F.col("block_bytes") + LENGTH_BYTES).alias("stored_bytes"),
        F.max("block_bytes").alias("largest_block"),
    )
