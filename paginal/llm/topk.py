"""Exact top-k inner-product search by term-at-a-time accumulation.

Candidates stay where they are read: each task turns its vectors into small
blocks of postings (term -> slots and weights).  Query rows arrive as broadcasts
of a checked size; for each term of the query rows, the weighted postings are
added into dense score arrays, one slot per candidate.  A partition selection
keeps the k best of a block, a merge keeps the k best of a task, and a window
over the per-task winners gives the final ranks.

Queries beyond one broadcast are dealt by a hash of their ids into lots, each
answered in a pass of its own: its queries come to the driver, go out, and its
winners are written, before the next pass starts.  So nothing grows with the
data except the number of passes.

Defined results
---------------
* Vectors that are null, or that hold a null, NaN or infinite component, take
  no part, neither as queries nor as candidates; nor do rows with a null id.
* A shorter vector counts as padded with zeros.
* A candidate row with the query's own id is the query's own row.
* Repeated candidate rows are separate candidates.  Of repeated query rows
  with one id the greatest vector (array order) is the query.
* Ties go to the smaller id.  An empty table gives an empty result.
* Extra columns are not carried; their names are free.
* Integer weights must keep every score within a long; otherwise it raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paginal.llm.common import written

#: Bytes of query vectors in one broadcast, the bound on what a pass sends out.
QUERY_BYTES = 64 << 20
#: Candidates in one block of postings, and query rows scored together.
BLOCK_ROWS, QUERY_ROWS = 4096, 64
#: A term with postings in more than this share of a block is kept as a full row.
FULL_SHARE = 0.5


class Postings:
    """A block of candidates as postings: for each term, slots and weights."""

    def __init__(self, ids: np.ndarray, rows: list[np.ndarray]):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        width = max(map(len, rows), default=0)
        self.matrix = np.zeros((width, len(rows)), dtype=np.int64)
        for slot, k in enumerate(order):
            self.matrix[: len(rows[k]), slot] = rows[k]
        self.peak = int(np.abs(self.matrix).max(initial=0))
        self.terms = []
        for weights in self.matrix:
            slots = np.flatnonzero(weights)
            if len(slots) > FULL_SHARE * len(weights):
                self.terms.append((slice(None), weights))
            else:
                self.terms.append((slots, weights[slots]))

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Dense scores, queries by slots; queries: rows of term weights."""
        width = min(queries.shape[1], len(self.terms))
        most = self.peak * int(np.abs(queries).max(initial=0)) * max(width, 1)
        if most >= 2**63:
            raise ValueError("a score could exceed a long")
        kind = np.int32 if most < 2**31 else np.int64
        out = np.zeros((len(queries), len(self.ids)), dtype=kind)
        for term in range(width):
            slots, weights = self.terms[term]
            asking = np.flatnonzero(queries[:, term])
            if not len(asking) or not len(weights):
                continue
            part = np.multiply.outer(queries[asking, term].astype(kind), weights.astype(kind))
            if isinstance(slots, slice) and len(asking) == len(queries):
                out += part
            elif isinstance(slots, slice):
                out[asking] += part
            else:
                out[np.ix_(asking, slots)] += part
        return out


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best of each row; ids ascend, own is left out."""
    blocked = ids[None, :] == own[:, None]
    work = scores.astype(np.int64, copy=True)
    low = np.iinfo(np.int64).min
    work[blocked] = low
    n = work.shape[1]
    if n > k:
        edge = np.partition(work, n - k, axis=1)[:, n - k]
        above = work > edge[:, None]
        # Slots at the edge value are taken by ascending id until k are found.
        level = work == edge[:, None]
        spare = k - above.sum(axis=1)
        keep = above | (level & (np.cumsum(level, axis=1) <= spare[:, None]))
    else:
        keep = np.ones_like(blocked)
    keep &= ~blocked
    row, slot = np.nonzero(keep)
    return row, ids[slot], work[row, slot]


class Best:
    """The k best candidates so far of every query of a pass."""

    def __init__(self, queries: int, k: int):
        self.k, self.ids = k, np.zeros((queries, k), dtype=np.int64)
        self.scores = np.zeros((queries, k), dtype=np.int64)
        self.count = np.zeros(queries, dtype=np.int64)

    def merge(self, first: int, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows = np.arange(first, first + (int(row.max()) + 1 if len(row) else 0))
        if not len(rows):
            return
        filled = np.arange(self.k)[None, :] < self.count[rows][:, None]
        held, column = np.nonzero(filled)
        all_row = np.concatenate([held, row])
        all_ids = np.concatenate([self.ids[rows][held, column], ids])
        all_scores = np.concatenate([self.scores[rows][held, column], scores])
        order = np.lexsort((all_ids, -all_scores, all_row))
        all_row, all_ids, all_scores = all_row[order], all_ids[order], all_scores[order]
        starts = np.searchsorted(all_row, np.arange(len(rows) + 1))
        rank = np.arange(len(all_row)) - starts[all_row]
        keep = rank < self.k
        self.ids[first + all_row[keep], rank[keep]] = all_ids[keep]
        self.scores[first + all_row[keep], rank[keep]] = all_scores[keep]
        self.count[rows] = np.minimum(np.diff(starts), self.k)


def weights(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, weights): the integer weights of the vectors that take part."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & sound).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("weights"),
    )


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    column = batch.column("weights")
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return batch.column("id").to_numpy(), [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The k best candidates of every query row: query_id, rank, id, score."""
    spark: SparkSession = vectors.sparkSession
    candidates = weights(vectors, id_col, vector_col, scale)
    asked = weights(queries, id_col, vector_col, scale).groupBy("id").agg(F.max("weights").alias("weights"))
    stats = asked.agg(F.count("*").alias("n"), F.max(F.size("weights")).alias("width")).first()
    schema = "query_id long, vec_id long, score long"
    width = max(1, stats["width"] or 1)
    rows = max(1, query_bytes // (8 * (width + 2 * k + 3)))
    lots = max(1, -(-stats["n"] // rows))
    if lots > 1:
        asked = written(asked, "queries")
        # Lots by hash differ in size: a few more keep them within the bound.
        lots += -(-lots // 8)
    found = []
    for lot in range(lots):
        part = asked if lots == 1 else asked.where(F.pmod(F.xxhash64(F.lit("lot"), "id"), F.lit(lots)) == lot)
        taken = part.toArrow()
        ids = taken["id"].to_numpy()
        matrix = np.zeros((len(ids), width), dtype=np.int64)
        for i, row in enumerate(taken["weights"].to_pylist()):
            matrix[i, : len(row)] = row
        sent = spark.sparkContext.broadcast((ids, matrix))
        best = _ranked(_pass(candidates, sent, k, schema), k)
        if lots > 1:
            best = written(best, "winners")
            sent.unpersist()
        found.append(best)
    return reduce(DataFrame.unionByName, found)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(candidates: DataFrame, sent: Broadcast, k: int, schema: str) -> DataFrame:
    """The k best candidates of each task for each query row of the broadcast."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_rows = sent.value
        best = Best(len(query_ids), k)

        def score(block_ids: list[np.ndarray], block_rows: list[np.ndarray]) -> None:
            block = Postings(np.concatenate(block_ids), block_rows)
            for first in range(0, len(query_ids), QUERY_ROWS):
                part = slice(first, first + QUERY_ROWS)
                best.merge(first, *select(block.scores(query_rows[part]), block.ids, query_ids[part], k))

        held_ids: list[np.ndarray] = []
        held_rows: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            got, rows = rows_of(batch)
            held_ids.append(got)
            held_rows += rows
            if len(held_rows) >= BLOCK_ROWS:
                score(held_ids, held_rows)
                held_ids, held_rows = [], []
        if held_rows:
            score(held_ids, held_rows)
        row, column = np.nonzero(np.arange(k)[None, :] < best.count[:, None])
        for at in range(0, len(row), 1 << 16):
            r, c = row[at : at + (1 << 16)], column[at : at + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"query_id": query_ids[r], "vec_id": best.ids[r, c], "score": best.scores[r, c]})

    return candidates.mapInArrow(search, schema)
