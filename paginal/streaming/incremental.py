"""Keeps postings up to date as new pages arrive.

Each micro-batch is indexed alone and written as its own partition
(``batch=<id>``), overwriting only itself, so a replayed batch changes nothing.
Postings of a page never span batches, because a page arrives whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paginal.operators import index


def index_stream(pages: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts indexing a stream of (page_id, text) into folder/postings."""

    def write(batch: DataFrame, number: int) -> None:
        found = index.postings(index.occurrences(batch)).sortWithinPartitions("term", "page_id")
        found.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/postings/batch={number}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The postings of all batches so far."""
    return spark.read.option("basePath", f"{folder}/postings").parquet(f"{folder}/postings/batch=*")
