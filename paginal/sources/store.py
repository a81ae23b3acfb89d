"""Stored corpora: Parquet tables under one folder, laid out for their lookups.

Postings are sorted by term and pages by page_id within range partitions, so
that filters on terms and page ids prune row groups by their statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sort key of each table: what it is looked up by.
KEYS = {
    "pages": ["page_id"], "postings": ["term", "page_id"], "dictionary": ["term"], "occurrences": ["term", "page_id"], "books": ["book_id"],
    "chapters": ["book_id", "chapter_number"], "titles": ["book_id", "id"], "metadata": ["bkid"], "categories": ["id"], "authors": ["authid"],
    "book_authors": ["book_id"], "comments": ["page_id"], "formatting": ["page_id"], "highlights": ["page_id"],
}
_ANCHOR = "page_id: integer, anchor_start: integer, anchor_end: integer, flags: integer"
#: Columns that a stored table must have, and the kind of each.
REQUIRED = {
    "pages": "page_id: integer, text: string",
    "postings": "term: string, page_id: integer, tf: integer, positions: array",
    "dictionary": "term: string, cf: integer, df: integer",
    "occurrences": "term: string, page_id: integer, pos: integer",
    "books": "book_id: integer, page_count: integer, first_page_id: integer, text_start: integer, text_end: integer",
    "chapters": "chapter_id: integer, book_id: integer, chapter_number: integer, start_page: integer, title: string, level: integer, sub: integer",
    "titles": "book_id: integer, id: integer, tit: string, lvl: integer, sub: integer",
    "metadata": "bkid: integer, bk: string, cat: integer, betaka: string, inf: string, authno: integer",
    "categories": "id: integer, cat: string",
    "authors": "authid: integer, auth: string",
    "book_authors": "book_id: integer, author_id: integer",
    "comments": f"{_ANCHOR}, kind: integer, author_id: integer, created_at: integer, updated_at: integer, text: string",
    "formatting": f"{_ANCHOR}, layer: integer, priority: integer",
    "highlights": f"{_ANCHOR}, color_id: integer, category_id: integer",
}
_KINDS = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "string": "string"}


def problems(df: DataFrame, name: str) -> list[str]:
    """What a table lacks, or has in another kind, of what it must have."""
    kinds = {f.name: _KINDS.get(f.dataType.simpleString(), f.dataType.typeName()) for f in df.schema.fields}
    wanted = [c.split(": ") for c in REQUIRED[name].split(", ")] if name in REQUIRED else []
    return [f"{c} is {kinds.get(c, 'missing')}, not {kind}" for c, kind in wanted if kinds.get(c) != kind]


def write(df: DataFrame, folder: str, name: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Writes a table in order of its key; partition_by names columns for partition pruning."""
    keys = KEYS.get(name, df.columns[:1])
    laid = df.repartitionByRange(*(F.col(k) for k in [*(partition_by or []), *keys])).sortWithinPartitions(*(partition_by or []), *keys)
    out = laid.write.mode(mode).option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Reads a table and checks that it has the columns it must have, of their kinds."""
    df = spark.read.parquet(f"{folder}/{name}")
    found = problems(df, name)
    if found:
        raise ValueError(f"{name}: {'; '.join(found)}")
    return df
