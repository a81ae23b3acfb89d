"""Reads folders of book databases: one SQLite file per book, named by its id.

Files come through Spark's binaryFile source, so any file system will do and
files are read in parallel; each is opened from memory by Python's sqlite3.
Unreadable files and missing tables give no rows.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables and columns of the book databases, with our types.
TABLES = {
    "book": "nass string, id int, page int, part string",
    "title": "tit string, lvl int, sub int, id int",
    "0bok": "bkid int, bk string, cat int, betaka string, inf string, authno int",
    "0cat": "id int, cat string",
    "auth": "authid int, auth string",
}
FILE_NAME = r"(?:^|/)(\d+)\.sqlite$"


def book_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, book_id, content) of the files that are named by digits."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sqlite").load(folder)
    named = files.select("path", F.regexp_extract("path", FILE_NAME, 1).alias("digits"), "content")
    return named.where(F.col("digits") != "").select("path", F.try_to_number("digits", F.lit("9" * 18)).cast("long").alias("book_id"), "content")


def _rows(content: bytes, sql: str) -> list[tuple]:
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        return db.execute(sql).fetchall()
    except sqlite3.Error:
        return []
    finally:
        db.close()


def read_table(files: DataFrame, name: str) -> DataFrame:
    """One table of all book files, with the book's id and seq, the row's place in its table."""
    schema = TABLES[name]
    columns = [c.split()[0] for c in schema.split(", ")]
    sql = f'SELECT {", ".join(columns)} FROM "{name}" ORDER BY rowid'
    whole = {c.split()[0] for c in schema.split(", ") if c.endswith(" int")}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book, content in zip(batch["book_id"], batch["content"]):
                out = pd.DataFrame(_rows(content, sql), columns=columns)
                for c in columns:
                    out[c] = pd.to_numeric(out[c], errors="coerce").astype("Int32") if c in whole else out[c].map(lambda v: None if v is None else str(v))
                out.insert(0, "book_id", book)
                out["seq"] = range(len(out))
                yield out

    # A file is one row here; one at a time bounds the memory.
    return files.select("book_id", "content").mapInPandas(read, f"book_id long, {schema}, seq long")


def read_books(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a folder: rows, titles, meta, categories, authors."""
    files = book_files(spark, folder)
    names = {"rows": "book", "titles": "title", "meta": "0bok", "categories": "0cat", "authors": "auth"}
    return {k: read_table(files, v) for k, v in names.items()}


def book_database(tables: dict[str, list[tuple]]) -> bytes:
    """A book database of tables by name, their rows in order."""
    db = sqlite3.connect(":memory:")
    try:
        for name, rows in tables.items():
            columns = [c.split()[0] for c in TABLES[name].split(", ")]
            db.execute(f'CREATE TABLE "{name}" ({", ".join(columns)})')
            db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(columns))})', [tuple(v.item() if hasattr(v, "item") else v for v in row) for row in rows])
        db.commit()
        return db.serialize()
    finally:
        db.close()
