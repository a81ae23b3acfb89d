"""Books: page assembly, text layout, chapters, metadata, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paginal.operators.prefix import dense_number, prefix_sum

#: Bytes of a text block.
BLOCK_BYTES = 65536


def assemble_pages(rows: DataFrame) -> DataFrame:
    """Pages of (book_id, id, page, nass): fragments in order of id, a line end after each.

    Rows without text are dropped.  page_id numbers pages by book and page.
    """
    parts = F.array_sort(F.collect_list(F.struct("id", "nass")))
    pages = (
        rows.where(F.col("nass").isNotNull() & (F.col("nass") != ""))
        .groupBy("book_id", F.col("page").alias("page_number"))
        .agg(F.concat(F.array_join(F.transform(parts, lambda p: p["nass"]), "\n"), F.lit("\n")).alias("text"))
    )
    return dense_number(pages, "book_id", ["page_number"], "page_id").select("page_id", "book_id", "page_number", "text")


def block_layout(pages: DataFrame) -> DataFrame:
    """Where each page lies in one run of text cut into blocks: block_id, offset_in_block, length (bytes)."""
    sized = pages.withColumn("length", F.octet_length("text").cast("long"))
    placed = prefix_sum(sized, "book_id", ["page_id"], F.col("length"), "text_offset")
    return placed.select(
        "page_id", "book_id", "length", "text_offset",
        F.floor(F.col("text_offset") / BLOCK_BYTES).cast("long").alias("block_id"), (F.col("text_offset") % BLOCK_BYTES).alias("offset_in_block"),
    )


def book_summary(pages: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Per book: page_count, first_page_id, text_start and text_end offsets, and chapter_count."""
    layout = block_layout(pages)
    books = layout.groupBy("book_id").agg(
        F.count("*").alias("page_count"),
        F.min("page_id").alias("first_page_id"),
        F.min("text_offset").alias("text_start"),
        F.max(F.col("text_offset") + F.col("length")).alias("text_end"),
    )
    if chapters is None:
        return books
    counts = chapters.groupBy("book_id").agg(F.count("*").alias("chapter_count"))
    return books.join(counts, "book_id", "left").withColumn("chapter_count", F.coalesce("chapter_count", F.lit(0)))


def number_chapters(titles: DataFrame) -> DataFrame:
    """Chapters of (book_id, id, tit, lvl, sub): headings without text dropped, numbered by start page.

    Headings of one page stay in the order of ``seq``, the row's place in its
    source, if the table has it, else they go by title.
    """
    kept = titles.where(F.col("tit").isNotNull() & (F.col("tit") != ""))
    order = ["id", "seq" if "seq" in titles.columns else "tit"]
    own = kept.withColumn("chapter_number", F.row_number().over(Window.partitionBy("book_id").orderBy(*order)))
    return dense_number(own, "book_id", order, "chapter_id").select(
        "chapter_id", "book_id", "chapter_number", F.col("id").alias("start_page"), F.col("tit").alias("title"), F.col("lvl").alias("level"), "sub"
    )


def chapter_spans(chapters: DataFrame) -> DataFrame:
    """Adds next_start: the next strictly later start in the book, null for the last."""
    later = Window.partitionBy("book_id").orderBy("start_page").rangeBetween(1, Window.unboundedFollowing)
    return chapters.withColumn("next_start", F.min("start_page").over(later))


def assign_chapters(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, page_number, chapter_number): the last chapter that starts at or before a page, else 0.

    One sort per book interleaves starts and pages, instead of a join on ranges.
    """
    starts = chapters.select("book_id", F.col("start_page").alias("page_number"), "chapter_number", F.lit(0).alias("__is_page"))
    marks = starts.unionByName(pages.select("book_id", "page_number", F.lit(None).cast("int").alias("chapter_number"), F.lit(1).alias("__is_page")))
    so_far = Window.partitionBy("book_id").orderBy("page_number", "__is_page", "chapter_number").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.withColumn("chapter_number", F.last("chapter_number", ignorenulls=True).over(so_far))
    return seen.where(F.col("__is_page") == 1).select("book_id", "page_number", F.coalesce("chapter_number", F.lit(0)).alias("chapter_number"))


def chapter_ranges(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """Per chapter: first_page_id and page_count of the pages from its start to the next later one.

    Chapters with the same start all count the range.  A chapter without pages has count 0.
    """
    spans = chapter_spans(chapters)
    inside = (F.col("page_number") >= F.col("start_page")) & (F.col("next_start").isNull() | (F.col("page_number") < F.col("next_start")))
    joined = spans.join(pages.select(F.col("book_id").alias("b"), "page_number", "page_id"), (F.col("book_id") == F.col("b")) & inside, "left")
    return joined.groupBy("book_id", "chapter_number", "start_page").agg(
        F.min("page_id").alias("first_page_id"), F.count("page_id").alias("page_count")
    )


def _first(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The first row of each key."""
    values = F.struct(*columns)
    place = F.struct(*(c for c in ("book_id", "seq") if c in rows.columns)) if "seq" in rows.columns else values
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(values, place).alias("v")).select(key, "v.*")


def book_metadata(books: DataFrame, meta: DataFrame, categories: DataFrame, authors: DataFrame) -> DataFrame:
    """Every book with its title, category and author; what is missing is null.

    meta: (bkid, bk, cat, betaka, inf, authno); categories: (id, cat); authors: (authid, auth).
    The first row of an id counts, by source (``book_id``) and place in it (``seq``); tables
    without these have no order, and the least row counts.
    """
    first_meta = _first(meta, "bkid", ["bk", "cat", "betaka", "inf", "authno"])
    names = _first(categories, "id", ["cat"]).select(F.col("id").alias("cat_id"), F.col("cat").alias("category"))
    people = _first(authors, "authid", ["auth"]).select(F.col("authid").alias("auth_id"), F.col("auth").alias("author"))
    return (
        books.join(first_meta, F.col("book_id") == F.col("bkid"), "left")
        .join(names, F.col("cat") == F.col("cat_id"), "left")
        .join(people, F.col("authno") == F.col("auth_id"), "left")
        .select(*books.columns, F.col("bk").alias("title"), F.col("betaka").alias("card"), F.col("inf").alias("info"), "category", "author")
    )


def book_authors(meta: DataFrame) -> DataFrame:
    """The bridge of books and authors; books without an author are left out."""
    return meta.where(F.col("authno").isNotNull() & (F.col("authno") != 0)).select(F.col("bkid").alias("book_id"), F.col("authno").alias("author_id")).distinct()


def page_text(pages: DataFrame, page_ids: list[int]) -> DataFrame:
    """Pages by id; the filter reaches the scan."""
    return pages.where(F.col("page_id").isin(page_ids))
