import sqlite3

import pytest

from paginal.operators import books
from paginal.plans import corpus
from paginal.sources import sqlite_books, store


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_assembly(spark):
    data = [(1, 2, 5, "b"), (1, 1, 5, "a"), (1, 3, 2, "c"), (1, 4, 9, ""), (2, 1, 1, None), (2, 2, 1, "d")]
    got = rows(books.assemble_pages(spark.createDataFrame(data, "book_id long, id int, page int, nass string")))
    assert got == [(0, 1, 2, "c\n"), (1, 1, 5, "a\nb\n"), (2, 2, 1, "d\n")]


def test_layout(spark):
    pages = spark.createDataFrame([(0, 1, "a" * 65530), (1, 1, "é" * 5), (2, 2, "x")], "page_id long, book_id long, text string")
    got = rows(books.block_layout(pages).select("page_id", "length", "text_offset", "block_id", "offset_in_block"))
    assert got == [(0, 65530, 0, 0, 0), (1, 10, 65530, 0, 65530), (2, 1, 65540, 1, 4)]
    assert rows(books.book_summary(pages).select("book_id", "page_count", "first_page_id", "text_start", "text_end")) == [(1, 2, 0, 0, 65540), (2, 1, 2, 65540, 65541)]


def test_chapters_with_equal_starts(spark):
    pages = spark.createDataFrame([(i, 1, p) for i, p in enumerate([1, 3, 5, 8])], "page_id long, book_id long, page_number long")
    titles = spark.createDataFrame([(1, 3, "b", 1, 0), (1, 3, "c", 1, 0), (1, 8, "d", 1, 0), (1, 1, "", 1, 0)], "book_id long, id long, tit string, lvl int, sub int")
    chapters = books.number_chapters(titles)
    assert rows(chapters.select("chapter_id", "chapter_number", "start_page", "title")) == [(0, 1, 3, "b"), (1, 2, 3, "c"), (2, 3, 8, "d")]
    assert rows(books.assign_chapters(pages, chapters)) == [(1, 1, 0), (1, 3, 2), (1, 5, 2), (1, 8, 3)]
    ranges = rows(books.chapter_ranges(pages, chapters).select("chapter_number", "first_page_id", "page_count"))
    assert ranges == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]


@pytest.fixture
def folder(tmp_path):
    def make(name, texts, titles=(), meta=()):
        db = sqlite3.connect(tmp_path / name)
        db.execute("create table book(nass text, id int, page int, part text)")
        db.executemany("insert into book values (?,?,?,'1')", texts)
        db.execute("create table title(tit text, lvl int, sub int, id int)")
        db.executemany("insert into title values (?,1,0,?)", titles)
        if meta:
            db.execute('create table "0bok"(bkid int, bk text, cat int, betaka text, inf text, authno int)')
            db.executemany('insert into "0bok" values (?,?,?,?,?,?)', meta)
            db.execute('create table "0cat"(id int, cat text)')
            db.execute("insert into \"0cat\" values (4, 'law')")
            db.execute("create table auth(authid int, auth text)")
            db.execute("insert into auth values (9, 'someone')")
        db.commit()
        db.close()

    make("7.sqlite", [("first page", 1, 1), ("more of it", 2, 1), ("second page", 3, 2)], [("start", 2)], [(7, "A Book", 4, "card", None, 9)])
    make("12.sqlite", [("another first", 1, 1)])
    make("notes.sqlite", [("not a book", 1, 1)])
    (tmp_path / "99.sqlite").write_bytes(b"broken")
    return str(tmp_path)


def test_reading_books(spark, folder):
    got = sqlite_books.read_books(spark, folder)
    assert rows(got["rows"].select("book_id", "id", "page", "nass")) == [(7, 1, 1, "first page"), (7, 2, 1, "more of it"), (7, 3, 2, "second page"), (12, 1, 1, "another first")]
    assert got["titles"].count() == 1 and got["authors"].first()["auth"] == "someone"


def test_whole_corpus(spark, folder, tmp_path):
    c = corpus.build_from_books(spark, folder, str(tmp_path / "out"))
    assert [r["page_id"] for r in c.search("first").collect()] == [0, 2]
    assert [r["page_id"] for r in c.search("first page").collect()] == [0]
    assert rows(c.phrase("first page").select("page_id")) == [(0,)]
    assert c.search_snippets("second page", 0, 5).first()["snippet"] == "«second page»\n"
    assert c.page(1).first()["chapter_number"] == 1
    book = {r["book_id"]: r for r in c.table("books").collect()}
    assert (book[7]["title"], book[7]["category"], book[7]["author"], book[7]["chapter_count"]) == ("A Book", "law", "someone", 1)
    assert (book[12]["title"], book[12]["page_count"]) == (None, 1)
    assert rows(c.table("book_authors")) == [(7, 9)]


def test_store_checks_columns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "postings"))
    with pytest.raises(ValueError):
        store.read(spark, str(tmp_path), "postings")


def test_first_row_counts(spark):
    """Metadata by its place in the source, not by its value; headings of one page too."""
    from paginal.operators import books as B

    meta = spark.createDataFrame([(1, "z", 1, None, None, 5, 0, 0), (1, "a", 2, "c", None, 5, 0, 1)], "bkid int, bk string, cat int, betaka string, inf string, authno int, book_id long, seq long")
    cats = spark.createDataFrame([(1, "second", 3, 0), (1, "first", 2, 9)], "id int, cat string, book_id long, seq long")
    people = spark.createDataFrame([(5, None, 0, 0), (5, "b", 0, 1)], "authid int, auth string, book_id long, seq long")
    got = B.book_metadata(spark.createDataFrame([(1,), (2,)], "book_id long"), meta, cats, people)
    assert sorted(map(tuple, got.collect())) == [(1, "z", None, None, "first", None), (2, None, None, None, None, None)]
    titles = spark.createDataFrame([(1, 3, "b", 1, 0, 0), (1, 3, "a", 1, 0, 1)], "book_id long, id int, tit string, lvl int, sub int, seq long")
    assert [r["title"] for r in sorted(B.number_chapters(titles).collect(), key=lambda r: r["chapter_number"])] == ["b", "a"]


def test_stored_tables_are_checked(spark, tmp_path):
    from paginal.sources import store

    good = spark.createDataFrame([(1, 0, 2, 1, 0, 0, 0, 0, "x")], "page_id long, anchor_start int, anchor_end int, flags int, kind int, author_id int, created_at long, updated_at long, text string")
    store.write(good, str(tmp_path), "comments")
    assert store.read(spark, str(tmp_path), "comments").count() == 1
    assert store.problems(good.drop("text"), "comments") == ["text is missing, not string"]
    store.write(good.withColumn("flags", good["text"]), str(tmp_path), "comments")
    with pytest.raises(ValueError, match="flags is string"):
        store.read(spark, str(tmp_path), "comments")
    assert set(store.REQUIRED) == set(store.KEYS)
