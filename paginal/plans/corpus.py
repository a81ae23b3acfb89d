"""A stored corpus: built from book rows or pages, then searched many times."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from paginal.functions.query import NO_RESULTS, NO_TOKENS, TWO_NEEDED, parse, read_line
from paginal.operators import annotations, books, index, search, snippets
from paginal.sources import store
from paginal.sources.sqlite_books import read_books


@dataclass
class Corpus:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return store.read(self.spark, self.folder, name)

    def search(self, line: str, offset: int = 0, limit: int = 0) -> DataFrame:
        """(page_id, score) in order; reads the postings of the query's terms only."""
        return search.top(search.search_postings(self.table("postings"), line), offset, limit)

    def search_snippets(self, line: str, offset: int = 0, limit: int = 10, exact: bool = False) -> DataFrame:
        """A page of hits with snippets; exact drops hits after the page is cut."""
        hits = self.search(line, offset, limit)
        return snippets.snippets(hits, self.table("pages"), line, exact, most=limit or None).orderBy("score", "page_id", ascending=[False, True])

    def phrase(self, line: str) -> DataFrame:
        """Pages that hold the line's tokens in a row."""
        terms = parse(line).words
        return search.phrase(search.matches_in_postings(self.table("postings"), terms), terms)

    def phrase_by_category(self, line: str, category: str = "category") -> DataFrame:
        terms = parse(line).words
        if len(terms) < 2:
            raise ValueError("need at least two tokens")
        labelled = self.table("postings").join(self.table("pages").select("page_id", category), "page_id")
        return search.phrase(search.matches_in_postings(labelled, terms, [category]), terms, [category])

    def browser_phrase(self, line: str) -> DataFrame:
        """Pages that hold the line's words in a row, the words taken as a browser does."""
        return search.browser_phrase(self.table("postings"), line)

    def answer(self, raw: bytes, limit: int = 0) -> DataFrame:
        """(line): the results of a raw query line as text, best first, or one line that says why there are none."""
        line = read_line(raw)
        if not parse(line).terms:
            return self._said(NO_TOKENS)
        hits = self.search(line, 0, limit)
        return self._said(NO_RESULTS) if hits.isEmpty() else search.result_lines(hits)

    def answer_phrase(self, raw: bytes, category: str = "category") -> DataFrame:
        """The same of a phrase by category: category and page, in their order."""
        line = read_line(raw)
        if len(parse(line).words) < 2:
            return self._said(TWO_NEEDED)
        hits = self.phrase_by_category(line, category).orderBy(category, "page_id")
        return self._said(NO_RESULTS) if hits.isEmpty() else search.result_lines(hits)

    def _said(self, message: str) -> DataFrame:
        return self.spark.createDataFrame([(message,)], "line string")

    def page(self, page_id: int) -> DataFrame:
        return books.page_text(self.table("pages"), [page_id])

    def runs(self, n_tokens: DataFrame) -> DataFrame:
        return annotations.merge_runs(n_tokens, self.table("formatting"), self.table("highlights"))


def build(pages: DataFrame, folder: str) -> Corpus:
    """Writes pages, postings and dictionary of (page_id, ..., text)."""
    spark = pages.sparkSession
    store.write(pages, folder, "pages")
    stored = store.read(spark, folder, "pages")
    store.write(index.page_postings(stored), folder, "postings")
    store.write(index.posting_dictionary(store.read(spark, folder, "postings")), folder, "dictionary")
    return Corpus(spark, folder)


def build_from_books(spark: SparkSession, source: str, folder: str) -> Corpus:
    """Reads a folder of book databases and writes the whole corpus."""
    raw = read_books(spark, source)
    pages = books.assemble_pages(raw["rows"])
    chapters = books.number_chapters(raw["titles"])
    numbered = books.assign_chapters(pages, chapters)
    for name, table in {"chapters": chapters, "titles": raw["titles"], "metadata": raw["meta"], "categories": raw["categories"], "authors": raw["authors"]}.items():
        store.write(table, folder, name)
    corpus = build(pages.join(numbered, ["book_id", "page_number"]), folder)
    summary = books.book_summary(corpus.table("pages"), corpus.table("chapters"))
    store.write(books.book_metadata(summary, raw["meta"], raw["categories"], raw["authors"]), folder, "books")
    store.write(books.book_authors(raw["meta"]), folder, "book_authors")
    return corpus
