"""Search: term matches, AND / OR, phrases, relevance, top lists.

All of it works on *matches*: a row per page with one array of positions for
each query term (p0, p1, ...).  From pages, tokens are filtered as they are
made and only hits are grouped.  From stored postings, a filter on
the query's terms reaches the scan, and only their postings are grouped by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paginal.functions.query import AND, OR, browser_terms, parse
from paginal.functions.text import tokens

# Fixed values of the relevance score.
FREQUENCY, PROXIMITY, PHRASE = 1.0, 2.0, 5.0


def _places(terms: tuple[str, ...]) -> list[str]:
    return [f"p{i}" for i in range(len(terms))]


def matches_in_pages(pages: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Matches of pages that hold any of the terms; other columns stay.

    Tokens are generated and filtered inside one stage of generated code; only
    the query's own hits are grouped, so texts are split once and never moved.
    """
    columns = [c for c in pages.columns if c != "text"]
    hits = pages.where(F.col("text") != "").select(*columns, F.posexplode(tokens("text")).alias("__pos", "__term"))
    found = hits.where(F.col("__term").isin(sorted(set(terms))))
    return found.groupBy(*columns).agg(*(F.collect_list(F.when(F.col("__term") == t, F.col("__pos"))).alias(p) for p, t in zip(_places(terms), terms)))


def _shifted(name: str, by: int) -> Column:
    return F.transform(name, lambda x: x - by)


def matches_in_postings(post: DataFrame, terms: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """The same from postings (term, page_id, positions)."""
    found = post.where(F.col("term").isin(sorted(set(terms))))
    empty = F.array().cast("array<int>")
    arrays = [
        F.coalesce(F.first(F.when(F.col("term") == term, F.col("positions")), ignorenulls=True), empty).alias(name) for name, term in zip(_places(terms), terms)
    ]
    return found.groupBy(*(by or []), "page_id").agg(*arrays)


def term_pages(matches: DataFrame, i: int = 0) -> DataFrame:
    """(page_id, tf) of one term."""
    return matches.where(F.size(f"p{i}") > 0).select("page_id", F.size(f"p{i}").alias("tf"))


def intersect(matches: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(page_id, tf): pages with all terms, their frequencies summed."""
    sizes = [F.size(p) for p in _places(terms)]
    return matches.where(_all(sizes)).select("page_id", _sum(sizes).cast("long").alias("tf"))


def union(matches: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(page_id, tf): pages with any term, their frequencies summed."""
    return matches.select("page_id", _sum([F.size(p) for p in _places(terms)]).cast("long").alias("tf"))


def adjacent(matches: DataFrame) -> DataFrame:
    """(page_id, tf): how often the second term directly follows the first."""
    pairs = F.size(F.array_intersect("p0", _shifted("p1", 1)))
    return matches.select("page_id", pairs.cast("long").alias("tf")).where(F.col("tf") > 0)


def has_phrase(terms: tuple[str, ...]) -> Column:
    """Whether some position starts all terms in a row."""
    starts = F.col("p0")
    for i in range(1, len(terms)):
        starts = F.array_intersect(starts, _shifted(f"p{i}", i))
    return F.size(starts) > 0


def phrase(matches: DataFrame, terms: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """Pages (and categories) that hold the exact phrase; one term alone is a phrase too."""
    return matches.where(has_phrase(terms)).select(*(by or []), "page_id")


def _all(sizes: list[Column]) -> Column:
    out = F.lit(True)
    for s in sizes:
        out = out & (s > 0)
    return out


def _sum(values: list[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out


def nearest(a: str, b: str) -> Column:
    """The least distance of positions in two arrays, null if either is empty.

    The positions are merged in order; the least distance is between neighbours
    of different arrays.
    """
    tagged = F.array_sort(
        F.concat(
            F.transform(a, lambda x: F.struct(x.alias("at"), F.lit(0).alias("side"))), F.transform(b, lambda x: F.struct(x.alias("at"), F.lit(1).alias("side")))
        )
    )
    none = F.lit(None).cast("int")
    walk = F.aggregate(
        tagged,
        F.struct(none.alias("a"), none.alias("b"), none.alias("best")),
        lambda s, x: F.struct(
            F.when(x["side"] == 0, x["at"]).otherwise(s["a"]).alias("a"),
            F.when(x["side"] == 1, x["at"]).otherwise(s["b"]).alias("b"),
            F.least(s["best"], x["at"] - F.when(x["side"] == 0, s["b"]).otherwise(s["a"])).alias("best"),
        ),
        lambda s: s["best"],
    )
    return walk


def statistics(matches: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """One row: n pages with any term, and the page count d0, d1, ... of each."""
    return matches.agg(F.count("*").alias("n"), *(F.count_if(F.size(p) > 0).alias(f"d{i}") for i, p in enumerate(_places(terms))))


def term_weights(matches: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(idx, term, df, weight): pages with any term per page with this one, 0 if there is none."""
    one = statistics(matches, terms)
    rows = F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(t).alias("term"), F.col(f"d{i}").alias("df")) for i, t in enumerate(terms)))
    return one.select("n", F.explode(rows).alias("r")).select(
        "r.idx", "r.term", "r.df", F.when(F.col("r.df") > 0, F.col("n").cast("double") / F.col("r.df")).otherwise(0.0).alias("weight")
    )


def proximity(terms: tuple[str, ...]) -> Column:
    """The sum over neighbouring query terms of 1 / (1 + least distance)."""
    parts = [F.coalesce(1.0 / (1.0 + nearest(f"p{i}", f"p{i + 1}")), F.lit(0.0)) for i in range(len(terms) - 1)]
    return _sum(parts) if parts else F.lit(0.0)


def rank(matches: DataFrame, terms: tuple[str, ...], mode: str = AND) -> DataFrame:
    """(page_id, score) of admitted pages with a positive score, not ordered.

    The statistics are one row, which a scalar subquery hands to every page.
    """
    stats = statistics(matches, terms).select(F.struct("*").alias("s")).scalar()
    scored = matches.withColumn("__s", stats)
    sizes = [F.size(p) for p in _places(terms)]
    weight = [F.when(F.col(f"__s.d{i}") > 0, F.col("__s.n").cast("double") / F.col(f"__s.d{i}")).otherwise(0.0) for i in range(len(terms))]
    score = FREQUENCY * _sum([w * s for w, s in zip(weight, sizes)]) + PROXIMITY * proximity(terms)
    if mode == AND and len(terms) > 1:
        score = score + F.when(has_phrase(terms), PHRASE).otherwise(0.0)
    admitted = scored.where(_all(sizes)) if mode == AND else scored
    kept = [c for c in matches.columns if c not in _places(terms)]
    return admitted.select(*kept, score.alias("score")).where(F.col("score") > 0)


def top(ranked: DataFrame, offset: int = 0, limit: int = 0) -> DataFrame:
    """A page of the list by falling score, then page; limit 0 means all."""
    ordered = ranked.orderBy(F.desc("score"), "page_id")
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit) if limit else ordered


def search_pages(pages: DataFrame, line: str) -> DataFrame:
    """Ranked pages for a query line, straight from page texts.

    Statistics and scores read the same exchange of the matches.
    """
    query = parse(line)
    return _ranked(matches_in_pages(pages, query.terms), query) if query.terms else _nothing(pages)


def search_postings(post: DataFrame, line: str) -> DataFrame:
    """Ranked pages for a query line, from stored postings."""
    query = parse(line)
    return _ranked(matches_in_postings(post, query.terms), query) if query.terms else _nothing(post)


def _ranked(matches: DataFrame, query) -> DataFrame:
    return rank(matches, query.terms, query.mode)


def _nothing(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "page_id long, score double")


def phrase_by_category(pages: DataFrame, line: str, category: str) -> DataFrame:
    """(category, page_id) of the exact phrase, all categories in one plan; OR is a plain term here."""
    terms = parse(line).words
    if len(terms) < 2:
        raise ValueError("need at least two tokens")
    return phrase(matches_in_pages(pages, terms), terms, [category])


__all__ = ["AND", "OR", "adjacent", "intersect", "matches_in_pages", "matches_in_postings", "phrase", "phrase_by_category", "rank", "search_pages", "search_postings", "term_pages", "term_weights", "top", "union"]


def result_lines(hits: DataFrame) -> DataFrame:
    """(line): page and score of each hit as text, or the category and the page of a phrase."""
    shown = [F.col("page_id").cast("string"), F.format_string("%.6f", "score")] if "score" in hits.columns else [F.col(c).cast("string") for c in hits.columns]
    return hits.select(F.concat_ws(" ", *shown).alias("line"))


def browser_phrase(post: DataFrame, line: str) -> DataFrame:
    """(page_id) of pages that hold a line's words in a row, the words taken as a browser does; none without words."""
    terms = tuple(browser_terms(line))
    if not terms:
        return post.select("page_id").limit(0)
    return phrase(matches_in_postings(post, terms), terms)
