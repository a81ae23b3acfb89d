import random

import pytest
from pyspark.sql import functions as F

from paginal.functions.query import parse
from paginal.operators import search
from paginal.operators.index import occurrences, postings


def test_rank_fixture(spark):
    data = [("a", 1, [1, 2, 3]), ("a", 2, [5]), ("a", 3, [7]), ("b", 2, [4]), ("b", 3, [10, 11])]
    post = spark.createDataFrame(data, "term string, page_id long, positions array<int>")
    m = search.matches_in_postings(post, ("a", "b"))
    # No page holds the phrase, so page 3 lacks its bonus of 5.
    both = [(r["page_id"], round(r["score"], 6)) for r in search.top(search.rank(m, ("a", "b"), search.AND)).collect()]
    assert both == [(3, 4.5), (2, 3.5)]
    either = [(r["page_id"], round(r["score"], 6)) for r in search.top(search.rank(m, ("a", "b"), search.OR)).collect()]
    assert either == [(3, 4.5), (2, 3.5), (1, 3.0)]


def plain_rank(pages, line):
    """The score by loops over token lists."""
    q = parse(line)
    at = {p: [[i for i, w in enumerate(ws) if w == t] for t in q.terms] for p, ws in pages.items()}
    any_page = [p for p, lists in at.items() if any(lists)]
    df = [sum(1 for p in pages if at[p][i]) for i in range(len(q.terms))]
    out = {}
    for p in any_page:
        lists = at[p]
        if q.mode == "and" and not all(lists):
            continue
        score = sum(len(any_page) / df[i] * len(x) for i, x in enumerate(lists) if df[i])
        for x, y in zip(lists, lists[1:]):
            if x and y:
                score += 2.0 / (1 + min(abs(a - b) for a in x for b in y))
        if q.mode == "and" and len(lists) > 1 and any(all(s + i in x for i, x in enumerate(lists)) for s in lists[0]):
            score += 5
        out[p] = round(score, 6)
    return out


@pytest.mark.parametrize("line", ["x y", "x y z", "x OR y", "x x", "x q", "q OR x", "z", "x OR y OR z", "OR", ""])
def test_rank_against_loops(spark, line):
    r = random.Random(7)
    pages = {p: [r.choice("xyzw") for _ in range(r.randrange(12))] for p in range(40)}
    df = spark.createDataFrame([(p, " ".join(ws)) for p, ws in pages.items()], "page_id long, text string")
    want = plain_rank(pages, line)
    for got in (search.search_pages(df, line), search.search_postings(postings(occurrences(df)), line)):
        assert {r["page_id"]: round(r["score"], 6) for r in got.collect()} == want


def test_top_pages_and_limits(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 5.0), (4, 0.5)], "page_id long, score double")
    ids = lambda x: [r["page_id"] for r in x.collect()]
    assert ids(search.top(df)) == [2, 1, 3, 4]
    assert ids(search.top(df, 1, 2)) == [1, 3]
    assert ids(search.top(df, 9, 2)) == []


def test_phrase_by_category(spark):
    df = spark.createDataFrame([(1, "k", "a OR b"), (2, "k", "a b"), (3, "l", "a OR b")], "page_id long, category string, text string")
    got = sorted(map(tuple, search.phrase_by_category(df, "a OR", "category").collect()))
    assert got == [("k", 1), ("l", 3)]
    with pytest.raises(ValueError):
        search.phrase_by_category(df, "a", "category")


def test_single_term_and_long_phrases(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(40)))), (2, "0 1")], "page_id long, text string")
    terms = tuple(map(str, range(40)))
    assert [r[0] for r in search.phrase(search.matches_in_pages(df, terms), terms).collect()] == [1]
    assert search.phrase(search.matches_in_pages(df, ("0",)), ("0",)).count() == 2


def test_lines_and_browser_words(spark, tmp_path):
    from paginal.functions import query
    from paginal.plans import corpus

    assert query.read_line(b"the of\r\nmore") == "the of" and query.read_line(b"x" * 5000) == "x" * 4095 and query.read_line(b"a\r") == "a\r"
    assert query.browser_terms(" the,\u00a0Of\u3000\ufeffOR \x1cz ") == ["the,", "Of", "OR", "\x1cz"]
    pages = spark.createDataFrame([(0, 1, "the of x", "A"), (1, 1, "of the", "B"), (2, 1, "the, of", "A")], "page_id long, book_id long, text string, category string").withColumn("page_number", F.col("page_id"))
    c = corpus.build(pages, str(tmp_path))
    said = lambda df: [r["line"] for r in df.collect()]
    assert said(c.answer(b" ., \n")) == ["no tokens"] and said(c.answer(b"zzz")) == ["no results"]
    assert said(c.answer_phrase(b"the")) == ["need at least two tokens"] and said(c.answer_phrase(b"x x")) == ["no results"]
    assert said(c.answer_phrase(b"the of\n")) == ["A 0", "A 2"]
    lines = said(c.answer(b"the of\r\n"))
    assert [x.split()[0] for x in lines] == ["0", "2", "1"] and all(len(x.split(".")[-1]) == 6 for x in lines)
    assert sorted(r["page_id"] for r in c.browser_phrase("the of").collect()) == [0, 2] and c.browser_phrase("the, of").count() == 0 and c.browser_phrase(" ").count() == 0


def test_hashes_of_long_and_short_terms(monkeypatch):
    from paginal.functions import text as T

    terms = ["", "abc", "x" * 5000, "é" * 77, "the"]
    whole = T.hash64_values(terms).tolist()
    monkeypatch.setattr(T, "HASHED", 10)
    assert T.hash64_values(terms).tolist() == whole
    assert whole[0] == 17280346270528514342 and whole[1] == 3741276987793851837 and whole[4] == 14645693024798636849
