import numpy as np
from pyspark.sql import functions as F

from paginal.operators import index, search


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")


TEXTS = ["a b a", "b c", "", "a b c a b", None, "B b"]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_postings_and_dictionary(spark):
    occ = index.occurrences(corpus(spark, TEXTS))
    assert occ.count() == 12
    post = {(r["term"], r["page_id"]): (r["tf"], r["positions"]) for r in index.postings(occ).collect()}
    assert post["a", 0] == (2, [0, 2]) and post["b", 3] == (2, [1, 4]) and post["B", 5] == (1, [0])
    assert {r["term"]: (r["cf"], r["df"]) for r in index.dictionary(occ).collect()}["b"] == (5, 4)
    assert rows(index.vocabulary(occ)) == [("B",), ("a",), ("b",), ("c",)]
    assert index.hash_collisions(occ).count() == 0


def test_deltas_round_trip(spark):
    post = spark.createDataFrame([("w", 3, 2, [1, 3]), ("w", 10, 1, [5]), ("v", 0, 1, [0])], "term string, page_id long, tf int, positions array<int>")
    deltas = index.encode_deltas(post)
    assert ("w", 10, 7, 1, [5]) in rows(deltas) and ("w", 3, 3, 2, [1, 2]) in rows(deltas)
    assert rows(index.decode_deltas(deltas).select(*post.columns)) == rows(post)


def test_stored_dictionary(spark):
    occ = index.occurrences(corpus(spark, TEXTS))
    got = sorted(index.stored_dictionary(index.dictionary(occ)).collect(), key=lambda r: r["word_hash"])
    at = 52
    for r in got:
        assert (r["block_bytes"], r["postings_offset"]) == (4 + 8 * r["df"] + 4 * r["cf"], at)
        at += 4 + r["block_bytes"]
    assert len({r["word_hash"] for r in got}) == len(got) == 4


def test_sorted_occurrences(spark):
    occ = index.occurrences(corpus(spark, TEXTS))
    got = sorted((r["rank"], r["term"], r["page_id"], r["pos"]) for r in index.sorted_occurrences(index.postings(occ)).collect())
    want = sorted((r["term"], r["page_id"], r["pos"]) for r in occ.collect())
    assert got == [(i + 1, *w) for i, w in enumerate(want)]


def test_empty(spark):
    occ = index.occurrences(corpus(spark, [None, ""]))
    post, words = index.postings(occ), index.dictionary(occ)
    for found in (post, words, index.stored_dictionary(words), index.sorted_occurrences(post), index.page_postings(corpus(spark, [None, "", " .,"]))):
        assert found.count() == 0
    assert index.block_stats(index.dictionary(occ)).first()["blocks"] == 0


def test_posting_algebra(spark):
    """Lists {3: [2], 20: [5]} and {3: [3], 30: [6]}."""
    post = spark.createDataFrame([("a", 3, [2]), ("a", 20, [5]), ("b", 3, [3]), ("b", 30, [6])], "term string, page_id long, positions array<int>")
    m = search.matches_in_postings(post, ("a", "b"))
    assert rows(search.intersect(m, ("a", "b"))) == [(3, 2)]
    assert rows(search.union(m, ("a", "b"))) == [(3, 2), (20, 1), (30, 1)]
    assert rows(search.adjacent(m)) == [(3, 1)]
    assert rows(search.phrase(m, ("a", "b"))) == [(3,)]
    assert rows(search.term_pages(m)) == [(3, 1), (20, 1)]


def test_page_postings_move_nothing(spark):
    pages = corpus(spark, [*TEXTS, "a", "b b b", " x " * 300, "..."])
    found = index.page_postings(pages)
    assert rows(found) == rows(index.postings(index.occurrences(pages)))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_pages(spark, monkeypatch):
    """A term's postings over many blocks: encoded, decoded and ranked as in one."""
    monkeypatch.setattr(index, "BLOCK_PAGES", 4)
    post = spark.createDataFrame([(t, p, 2, [1, p + 2]) for t in ("tha", "thb", "x", "th") for p in range(0, 40, 3)], "term string, page_id long, tf int, positions array<int>")
    assert rows(index.decode_deltas(index.encode_deltas(post)).select(*post.columns)) == rows(post)
    got = sorted((r["rank"], r["term"], r["page_id"], r["pos"]) for r in index.sorted_occurrences(post).collect())
    want = sorted((r["term"], r["page_id"], p) for r in post.collect() for p in r["positions"])
    assert got == [(i + 1, *w) for i, w in enumerate(want)]


def test_running_sums_of_long_arrays(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        values = [(7 * k) % 11 for k in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(index.running_sums("v")).first()[0]
        assert got == [sum(values[: k + 1]) for k in range(n)]


def test_stored_blocks(spark):
    stored = index.stored_dictionary(index.dictionary(index.occurrences(corpus(spark, TEXTS))))
    got = sorted(index.stored_blocks(stored).collect())
    assert [r["block_index"] for r in got] == [0, 1, 2, 3] and [r["postings_offset"] for r in got] == sorted(r["postings_offset"] for r in got)


def test_tokens_gathered_at_once(spark, monkeypatch):
    """Postings come in bounded lots of whole pages, and are those of one lot."""
    assert list(index.cut_lengths(np.array([3, 1 << 30, 0, 5]))) == [(0, 1), (1, 2), (2, 4)]
    assert list(index.cut_lengths(np.full(1000, 1000))) == [(k, min(k + 262, 1000)) for k in range(0, 1000, 262)]
    assert list(index.cut_lengths(np.array([], dtype=np.int64))) == []
    monkeypatch.setattr(index, "GATHERED", 3)
    pages = corpus(spark, [*TEXTS, "a", "b b b", " x " * 300, "..."]).coalesce(1)
    assert rows(index.page_postings(pages)) == rows(index.postings(index.occurrences(pages)))


def test_pages_split_once_for_deltas(spark, monkeypatch):
    """Blocks read the postings' own exchange, and decoding from starts adds none."""
    monkeypatch.setattr(index, "BLOCK_PAGES", 2)
    monkeypatch.setattr(index, "_by_block", lambda post, deal=index._by_block: deals.append(1) or deal(post))
    deals = []
    pages = corpus(spark, [*TEXTS, "a", "b b b"])
    post = index.page_postings(pages)
    deltas = index.encode_deltas(post, starts=True)
    decoded = index.decode_deltas(deltas)
    assert len(deals) == 1 and rows(decoded) == rows(post) and rows(deltas.drop("block", "behind")) == rows(index.encode_deltas(post))
    for found in (deltas, decoded):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        assert plan.toString().split("== Initial Plan ==")[0].count("MapInArrow") == 1


def test_postings_of_whole_pages(spark, monkeypatch):
    """Occurrences in any order, of pages longer and shorter than a lot; no row a token is aggregated."""
    monkeypatch.setattr(index, "GATHERED", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = [(t, p, i) for p in (0, 7, None, 3) for i, t in enumerate("b a c a b a b".split() * (4 if p == 7 else 1))] + [(None, 3, 9), ("z", 99, 1), ("z", 99, None)]
        occ = spark.createDataFrame(found[::-1], "term string, page_id long, pos int").orderBy("pos").repartition(3)
        want: dict = {}
        for t, p, i in found:
            want.setdefault((t, p), []).append(i)
        post = index.postings(occ)
        got = {(r["term"], r["page_id"]): (r["tf"], r["positions"]) for r in post.collect()}
        assert got == {k: (len(v), sorted(i for i in v if i is not None)) for k, v in want.items()} and post.count() == len(got)
        assert "collect_list" not in post._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_collisions_and_page_terms(spark, monkeypatch):
    pages = corpus(spark, [*TEXTS, "aa bb", None, " . "])
    terms = index.page_terms(pages)
    assert rows(index.vocabulary(terms)) == rows(index.vocabulary(index.occurrences(pages)))
    assert "Generate" not in terms._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(index, "hash64_bits", lambda c: F.when(F.length(c) == 2, -1).otherwise(F.ascii(c)).cast("long"))
    for words in (terms, index.occurrences(pages)):
        got = [(int(r["word_hash"]), sorted(r["terms"])) for r in index.hash_collisions(words).collect()]
        assert got == [(2**64 - 1, ["aa", "bb"])]
