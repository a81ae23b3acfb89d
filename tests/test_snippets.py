from paginal.operators.prefix import dense_number_apart
from paginal.operators.snippets import snippets


def run(spark, line, pages, hits, **kw):
    p = spark.createDataFrame(pages, "page_id long, book_id long, page_number long, text string")
    h = spark.createDataFrame([(i, 1.0) for i in hits], "page_id long, score double")
    return {r["page_id"]: r for r in snippets(h, p, line, **kw).collect()}


PAGES = [
    (0, 1, 1, "x" * 50 + " find me " + "y" * 50),
    (1, 1, 2, "the text ends with find"),
    (2, 1, 3, " me and goes on"),
    (3, 1, 4, "only me is here, not the other"),
    (4, 1, 5, "nothing to see " + "z" * 100),
    (5, 2, 1, "ends with find"),
    (6, 3, 1, " me"),
    (7, 3, 2, ""),
]


def test_kinds(spark):
    got = run(spark, "find me", PAGES, [0, 1, 3, 4, 5, 7, 99])
    assert [got[i]["kind"] for i in (0, 1, 3, 4, 5, 7, 99)] == ["exact", "boundary", "token", "prefix", "token", "missing", "missing"]
    assert got[0]["snippet"] == "x" * 39 + " «find me» " + "y" * 39
    assert (got[1]["page_id"], got[1]["last_page_id"]) == (1, 2)
    assert got[1]["snippet"] == "the text ends with «find me» and goes on"
    assert got[3]["snippet"] == "only«me»isherenottheother"
    assert got[4]["snippet"] == "nothing to see " + "z" * 65
    assert got[99]["snippet"] == "(failed to load text)"


def test_exact_only(spark):
    assert set(run(spark, "find me", PAGES, [0, 1, 3, 4], exact_only=True)) == {0, 1}


def test_contexts_count_bytes(spark):
    text = "é" * 30 + "mot" + "ü" * 30
    r = run(spark, "mot", [(0, 1, 1, text)], [0])[0]
    assert bytes(r["before"]) == ("é" * 20).encode() and bytes(r["after"]) == ("ü" * 20).encode()
    odd = run(spark, "mot", [(0, 1, 1, "é" * 30 + "amot")], [0])[0]
    assert len(bytes(odd["before"])) == 40 and odd["snippet"].endswith("a«mot»")


def test_keyword_is_a_word_for_the_fallback(spark):
    assert run(spark, "q OR r", [(0, 1, 1, "this OR that")], [0])[0]["snippet"] == "this«OR»that"


def test_bounded_hits_move_no_other_text(spark, tmp_path):
    """With a bound on the hits, the scan of pages feeds a broadcast join, not an exchange."""
    from paginal.operators import snippets

    pages = spark.range(5000).selectExpr("id as page_id", "1L as book_id", "id as page_number", "concat('the of ', id) as text")
    pages.write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    hits = spark.createDataFrame([(7, 1.0), (4999, 0.5), (9000, 0.1)], "page_id long, score double")
    found = snippets.snippets(hits, pages, "the of", most=10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and plan.count("broadcast") >= 2
    same = snippets.snippets(hits, pages, "the of")
    assert sorted(found.collect(), key=str) == sorted(same.collect(), key=str)
    physical = found._jdf.queryExecution().executedPlan().toString()
    for part in physical.split("FileScan parquet")[:-1]:
        # Above each scan, the nearest join or exchange is the broadcast semi join.
        above = [line for line in part.splitlines() if "Exchange" in line or "Join" in line]
        assert "BroadcastHashJoin" in above[-1] and "LeftSemi" in above[-1] or "BroadcastExchange" in above[-1]


def test_places(spark):
    got = run(spark, "find me", PAGES, [0, 1, 3, 4, 7], places=True)
    assert [got[i]["place"] for i in (0, 1, 3, 4, 7)] == [52, 0, 2, 0, 0]


def test_numbers_move_no_text(spark):
    """Rows alike, nulls and an empty name are numbered in order; only narrow rows are dealt by book."""
    keys = [(b, p) for b in (None, "", "b", "a") for p in (3, None, 1, 3, -5)]
    df = spark.createDataFrame([(b, p, f"t{i}") for i, (b, p) in enumerate(keys)], "book_id string, page_number long, text string")
    apart = dense_number_apart(df, "book_id", "page_number", "page_id")
    got = sorted(apart.collect(), key=lambda r: r["page_id"])
    first = lambda k: tuple((x is not None, x if x is not None else 0) for x in k)
    assert [(r["book_id"], r["page_number"]) for r in got] == sorted(keys, key=lambda k: ((k[0] is not None, k[0] or ""), first(k[1:])))
    assert [r["page_id"] for r in got] == list(range(20)) and {(r["book_id"], r["page_number"], r["text"]) for r in got} == {tuple(r) for r in df.collect()}
    by_book = [line for line in apart._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1:]]
    assert by_book and all("text" not in part.split("\n")[1] for part in by_book)
