import duckdb

from paginal.llm import linededup

SCHEMA = "doc_id long, source string, text string, n_lines string"


def test_rules_and_clashing_columns(spark):
    rows = [(i, "h", f"  menu \nown line {i}\n\nfoot", "old") for i in range(6)] + [(10 + i, "g", f"menu\nother {i}", "old") for i in range(3)]
    rows += [(20, None, "menu", "old"), (21, "h", None, "old"), (22, "h", "", "old"), (23, "h", "menu\nfoot", "old"), (5, "h", "  menu \nown line 5\n\nfoot", "old")]
    out = linededup.drop_boilerplate_lines(spark.createDataFrame(rows, SCHEMA), min_pages=5)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_dropped"]))
    assert got[0] == [("own line 0\n", 4, 2)] and got[5] == [("own line 5\n", 4, 2)] * 2
    assert got[10] == [("menu\nother 0", 2, 0)] and got[20] == [("menu", 1, 0)]
    assert got[21] == [(None, 0, 0)] and got[22] == [("", 1, 0)] and got[23] == [("", 2, 2)]
    assert out.columns == ["doc_id", "source", "text", "n_lines", "n_dropped"]


def test_null_host_is_a_host(spark):
    rows = [(i, None, f"menu\n{i}", "") for i in range(6)]
    assert {r["text"] for r in linededup.drop_boilerplate_lines(spark.createDataFrame(rows, SCHEMA)).collect()} == {str(i) for i in range(6)}


def test_long_text_and_empty_table(spark):
    long = "\n".join(f"line {i}" for i in range(50_000))
    rows = [(i, "h", long if i == 0 else f"x{i}", "") for i in range(8)]
    got = {r["doc_id"]: r for r in linededup.drop_boilerplate_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0]["text"] == long and got[0]["n_lines"] == 50_000
    assert linededup.drop_boilerplate_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_oracle(spark):
    rows = [(i, "ab"[i % 3 == 0], "\n".join(["top", f"l{i % 7}", " ", f"own {i}", "end"][: 2 + i % 4])) for i in range(60)] + [(99, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    documents = df.toPandas()  # noqa: F841  read by DuckDB
    want = sorted(duckdb.sql(linededup.oracle()).fetchall())
    got = sorted(tuple(r) for r in linededup.drop_boilerplate_lines(df).select("doc_id", "text", "n_lines", "n_dropped").collect())
    assert [(a, b, int(c), int(d)) for a, b, c, d in want] == got


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "h", "a", "")], SCHEMA)
    for bound in (10, -1):
        plan = linededup.drop_boilerplate_lines(df, broadcast_lines=bound)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_both_joins_agree(spark, monkeypatch):
    """The broadcast and the salted join, with hot hosts, repeated rows and null hosts."""
    monkeypatch.setattr(linededup, "SALT_PAGES", 7)
    rows = [(i, ["a", "a", "b", None][i % 4], f"top\nown {i % 50}\n{'end' if i % 3 else ''}", "") for i in range(300)] + [(1000, "a", "top\nsame", "")] * 40
    df = spark.createDataFrame(rows, SCHEMA)
    one, other = (sorted(map(tuple, linededup.drop_boilerplate_lines(df, broadcast_lines=b).collect()), key=str) for b in (10**6, -1))
    assert one == other and len(one) == 340 and sum(r[4] for r in one) > 340


def test_clashing_and_map_columns(spark):
    rows = [(i, "h", f"menu\nl{i}", ["z"], {"k": i}, i, i) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, __lines array<string>, lines map<string,int>, Host int, KEYS int")
    for bound in (10, -1):
        out = linededup.drop_boilerplate_lines(df, broadcast_lines=bound)
        assert out.columns == [*df.columns, "n_lines", "n_dropped"]
        assert {(r["text"], r["__lines"][0], r["lines"]["k"], r["Host"], r["KEYS"]) for r in out.collect()} == {(f"l{i}", "z", i, i, i) for i in range(8)}
