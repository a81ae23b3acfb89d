from decimal import Decimal

import pytest

from paginal.functions import text as T
from paginal.functions.query import AND, OR, parse, terms_of


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f("text").alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, "آأإاىةَ", T.normalize) == "ااااي" + "ه"
    assert one(spark, "Ab ـ ؤ ئ ٰ", T.normalize) == "Ab ـ ؤ ئ ٰ"
    assert one(spark, None, T.normalize) is None
    assert one(spark, "", T.normalize) == ""


def test_tokens(spark):
    assert one(spark, "آحمد يس", T.tokens) == ["احمد", "يس"]
    assert one(spark, "آحمد يس", T.raw_tokens) == ["آحمد", "يس"]
    line = "آمنَة a\0b,c-D `x|y ~ ،م؟ x\xa0y\n\ttail"
    assert one(spark, line, T.tokens) == ["امنه", "ab", "c", "D", "`x|y", "~", "،م؟", "x\xa0y", "tail"]
    assert one(spark, "a\0b", T.raw_tokens) == ["a", "b"]
    assert one(spark, " ,;", T.tokens) == []


def test_query_tokens_follow_page_tokens(spark):
    for line in ["آمنَة a\0b,c-D `x|y ~ ،م؟", "", "the OR of", "a  b", "x\xa0y"]:
        assert terms_of(line) == one(spark, line, T.tokens)


def test_parse():
    assert parse("the of").mode == AND
    q = parse("the OR of")
    assert (q.mode, q.terms, q.words) == (OR, ("the", "of"), ("the", "OR", "of"))
    assert parse("or the").mode == AND
    assert parse("  ").terms == ()


HASHES = {"": 17280346270528514342, "abc": 3741276987793851837, "abd": 5765713859621658876, "بسم": 1548395542421781461, "the": 14645693024798636849, "OR": 16437574301486251231}


def test_hash(spark):
    df = spark.createDataFrame([(k,) for k in [*HASHES, None]], "t string")
    got = {r["t"]: r["h"] for r in df.select("t", T.hash64("t").alias("h")).collect()}
    assert got == {k: Decimal(v) for k, v in HASHES.items()} | {None: None}
    assert int(T.hash64_values(["abc"], 1)[0]) == 11679431713487767959
    assert int(T.hash64_values(["abc"], 0x9E3779B97F4A7C15)[0]) == 1139830242715181648
    assert len(T.hash64_values([])) == 0


def plain_stem(word):
    """The rule by hand: bytes count, at most one prefix, then one suffix."""
    size = lambda w: len(w.encode())
    if size(word) <= 4:
        return word
    for p in T.PREFIXES:
        if word.startswith(p) and size(word) - size(p) >= 4:
            word = word[len(p) :]
            break
    for s in T.SUFFIXES:
        if word.endswith(s) and size(word) - size(s) >= 4:
            return word[: -len(s)]
    return word


def test_stem(spark):
    stems = ["كتب", "قلم", "بيت", "مدرس", "ولد", "س"]
    words = sorted({p + b + s for p in ("", *T.PREFIXES) for b in stems for s in ("", *T.SUFFIXES)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["s"] for r in df.select("w", T.light_stem("w").alias("s")).collect()}
    assert got == {w: plain_stem(w) for w in words}


@pytest.mark.parametrize("count", [10])
def test_long_page(spark, count):
    page = "\n".join(f"{i} - بسم الله الرحمن الرحيم" for i in range(3))
    assert len(one(spark, page, T.tokens)) >= count
