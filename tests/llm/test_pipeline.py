import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from paginal.llm import bpe, langid, pii
from tests.llm.plain import components
from tests.llm.test_langid import corpus

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, f"site menu\n{t}\n{t[:20]} own {i}", lang) for i, t, lang in corpus(150)]
    long = " ".join(t for _, t, lang in corpus(90) if lang == "aa")
    rows += [(200, long, "aa"), (201, long, "aa"), (202, long + " more", "aa"), (203, "", "aa"), (204, None, "bb"), (205, "12 !!", "bb")]
    rows += [(206, "der und nicht auch mit a.b@c.example und +1 (017) 555-7713 für", "bb"), (206, "der und nicht auch mit a.b@c.example und +1 (017) 555-7713 für", "bb")]
    path = str(tmp_path_factory.mktemp("sf"))
    data = [(i, t, lang, "src" + str(i % 3), len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(data, COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "line_dedup", "near_copies", "redact_pii", "pack"]
    rows = [tuple(r) for r in docs.collect()]

    model = langid.fit(docs)
    labels, scores = model.predict([r[1] for r in rows])
    rows = [r for r, label, s in zip(rows, labels, scores) if label != "und" and s >= P.LANGUAGE_SCORE]
    out = P.written(P.language_id(spark, docs, folder), "t")
    assert sorted(map(tuple, out.collect())) == sorted(rows)
    assert not {203, 204, 205} & {r[0] for r in rows} and len(rows) > 140

    totals, held = {}, {}
    for r in rows:
        totals[r[3]] = totals.get(r[3], 0) + 1
        for line in {x.strip(" ") for x in r[1].split("\n")} - {""}:
            held[r[3], line] = held.get((r[3], line), 0) + 1
    keep = lambda r, line: not (held.get((r[3], line.strip(" ")), 0) >= 5 and held[r[3], line.strip(" ")] > 0.1 * totals[r[3]])
    rows = [(*r[:1], "\n".join(x for x in r[1].split("\n") if keep(r, x)), *r[2:4]) for r in rows]
    rows = [(*r, len(r[1])) for r in rows]
    out = P.written(P.line_dedup(spark, out, folder), "t")
    assert sorted(map(tuple, out.collect())) == sorted(rows)
    assert not any("site menu" in r[1] for r in rows)

    found = components([(r[0], r[1]) for r in rows], P.SHINGLE_WORDS, P.NEAR_PERCENT)
    rows = sorted({r for r in rows if found[r[0]][1] == r[0]})
    out = P.written(P.near_copies(spark, out, folder), "t")
    assert sorted(map(tuple, out.collect())) == rows
    assert {200, 206} <= {r[0] for r in rows} and not {201, 202} & {r[0] for r in rows}

    field = pii.trained()
    spans = [b + a for b, a in pii.all_spans([r[1] for r in rows], field)]
    rows = [(r[0], pii.redacted(r[1], s), *r[2:4]) for r, s in zip(rows, spans)]
    rows = [(*r, len(r[1])) for r in rows]
    out = P.written(P.redact_pii(spark, out, folder), "t")
    assert sorted(map(tuple, out.collect())) == rows and out.columns == docs.columns
    assert any("[EMAIL]" in r[1] and "[PHONE]" in r[1] for r in rows)

    encode = bpe.encoder(bpe.default_path())
    packed = P.pack(spark, out, folder).collect()
    for r in rows:
        ids = np.frombuffer(encode.ids([r[1]])[0] + b"\0\0\0\0", "<u4")
        own = sorted((p for p in packed if p["doc_id"] == r[0]), key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == len(ids)
        assert [p["ids_crc32"] for p in own] == [zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in own]

    whole = P.run(spark, folder).collect()
    key = lambda p: (p["doc_id"], p["start"], p["length"], p["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_near_copies_lose_no_text(spark, tmp_path):
    """One id with two texts, repeated rows, rows without an id, and extra columns with the names of helpers."""
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (1, "a b c d e f g"), (2, "q r s t u v w"), (None, "a b c d e f g"), (None, None), (5, long), (6, long + " x"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, digest string")
    got = P.near_copies(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    want = [(1, "a b c d e f g"), (1, "q r s t u v w"), (None, "a b c d e f g"), (None, None), (5, long), (7, None), (8, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls in every column, rows without an id and clashing extra columns: the last stage packs what is left."""
    rows = [(k, f"the cat and the dog number {'abcdefghij'[k % 10] * (k % 7 + 1)} went home again and again", "en", "h", 10, "x", "y") for k in range(60)]
    rows += [(None, "the cat and the dog went home", None, None, None, None, None), (99, None, "en", "h", None, "x", "y"), (98, "", None, None, 0, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __text string, lines string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = P.table(spark, str(tmp_path), "documents")
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == df.columns
    packed = P.pack(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} >= {None, 0} and not {98, 99} & {r["doc_id"] for r in packed}
