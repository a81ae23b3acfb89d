import random
import zlib

import numpy as np
import pytest

from paginal.llm import langid

WORDS = {"aa": "the and that with from this which".split(), "bb": "der und nicht auch mit für über".split(), "cc": "está que los para una como más".split()}


def corpus(n=240, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        out.append((i, " ".join(r.choices(WORDS[lang], k=r.randrange(3, 30))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    out = langid.detect(df, model).withColumn("held", langid.held_out()).collect()
    held = [r for r in out if r["held"]]
    assert len(held) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_odd_rows(spark):
    model = langid.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    odd = [(0, None), (1, ""), (2, "123 !? \n"), (3, "der und nicht"), (3, "der und nicht"), (4, "und nicht " * 200_000), (None, "the and that"), (5, "퟿😀x")]
    df = spark.createDataFrame([(i, t, "old", 9.0) for i, t in odd], "doc_id long, text string, lang_pred string, score double")
    got = langid.detect(df, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    rows = {}
    for r in got.collect():
        rows.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert rows[0] == rows[1] == rows[2] == [("und", 0.0)]
    assert rows[3][0] == rows[3][1] and rows[3][0][0] == "bb" and rows[4][0][0] == "bb" and rows[None][0][0] == "aa"
    assert rows[5][0][0] in WORDS


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.detect(df, langid.fit(df)).first()["lang_pred"] == "und"
    assert langid.detect(df.limit(0), langid.fit(df.limit(0))).count() == 0


def test_labels_of_held_out_rows_are_not_learned(spark):
    import zlib

    rows = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in corpus()]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == ["aa", "bb", "cc"]


@pytest.mark.parametrize("size", [5, 1000])
def test_chunks_count_like_the_whole(monkeypatch, size):
    text = "Straße und der Weg, 12 x " * 30
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", size)
    parts = langid.counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_gradient_step_reduces_loss():
    r = np.random.default_rng(0)
    rows = [(np.array([0, 1 + k % 2]), np.array([1.0, 3.0])) for k in range(40)]
    model = langid.train(rows, [k % 2 for k in range(40)], ["a", "b"], np.ones(4))
    z = [model.features(b, c) @ model.weights[b] + model.bias for b, c in rows]
    assert all(np.argmax(x) == k % 2 for k, x in enumerate(z))
    assert (model.weights[3] == 0).all()
    del r


def plain_counts(text):
    """N-grams of a text the plain way: by character, hashed as the operator hashes them."""
    low = " " + text.lower() + "  "
    code = [ord(c) if c.isalpha() else 0 for c in low]
    out = {}
    for order in langid.ORDERS:
        for k in range(len(low) - 2):
            gram = code[k : k + order]
            if not any(gram):
                continue
            h = 0
            for c in gram:
                h = (h * 0x01000193 + c * 0x9E3779B1) & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x85EBCA6B + order * 0x27D4EB2F & 0xFFFFFFFF
            h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
            bucket = h >> (33 - langid.BUCKETS.bit_length())
            out[bucket] = out.get(bucket, 0) + 1
    return out


def test_prediction_against_plain_arithmetic(spark):
    """TF-IDF, linear scores, temperature and softmax recomputed with dictionaries."""
    import math

    rows = corpus()
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learned = [(i, t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    df = {}
    for _, t in learned:
        for b in plain_counts(t):
            df[b] = df.get(b, 0) + 1
    texts = [t for _, t, _ in rows[:25]] + ["der the und, 12 nicht!", "x"]
    labels, scores = model.predict(texts)
    for text, label, score in zip(texts, labels, scores):
        weighted = {b: n * (math.log((1 + len(learned)) / (1 + df.get(b, 0))) + 1) for b, n in plain_counts(text).items()}
        total = sum(weighted.values())
        z = [sum(w * langid.SCALE / total * model.weights[b, k] for b, w in weighted.items()) + model.bias[k] for k in range(len(model.labels))]
        e = [math.exp((x - max(z)) / model.temperature) for x in z]
        p = [x / sum(e) for x in e]
        assert model.labels[p.index(max(p))] == label and abs(max(p) - score) < 1e-9


@pytest.mark.parametrize("shared", [None, 4])
def test_rows_that_share_an_id(spark, shared):
    """Rows without an id, or all of one id, still train: the text tells them apart."""
    assert shared is None or zlib.crc32(str(shared).encode()) % 4 != 2
    rows = [(shared, t, lang) for _, t, lang in corpus()]
    model = langid.fit(spark.createDataFrame(rows * 3, "doc_id long, text string, lang string"), train_rows=40, calibration_rows=20)
    assert np.count_nonzero(model.weights) and model.predict(["the and that of the", "und der nicht"])[0] == ["aa", "bb"]


def test_many_labels_and_a_bounded_sample(spark):
    """Beyond the bound on weights there are fewer buckets; the sample keeps within its bytes, one row of each label at least."""
    rows = [(k, f"word{'abcdefghij'[k % 10]} " * 5 + chr(97 + k % 26), f"l{k % 300}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, sample_bytes=1)
    assert len(model.labels) == 300 and len(model.idf) * 300 <= langid.MOST_WEIGHTS and np.isfinite(model.weights).all()


def test_clashing_names(spark):
    model = langid.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "der und nicht", "x", "y", "z")], "doc_id long, text string, __text string, _text string, Score string")
    got = langid.detect(df, model)
    assert got.columns == ["doc_id", "text", "__text", "_text", "lang_pred", "score"] and got.first()["lang_pred"] == "bb"
