from collections import Counter

import numpy as np
import pytest

from paginal.llm import unigram

ODD = ["", "a", "  a  b\n c", " ", "a▁b▁", "\x00é😀 x\t", "ﬁ① 　日本語", "\n\n \n", "x" * 5000, " " * 100, None, "\U0010ffff", "the cat " * 20_000]


@pytest.fixture(scope="module")
def model():
    return unigram.Pieces(unigram.default_path())


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=unigram.default_path())


def test_lossless_and_valid(model, library):
    for key in range(3):
        for text, ids in zip(ODD, model.sample(ODD, np.full(len(ODD), key))):
            assert model.decode(ids) == (text or "") == library.decode(ids.tolist())


def test_batches_do_not_matter(model):
    keys = np.arange(len(ODD))
    together = model.sample(ODD, keys)
    fresh = unigram.Pieces(unigram.default_path())
    alone = [fresh.sample([t], keys[k : k + 1])[0] for k, t in reversed(list(enumerate(ODD)))][::-1]
    assert all((a == b).all() for a, b in zip(together, alone))
    fresh.forget()
    assert all((a == b).all() for a, b in zip(together, fresh.sample(ODD, keys)))


@pytest.mark.parametrize("word", ["there", "in a", "été"])
def test_draws_follow_the_weights(model, library, word):
    """Frequencies against the shares of all segmentations, by enumeration."""

    def ways(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            piece = library.piece_to_id(rest[:n].replace(" ", unigram.MARK))
            if piece > 2:
                for ids, weight in ways(rest[n:]):
                    yield (piece, *ids), weight + model.weight[piece]

    shares = {ids: np.exp(w) for ids, w in ways(" " + word)}
    total = sum(shares.values())
    n = 6000
    got = Counter(tuple(model.sample([word], np.array([k]))[0].tolist()) for k in range(n))
    assert set(got) <= set(shares)
    for ids, share in shares.items():
        p = share / total
        assert abs(got[ids] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


def test_columns(spark, docs):
    df = docs(ODD).unionByName(docs(["again", "again"], first=0)).selectExpr("*", "'x' as ids", "1 as decoded")
    out = unigram.decode(unigram.encode(df))
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    rows = out.collect()
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    other = {(r["doc_id"], r["text"]): r["ids"] for r in unigram.encode(df, seed=1).collect()}
    same = {(r["doc_id"], r["text"]): r["ids"] for r in unigram.encode(df.repartition(7)).collect()}
    assert same == {(r["doc_id"], r["text"]): r["ids"] for r in rows} and same != other
    assert unigram.encode(df.limit(0)).count() == 0
    null_key = spark.createDataFrame([(None, "some words")], "doc_id long, text string")
    assert unigram.decode(unigram.encode(null_key)).first()["decoded"] == "some words"


def test_very_long_runs_and_clashing_names(spark):
    texts = ["a" * 20_000 + " " * 9_000 + "b", "x"]
    df = spark.createDataFrame([(k, t, "p", "q") for k, t in enumerate(texts)], "doc_id long, text string, __text string, key string")
    got = sorted(unigram.decode(unigram.encode(df)).collect())
    assert [r["decoded"] for r in got] == texts and (got[0]["__text"], got[0]["key"]) == ("p", "q")
    assert unigram.encode(df).columns == [*df.columns, "ids"]
