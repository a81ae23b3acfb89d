import random
import re

import numpy as np
import pytest

from paginal.llm import pseudolm as M
from paginal.llm import words as W


def sentences(n, seed=0):
    r = random.Random(seed)
    return [" ".join(f"{a} {b} {c}" for a, b, c in (r.choice([("red", "big", "cat"), ("an", "old", "dog"), ("we", "saw", "it")]) for _ in range(r.randrange(5, 20)))) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame(list(enumerate(sentences(300))), "doc_id long, text string").repartition(3)
    return M.fit(df)


def ids_of(vocabulary, text):
    return M.coded_words([text], vocabulary, lambda found, which: None)[0].tolist()


def chunk(words):
    """The words as one chunk, and the places of all of them."""
    found = next(W.words([" ".join(words)]))
    return found, np.arange(len(found.hash))


def scores(spark, model, texts):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, log_prob int")
    return {r["doc_id"]: r for r in M.score(df, model).collect()}


def test_order_matters(spark, model):
    real = sentences(30, 9)
    r = random.Random(1)
    mixed = [" ".join(r.sample(t.split(), len(t.split()))) for t in real]
    a, b = scores(spark, model, real), scores(spark, model, mixed)
    assert np.mean([x["mean_log_prob"] for x in a.values()]) > np.mean([x["mean_log_prob"] for x in b.values()]) + 0.5


def test_better_than_frequencies(spark, model):
    df = spark.createDataFrame(list(enumerate(sentences(50, 3))), "doc_id long, text string")
    plain = M.fit(df, rounds=0)
    mean = lambda m: np.mean([r["mean_log_prob"] for r in M.score(df, m).collect()])
    assert mean(model) > mean(plain) + 0.3


def test_brute_force(spark, model):
    """Every word's conditional probability by one window at a time, over all words of the vocabulary."""
    text = "red big cat saw strangeword we"
    ids = ids_of(model.vocabulary, text)
    assert ids[4] == len("strangeword") - 1 and min(ids[:4] + ids[5:]) >= M.LENGTHS
    pad = [M.PAD] * M.SIDE + ids + [M.PAD] * M.SIDE
    total = 0.0
    net = model.network
    for t, target in enumerate(ids):
        around = [pad[t + M.SIDE + s] for s in (*range(-M.SIDE, 0), *range(1, M.SIDE + 1))]
        h = np.tanh(sum(net.embed[k * (M.WORDS + 1) + i] for k, i in enumerate(around)) + net.bias)
        classes = np.exp(net.cls @ h + net.cls_bias)
        words = np.exp(net.out @ h + net.out_bias).reshape(M.CLASSES, M.MEMBERS)
        p = (classes / classes.sum())[:, None] * words / words.sum(axis=1, keepdims=True)
        assert abs(p.sum() - 1) < 1e-4
        total += np.log(p.reshape(-1)[target])
    r = scores(spark, model, [text])[0]
    assert r["n_tokens"] == 6 and abs(r["log_prob"] - total) < 1e-3


def test_gradients():
    """A training step against differences of the loss."""
    r = np.random.default_rng(0)
    net = M.Network.fresh(np.arange(M.WORDS, dtype=float))
    context = np.stack([r.integers(0, M.WORDS, 40) + k * (M.WORDS + 1) for k in range(2 * M.SIDE)], axis=1)
    target = r.integers(0, M.WORDS, 40)
    before = net.log_prob(context, target).sum()
    trainer = M.Trainer(net.copy())
    for _ in range(30):
        trainer.step(context, target)
    assert trainer.net.log_prob(context, target).sum() > before + 40
    assert (net.with_rows(net.rows()).embed == net.embed).all() and trainer.windows == 1200


def test_windows_score_alike_wherever_they_stand():
    """To the bit, alone and among any others, with outputs of any size."""
    r = np.random.default_rng(1)
    net = M.Network.fresh(r.integers(1, 1000, M.WORDS).astype(float))
    context = np.stack([r.integers(0, M.WORDS, 3000) + k * (M.WORDS + 1) for k in range(2 * M.SIDE)], axis=1)
    target = r.integers(0, M.WORDS, 3000)
    for scale in (0.3, 20):
        net = M.Network(*((p + r.normal(size=p.shape) * scale).astype(np.float32) for p in vars(net).values()))
        whole = net.log_prob(context, target)
        for n in (1, 2, 7, 64, 65, 1000, 2999):
            some = r.permutation(3000)[:n]
            assert (net.log_prob(context[some], target[some]) == whole[some]).all()
    shares = M._even(r.normal(size=10_000) * 9)
    assert shares.sum() == shares[::-1].cumsum()[-1] == sum(r.permutation(shares).tolist())


def test_odd_rows(spark, model):
    got = scores(spark, model, [None, "", "!!!", "one", "red big cat", "red big cat", "we saw it " * 100_000])
    for k in range(3):
        assert (got[k]["n_tokens"], got[k]["log_prob"], got[k]["mean_log_prob"]) == (0, 0.0, None)
    assert got[3]["n_tokens"] == 1 and got[4]["log_prob"] == got[5]["log_prob"] and got[6]["n_tokens"] == 300_000
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.score(empty, M.fit(empty)).count() == 0


def test_counts(spark):
    df = spark.createDataFrame([(1, "A a b"), (2, None), (3, "b, c!")], "doc_id long, text string")
    signed = lambda w: int(np.uint64(W.hash_of(w)).astype(np.int64))
    assert {tuple(r) for r in M.count_words(df).collect()} == {(signed("a"), 1, 2), (signed("b"), 1, 2), (signed("c"), 1, 1)}


def test_words_equal_a_plain_split(monkeypatch):
    """Every text's words by the pattern, each character lower-cased on its own; long texts in pieces too."""
    r = random.Random(7)
    alphabet = ["a", "B", "é", "É", "ß", "İ", " ", "-", "_", "9", "²", "日", "Σ", "😀", "\n", "ab cd", "'"]
    texts = [None, "", "x"] + ["".join(r.choices(alphabet, k=r.randrange(60))) for _ in range(300)]
    lower = lambda c: c.lower() if len(c.lower()) == 1 else c
    want = [["".join(map(lower, w)) for w in re.findall(r"\w+", t or "")] for t in texts]
    for size in (1 << 18, 40, 7):
        monkeypatch.setattr(W, "CHUNK", size)
        got = [[] for _ in texts]
        for found in W.words(texts):
            raw, at = W.utf8(found.code)
            for row, a, b, h in zip(found.row, found.start, found.end, found.hash):
                word = "".join(map(chr, found.code[a:b]))
                assert raw[at[a] : at[b]].tobytes().decode() == word and int(h) == W.hash_of(word)
                got[row].append(word)
        # A piece ends at a gap, so a word is cut nowhere.
        assert got == want
    flat = {w for ws in want for w in ws}
    assert len({W.hash_of(w) for w in flat}) == len(flat)


def test_lookup(monkeypatch):
    monkeypatch.setattr(W.Lookup, "BITS", 4)
    r = np.random.default_rng(0)
    known = r.integers(0, 2**63, 50).astype(np.uint64)
    asked = np.concatenate([known, r.integers(0, 2**63, 50).astype(np.uint64)])
    assert W.Lookup(known).find(asked).tolist() == [*range(50), *[-1] * 50]
    assert W.Lookup(known[:0]).find(asked).tolist() == [-1] * 100


def test_defaults_train_on_every_window(spark):
    """Over the rounds of the production defaults, every place of every text is a target exactly once."""
    texts = [None, "", "one", *sentences(20, 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, plain = [], M._round

    def watched(coded, network, number, stride):
        rows = [np.frombuffer(r["ids"], np.uint16) for r in coded.collect() if r["ids"] is not None]
        for _, context, target in M.places(np.concatenate(rows), np.array([len(x) for x in rows]), 7, number, stride):
            seen.extend(map(tuple, np.column_stack([context, target]).tolist()))
        return plain(coded, network, number, stride)

    M._round = watched
    try:
        fitted = M.fit(df)
    finally:
        M._round = plain
    want = []
    for text in texts:
        ids = ids_of(fitted.vocabulary, text)
        pad = [M.PAD] * M.SIDE + ids + [M.PAD] * M.SIDE
        for t, target in enumerate(ids):
            around = [pad[t + M.SIDE + s] for s in (*range(-M.SIDE, 0), *range(1, M.SIDE + 1))]
            want.append((*(k * (M.WORDS + 1) + i for k, i in enumerate(around)), target))
    assert sorted(seen) == sorted(want)


def test_defaults_learn(spark):
    df = spark.createDataFrame(list(enumerate(sentences(300))), "doc_id long, text string").repartition(3)
    mean = lambda m: np.mean([r["mean_log_prob"] for r in M.score(df, m).collect()])
    assert mean(M.fit(df)) > mean(M.fit(df, rounds=0)) + 0.3


def test_spelling_sums_to_one():
    """Over all words of one and of two ASCII characters, and over the lengths of long words."""
    chars = [chr(c) for c in range(128)]
    counts = np.zeros(M.CODES)
    codes, _ = M.spelled(*chunk(["table", "cable", "tablet"] * 1000))
    np.add.at(counts, codes, 1)
    s = M.Spelling.of(counts, 3.0, 5.0)
    score = lambda words: s.log_prob(*chunk(words))
    p = np.exp(s.table.astype(np.float64)).reshape(-1, 256).sum(axis=1)
    assert np.abs(p - 1).max() < 1e-4
    letters = [c for c in chars if re.match(r"\w", c) and c == c.lower()]
    assert 0.9 < np.exp(score([a + b for a in letters for b in letters])).sum() < 1
    assert score(["table"])[0] > score(["qxzjv"])[0] + 20
    further = np.exp(np.arange(200) * np.log1p(-s.ends) + np.log(s.ends)).sum()
    assert abs(further - 1) < 1e-6
    word = "\u0643a" * 9
    plain, before = 2 * np.log1p(-s.ends) + np.log(s.ends), (M.START, M.START)
    for byte in word.encode():
        two, one = before
        plain += s.table[(one * M.SORTS + (two * 7 + (two >> 4)) % M.SORTS) * 256 + byte]
        before = (one, byte)
    assert abs(score(["x", word, "y"])[1] - plain) < 1e-4


def test_query_tells_rare_words_apart(spark, tmp_path):
    """More words than the vocabulary holds: a rare word and gibberish of its length score apart."""
    from paginal.llm.queries import op5_pseudo_likelihood

    r = random.Random(2)
    common = [a + b + c + d for a in "bdfgklm" for b in "aeiou" for c in "prstvnl" for d in ("a", "e", "i", "o", "u", "an", "en", "in", "on")]
    assert len(common) > M.WORDS
    texts = [" ".join(common * 2), " ".join("rare" + a + b for a in "bdfg" for b in "aeiou")] + [f"{r.choice(common)} {w} {r.choice(common)}" for w in ("rareba", "qzxwvj")]
    texts[3] = texts[2].replace("rareba", "qzxwvj")
    spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op5_pseudo_likelihood(spark, str(tmp_path)).collect()}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == 3 and got[2]["log_prob"] > got[3]["log_prob"] + 2
    assert abs(got[2]["mean_log_prob"] - got[2]["log_prob"] / 3) < 1e-9
    assert (got[4]["n_tokens"], got[4]["log_prob"], got[4]["mean_log_prob"]) == (0, 0.0, None)
