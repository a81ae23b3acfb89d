import random
import zlib

import numpy as np
import pytest

from paginal.llm import bpe, packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


TEXTS = [None, "", "a", "the cat sat " * 900, "x" * 5000, "the cat sat", "the cat sat", "日本語 text 😀", "<|endoftext|> is text", " \n\n a\t\x00b "] + [f"number {i} " * (i % 40) for i in range(120)]


def check(rows, want, size):
    """Each id in exactly one piece, sequences without gaps or overlap."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for doc, ids in want.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for part in by_sequence.values():
        at = 0
        for r in sorted(part, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size


def test_pack(spark, docs, tokenizer):
    want = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in enumerate(TEXTS)}
    packed = packing.pack(docs(TEXTS).selectExpr("*", "'old' as length", "1 as offset"), with_ids=True)
    rows = packed.collect()
    check(rows, want, 1024)
    used = len({r["sequence_id"] for r in rows})
    assert used <= 1.1 * sum(map(len, want.values())) / 1024 + 1
    filled = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in rows:
        ids = np.frombuffer(filled[r["sequence_id"]]["ids"], "<u4")
        assert ids[r["offset"] : r["offset"] + r["length"]].tolist() == want[r["doc_id"]][r["start"] : r["start"] + r["length"]]


def test_repeated_rows_and_batches(spark, docs, tokenizer):
    df = docs(["same text " * 300] * 5 + [None] * 3)
    rows = packing.pack(df.selectExpr("1L as doc_id", "text")).collect()
    assert sum(r["length"] for r in rows) == 5 * (len(tokenizer.encode("same text " * 300).ids) + 1) + 3
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))


def test_empty_table(spark, docs):
    assert packing.pack(docs(["a"]).limit(0)).count() == 0


def test_patterns_cover_the_histogram():
    r = random.Random(5)
    for _ in range(200):
        size = r.choice([4, 10, 64])
        histogram = {length: r.randrange(1, 50) for length in r.sample(range(1, size + 1), r.randrange(1, size))}
        found = packing.patterns(histogram, size)
        used = {}
        for pattern, n in found:
            assert sum(pattern) <= size and n > 0
            for length in pattern:
                used[length] = used.get(length, 0) + n
        assert used == histogram
        total = sum(k * v for k, v in histogram.items())
        assert sum(n for _, n in found) <= 2 * total / size + 1
        for length, got in packing.places(found).items():
            assert [x[0] for x in got] == sorted(x[0] for x in got) and got[0][0] == 0
            del length


def test_longest_first_into_most_room():
    assert packing.patterns({7: 1, 5: 1, 3: 1, 2: 1}, 10) == [((7, 2), 1), ((5, 3), 1)]
    with pytest.raises(ValueError):
        packing.patterns({11: 1}, 10)


def test_encoder_equals_the_library(tokenizer):
    r = random.Random(2)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'ll", "1", "²", ".", ",", "!", "\xa0", "ß", "the", "—", "日", "😀", "\x85", "\x1c", "٣"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(30))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext| >", None, ""]
    assert bpe.Encoder(bpe.default_path()).ids(texts) == plain_ids(tokenizer, texts)


def plain_ids(tokenizer, texts):
    return [np.array(x.ids, dtype="<u4").tobytes() for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_long_texts_are_cut_exactly(tokenizer, monkeypatch):
    r = random.Random(3)
    words = ["a", "the", "'s", "don't", "1999", "été", "  ", "\n\n", "x" * 40, "—", "!?", " ", "日本", "<|endoftext|>"]
    monkeypatch.setattr(bpe, "CHUNK", 64)
    texts = [" ".join(r.choices(words[:11], k=500)) for _ in range(20)] + [" ".join(r.choices(words, k=300)) for _ in range(5)] + ["y" * 1000, " " * 1000]
    assert bpe.Encoder(bpe.default_path()).ids(texts) == plain_ids(tokenizer, texts)


def test_a_worker_that_starts_afresh(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "HELD_IDS", 20)
    encode = bpe.Encoder(bpe.default_path())
    for k in range(5):
        texts = [f"word{k} and {j} others{j}{k}" for j in range(50)]
        assert encode.ids(texts) == plain_ids(tokenizer, texts)


def test_other_forms_go_to_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["The cat's hat", "  A\n b", "", "<|endoftext|> c", "é 12"]
    encode = bpe.Encoder(path)
    assert not encode.known_form
    assert encode.ids(texts) == plain_ids(Tokenizer.from_file(path), texts)


def test_special_strings_as_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    texts = ["a<|endoftext|>b", "x"]
    assert bpe.Encoder(bpe.default_path(), special_as_text=True).ids(texts) == plain_ids(t, texts)
