import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paginal.llm import bpe, idcoder


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 9), max_size=300), max_size=6))
def test_round_trip(lists):
    round_trip(list(range(len(lists))), [len(x) for x in lists], np.array([x for part in lists for x in part], dtype=np.uint32))


def round_trip(docs, sizes, flat):
    block = idcoder.encode_block(docs, np.array(sizes, dtype=np.int64), flat)
    got_docs, got_sizes, got = idcoder.decode_block(block)
    assert (got_docs, got_sizes.tolist()) == (docs, list(sizes)) and np.array_equal(got, flat)
    return block


@pytest.mark.parametrize("n", [127, 128, 129, 5000, 40_000])
def test_sizes_and_kinds(n):
    r = np.random.default_rng(n)
    for ids in (np.zeros(n), r.integers(0, 65536, n), r.integers(0, 3, n), np.tile([1, 2, 3, 4, 50256], n)[:n], r.zipf(1.3, n) % 65536):
        round_trip([None], [n], ids.astype(np.uint32))


def test_it_compresses():
    r = np.random.default_rng(0)
    ids = np.concatenate([r.integers(0, 50000, 2000)] * 20).astype("<u4")
    assert len(round_trip([1], [len(ids)], ids)) < 0.5 * 2 * len(ids)


def test_counts_are_halved(monkeypatch):
    monkeypatch.setattr(idcoder, "MOST", 5000)
    round_trip([1], [60_000], (np.random.default_rng(1).zipf(1.5, 60_000) % 500).astype(np.uint32))


def test_damage_is_found():
    block = bytearray(idcoder.encode_block([1, 2], np.array([50, 1]), np.array([1] * 50 + [2])))
    for at in (0, 5, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            idcoder.decode_block(bytes(bad))
    with pytest.raises(ValueError):
        idcoder.decode_block(b"CMR2")


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path()).encode(text or "", add_special_tokens=False).ids + [2]


def test_files(spark):
    from pyspark.sql import functions as F

    texts = [(5, "b c"), (2, None), (9, ""), (2, "a"), (None, "null"), (None, "null"), (7, "long " * 30_000), (3, "日本"), (4, "x <|endoftext|>"), (5, "b c"), (5, "b c")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, part int, h string")
    files = idcoder.write_files(df, block_ids=3)
    got = idcoder.read_files(files).join(idcoder.block_starts(files), ["part", "block"])
    rows = sorted(got.select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "ids").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i or 0))
    want = sorted((i or 0, library_ids(t)) for i, t in texts)
    assert sorted((r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist()) for r in rows) == want
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    assert max(r["n_docs"] for r in files.collect()) > 1
    assert idcoder.read_files(idcoder.write_files(df.limit(0))).count() == 0


def test_one_id_spreads_over_files(spark):
    df = spark.range(4000).selectExpr("1L as doc_id", "'the same text' as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = idcoder.write_files(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.select("part").distinct().count() > 1
    assert files.agg({"n_docs": "sum"}).first()[0] == 4000


def test_batches_of_later_workers_stay_as_they_were(spark):
    idcoder.read_files(idcoder.write_files(spark.createDataFrame([(1, "a")], "doc_id long, text string"))).count()
    from paginal.llm import common

    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(common.ARROW_ROWS)
