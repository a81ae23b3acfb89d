import random

import numpy as np
import pytest

from paginal.llm import jaccard, shingles
from paginal.llm.components import connected_components
from tests.llm.plain import components
from tests.llm.plain import shingles as plain_shingles


def corpus(seed=0):
    """Groups of exact and near copies, chains, common passages, short and odd texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    new = lambda n: r.choices(vocabulary, k=n)
    common = new(12)
    texts = [" ".join(new(r.randrange(1, 60))) for _ in range(60)]
    base = new(90)
    for _ in range(40):
        near = list(base)
        for _ in range(r.randrange(4)):
            near[r.randrange(len(near))] = r.choice(vocabulary)
        texts.append(" ".join(near))
    chain = new(80)
    for k in range(12):
        chain = chain[2:] + new(2)
        texts.append(" ".join(chain))
        del k
    texts += [" ".join(common + new(r.randrange(1, 8))) for _ in range(30)]
    texts += [texts[3], texts[3].upper(), texts[3].replace(" ", "\t\n "), None, "", " \n", "one", "One", "one two", "one two three", "é ß 日本 x y z", "a b a b a b a b a b"]
    texts.append(" ".join(new(60_000)))
    return texts


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_against_all_pairs(spark, docs, width, percent):
    texts = corpus()
    want = components(list(enumerate(texts)), width, percent)
    out = jaccard.jaccard_components(docs(texts).selectExpr("*", "1 as n", "2 as c"), width=width, percent=percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == want


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(4, text), (4, text), (2, text), (None, text), (None, None), (9, "x")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(4, 5, 2), (4, 5, 2), (2, 5, 2), (None, 5, 2), (None, 0, None), (9, 1, 9)], key=str)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_tree_walk():
    r = np.random.default_rng(0)
    for percent in (50, 80, 85, 100):
        for _ in range(60):
            probe = np.unique(r.integers(0, 400, r.integers(1, 200))).astype(np.uint64)
            sets = []
            for _ in range(20):
                kept = probe[r.random(len(probe)) > r.choice([0, 0.05, 0.2, 0.9])]
                sets.append(np.unique(np.concatenate([kept, r.integers(0, 400, r.integers(0, 12)).astype(np.uint64)])))
            want = [k for k, s in enumerate(sets) if len(s) and 100 * len(np.intersect1d(probe, s)) >= percent * len(np.union1d(probe, s))]
            assert sorted(jaccard.tree_links(probe, sets, percent)) == want


def test_shingle_sets():
    texts = corpus(5)
    found = {}
    for begin, ends, h in shingles.shingle_sets(texts, 4):
        for k, s in enumerate(np.split(h, ends[:-1])):
            found[begin + k] = s
    assert [len(found[k]) for k in range(len(texts))] == [len(plain_shingles(t, 4)) for t in texts]
    assert all((np.diff(s.astype(object)) > 0).all() for s in found.values() if len(s) > 1)
    a, b = (next(shingles.shingle_sets([t], 4))[2] for t in ("The  cat\tsat ON it", "the cat sat on it"))
    assert (a == b).all()


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(300 + k, 301 + k) for k in range(40)] + [(1, 1), (500, 400), (500, 400), (None, 3)]
    parent = {v: v for p in pairs if None not in p for v in p}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {row["v"]: row["c"] for row in connected_components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {v: find(v) for v in parent}


def test_links_are_all_pairs(spark):
    """Also those inside a group of near copies, which the components alone don't need."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(0, 12)] + [" ".join(words)] * 2 + ["w1 w2", "", None]
    rows = list(enumerate(texts))
    got = sorted(map(tuple, jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), width=2, percent=90).collect()))
    sets, first = {}, {}
    for i, t in rows:
        s = plain_shingles(t, 2)
        if s and first.setdefault(s, i) == i:
            sets[i] = s
    want = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert got == want and len(want) > len(sets)


def pairs_below(n, ids, at, comp, tails, percent):
    """Pairs whose tails, with the edge itself, share what the rest of the sets can lift to the similarity."""
    least = lambda k: -(-percent * k // 100)
    out = set()
    for x in range(len(ids)):
        for y in range(len(ids)):
            need = -(-percent * (n[x] + n[y]) // (100 + percent))
            fits = 100 * n[x] >= percent * n[y] and 100 * n[y] >= percent * n[x] and at[x] + need <= n[x] and at[y] + need <= n[y]
            if fits and comp[x] != comp[y] and (n[x], ids[x]) < (n[y], ids[y]):
                if 1 + len(set(tails[x]) & set(tails[y])) + max(least(n[x]), least(n[y])) - 1 >= need:
                    out.add((int(ids[x]), int(ids[y])))
    return out


def test_walks_below_an_edge():
    r = np.random.default_rng(4)
    for trial in range(150):
        m = int(r.integers(1, 25))
        n = r.integers(1, 40, m)
        ids, at, comp = r.permutation(100)[:m], r.integers(0, 3, m), r.integers(0, 6, m)
        tails = [np.unique(r.integers(0, r.choice([8, 60]), r.integers(0, 9))).astype(np.int64) for _ in range(m)]
        want = pairs_below(n, ids, at, comp, tails, 85)
        assert set(jaccard.edge_pairs(n, ids, at, comp, np.zeros(m, np.int64), tails, 85)) == want
        block = r.integers(0, 2, m)
        of = dict(zip(ids.tolist(), block.tolist()))
        apart = {(x, y) for x, y in want if of[x] != of[y]} if len(set(block.tolist())) > 1 else want
        assert set(jaccard.edge_pairs(n, ids, at, comp, block, tails, 85)) == apart
        del trial


@pytest.mark.parametrize("cell,counts", [(2, 1 << 26), (5, 40)])
def test_tiles_lose_no_pair(spark, docs, monkeypatch, cell, counts):
    """Edges with more sets than a cell, dealt in tiles, and walks in parts."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "COUNTS", counts)
    monkeypatch.setattr(jaccard, "STARS", 0)
    texts = corpus(3)[:160]
    want = components(list(enumerate(texts)), 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(texts)).collect()} == want


def test_one_shingle_in_many_unlinked_sets(spark, docs, monkeypatch):
    """An edge of thousands of sets that are not similar makes no pairs of all of them."""
    made = []
    plain = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: (made.append(pairs.count()), plain(pairs, *rest))[1])
    texts = [f"the very same words u{k} v{k} x{k} y{k} z{k} p{k} q{k}" for k in range(3000)] + ["the very same words u1 v1 x1 y1 z1 p1 q1 r1"]
    got = jaccard.jaccard_components(docs(texts), width=4, percent=80).collect()
    linked = [r["doc_id"] for r in got if r["component_id"] != r["doc_id"]]
    assert linked == [3000] and len(got) == 3001 and sum(made) < 30_000


def test_texts_that_share_an_id(spark):
    """One id with two texts is one document: linked with all that either is similar to."""
    a, b, c = "a b c d e f g h", "q r s t u v w x", "one two three four five six"
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(0, a), (1, a), (1, b), (2, b), (3, c), (7, long), (7, c), (8, long + " more"), (9, "z")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(0, 5): 0, (1, 5): 0, (2, 5): 0, (3, 3): 3, (7, 57): 3, (7, 3): 3, (8, 58): 3, (9, 1): 9}


def test_hot_classes_and_empty_texts(spark, docs, monkeypatch):
    """Copies of one text beyond the bound are joined by a broadcast, with the same result."""
    monkeypatch.setattr(jaccard, "HOT_SHARE", 0.0)
    texts = ["same words in all of these"] * 1500 + [None] * 500 + [""] * 500 + ["other words are in this one"] * 2
    got = jaccard.jaccard_components(docs(texts)).collect()
    assert len(got) == len(texts)
    assert all(r["component_id"] == (0 if r["doc_id"] < 1500 else 2500 if r["doc_id"] >= 2500 else r["doc_id"]) for r in got)


def test_query_against_sql(spark):
    import duckdb

    from paginal.llm import queries

    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet").toPandas()  # noqa: F841  read by DuckDB
    want = sorted(map(tuple, duckdb.sql(queries.OP6_SQL).fetchall()))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op6_ngram_jaccard(spark, folder).collect())
    assert got == want
