import math
import random

import numpy as np
import pytest

from paginal.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in rows:
        if i is not None and i % 50 == 0 and (i, v) in rows:
            own = [w for j, w in sound if j == i]
            if own:
                asked[i] = max(own)
    out = []
    for q, w in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in sound if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k=5, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, topk.exact_top_k(df, df.where("vec_id % 50 = 0"), k=k, **kw).collect()))


def test_brute_force_with_odd_rows(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 0.25, -0.5, r.uniform(-1, 1)]) for _ in range(8)]) for i in range(230)]
    rows += [(300, None), (301, [1.0, None] * 4), (350, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (304, [0.5] * 3), (305, [])]
    rows += [(i, [0.5] * 8) for i in range(400, 460)] + [(7, rows[7][1])]
    want = brute(rows, 5)
    assert run(spark, rows) == want
    # Several passes give the same rows.
    assert run(spark, rows, query_bytes=300) == want


def test_few_rows_and_empty(spark):
    assert run(spark, [(0, [1.0, 0.5]), (1, [0.5, 0.5])]) == [(0, 1, 1, 256 * 128 + 128 * 128)]
    assert run(spark, [(0, [1.0])]) == []
    assert spark.createDataFrame([], SCHEMA).transform(lambda d: topk.exact_top_k(d, d)).count() == 0


def test_ties_take_smaller_ids(spark):
    rows = [(0, [1.0])] + [(i, [0.5]) for i in range(9000, 0, -1)]
    assert [x[2] for x in run(spark, rows) if x[0] == 0] == [1, 2, 3, 4, 5]


def test_scores_beyond_a_long():
    with pytest.raises(ValueError):
        topk.Postings(np.array([1]), [np.array([2**40])]).scores(np.array([[2**40]]))
