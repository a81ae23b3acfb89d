import random

from paginal.operators import annotations as A

FMT = "page_id long, i int, anchor_start int, anchor_end int, flags int, layer int, priority int"
HIL = "page_id long, i int, anchor_start int, anchor_end int, flags int, color_id int, category_id int"


def run(spark, pages, fmt, hil):
    df = A.merge_runs(spark.createDataFrame(pages, "page_id long, n_tokens int"), spark.createDataFrame(fmt, FMT), spark.createDataFrame(hil, HIL))
    return sorted(map(tuple, df.collect()))


def test_fixture(spark):
    got = run(spark, [(1, 10)], [(1, 0, 2, 6, 1, 0, 0)], [(1, 0, 4, 8, 0, 3, 1)])
    no, bold = (False,) * 4, (True, False, False, False)
    assert got == [(1, 0, 2, *no, 0, 0), (1, 2, 4, *bold, 0, 0), (1, 4, 6, *bold, 3, 1), (1, 6, 8, *no, 3, 1), (1, 8, 10, *no, 0, 0)]


def test_no_tokens_no_marks(spark):
    assert run(spark, [(1, 0), (2, 3)], [], []) == [(2, 0, 3, False, False, False, False, 0, 0)]


def per_token(n, fmt, hil):
    """Display of each token, then runs."""
    far = 10**9
    looks = []
    for t in range(n):
        f = [x for x in fmt if x[2] <= t < (x[3] if x[3] > x[2] else far)]
        h = [x for x in hil if not x[4] & 1 and x[2] <= t < (x[3] if x[3] > x[2] else far)]
        k = max(f, key=lambda x: (x[5], x[6], -x[2], -x[1]))[4] if f else 0
        c = max(h, key=lambda x: (x[2], x[1]))[5:7] if h else (0, 0)
        looks.append((*(bool(k & b) for b in (1, 2, 4, 8)), *c))
    out, start = [], 0
    for t in range(1, n + 1):
        if t == n or looks[t] != looks[start]:
            out.append((start, t, *looks[start]))
            start = t
    return out


def test_random_pages(spark):
    r = random.Random(3)
    pages, fmt, hil, want = [], [], [], []
    for p in range(60):
        n = r.randrange(1, 15)
        f = [(p, i, r.randrange(15), r.randrange(16), r.randrange(16), r.randrange(3), r.randrange(2)) for i in range(r.randrange(5))]
        h = [(p, i, r.randrange(15), r.randrange(16), r.randrange(2), r.randrange(1, 4), r.randrange(3)) for i in range(r.randrange(5))]
        pages.append((p, n))
        fmt += f
        hil += h
        want += [(p, *x) for x in per_token(n, f, h)]
    assert run(spark, pages, fmt, hil) == sorted(want)


def test_counts_and_lookup(spark):
    f = spark.createDataFrame([(1, 0, 0, 1, 1, 0, 0), (1, 1, 0, 1, 1, 0, 0), (2, 0, 0, 1, 1, 0, 0)], FMT)
    assert sorted(map(tuple, A.page_counts(f).collect())) == [(1, 2), (2, 1)]
    assert A.of_page(f, 1).count() == 2
