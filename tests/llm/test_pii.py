import hashlib
import itertools
import random
import re

import numpy as np

from paginal.llm import pii, pii_table, queries

from .pii_held_out import held_out

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        total += int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c))))
    return total % 10 == 0


def test_patterns_against_plain_expressions():
    r = random.Random(4)
    for _ in range(20_000):
        text = "".join(r.choices("a1..@@+2 -0()%5é\n", k=r.randrange(40)))
        assert pii.base_spans(text) == brute(text)
    for text in ["4111 1111-1111 1111", "1.2.3.4.5.6.7.8", "256.1.1.1", "a@b", "a@b.c@d.e", "+1 (555) 010-9999", "0000000000000000", "x" * 50 + "@y.z", "1.02.003.0004"]:
        assert pii.base_spans(text) == brute(text)


def test_long_texts_take_time_in_proportion():
    for text in ("a" * 3_000_000, "1" * 3_000_000, "a@" * 300_000, "1." * 300_000, "+1" * 300_000, "1 " * 300_000):
        pii.base_spans(text)


def shares(table):
    """(precision, recall) of the field's spans, by kind and exact place."""
    right = found = wanted = 0
    for (_, spans), (base, added) in zip(table, pii.all_spans([t for t, _ in table], pii.trained())):
        want = {s for s in spans if not any(s[1] < e and b < s[2] for _, b, e in base)}
        right, found, wanted = right + len(want & set(added)), found + len(added), wanted + len(want)
    return right / found, right / wanted


def test_the_field_learns_its_table():
    assert min(shares(pii_table.labelled())) > 0.95


def test_other_values_in_the_same_lines():
    assert min(shares(pii_table.labelled(seed=1))) > 0.95


def test_held_out_lines():
    """Lines written apart from the table: other wording, other values."""
    precision, recall = shares(held_out())
    assert precision >= 0.9 and recall >= 0.9


def test_expectations_against_all_paths():
    """Forward-backward of padded chains against sums over all labellings."""
    r = np.random.default_rng(5)
    k = 3
    f = pii.Field({}, np.zeros((0, k)), r.normal(size=(k, k)), r.normal(size=k), r.normal(size=k))
    e, size = r.normal(size=(3, 4, k)), np.array([4, 1, 2])
    cells, moves, z = pii.expectations(e, size, f)
    all_moves = np.zeros((k, k))
    for c, n in enumerate(size):
        weight = {p: np.exp(f.first[p[0]] + sum(e[c, i, x] for i, x in enumerate(p)) + sum(f.moves[a, b] for a, b in zip(p, p[1:])) + f.last[p[-1]]) for p in itertools.product(range(k), repeat=int(n))}
        total = sum(weight.values())
        assert abs(np.log(total) - z[c]) < 1e-9
        for t in range(n):
            for x in range(k):
                assert abs(sum(w for p, w in weight.items() if p[t] == x) / total - cells[c, t, x]) < 1e-9
        assert not cells[c, n:].any()
        for p, w in weight.items():
            for a, b in zip(p, p[1:]):
                all_moves[a, b] += w / total
    assert np.abs(all_moves - moves).max() < 1e-9


def test_viterbi_against_all_paths():
    r = np.random.default_rng(3)
    k = len(pii.LABELS)
    rows = [run for run, _ in pii.labelled_chains(pii_table.labelled(fills=1)) if len(run) <= 4]
    names = sorted({f for run in rows for fs in pii.features(run) for f in fs})
    field = pii.Field({f: i for i, f in enumerate(names)}, r.normal(size=(len(names), k)), r.normal(size=(k, k)), r.normal(size=k), r.normal(size=k))
    assert len(rows) > 20
    for run, got in zip(rows[:30], field.decode(rows)):
        e = field.emissions(run)
        score = lambda p: field.first[p[0]] + sum(e[i, x] for i, x in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:])) + field.last[p[-1]]  # noqa: E731, B023
        assert max(itertools.product(range(k), repeat=len(run)), key=score) == tuple(got)


def test_windows_and_chains(monkeypatch):
    """Windows cover what opens them, in order and apart; tokens lie outside taken spans."""
    r = random.Random(8)
    for _ in range(3000):
        text = "".join(r.choices(["a", "7", " ", "\n", "name", "é", "x.y@z.de", "İ", "=", "(", "1.2.3.4"], k=r.randrange(120)))
        parts = list(pii.windows(text))
        assert all(a < b for a, b in parts) and all(x[1] <= y[0] for x, y in zip(parts, parts[1:]))
        assert all("\n" not in text[a:b] for a, b in parts)
        assert all(any(a <= m.start() < b for a, b in parts) for m in re.finditer("[0-9]", text))
        taken = pii.base_spans(text)
        for run in pii.chains(text, taken):
            assert all(text[t.start : t.end] == t.core for t in run if t.end > t.start)
            assert not any(t.start < e and s < t.end for t in run for _, s, e in taken)
    monkeypatch.setattr(pii, "LONGEST", 5)
    assert {len(run) for run in pii.chains("1 " * 50, [])} == {5}


def test_windows_take_time_in_proportion():
    for text in ("7" * 2_000_000, "7a" * 1_000_000, "name" * 500_000, "x" * 2_000_000 + "7", "7\n" * 300_000):
        assert sum(b - a for a, b in pii.windows(text)) <= len(text)


def plain_labels(field, run):
    """Viterbi over a whole line, token by token, from the features' names."""
    e = field.emissions(run)
    best, back = field.first + e[0], []
    for row in e[1:]:
        paths = best[:, None] + field.moves
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + row
    out = [int((best + field.last).argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def test_whole_lines_against_plain_viterbi(monkeypatch):
    """Labels through tables, slices and proved places are those of every whole line; slices may be of any size."""
    r = random.Random(11)
    words = ["the", "Anna", "password", "=", "7", "x9Kq27LmPw83TbVc51Ry", "passport", "X1234567", "12/05/1980", "(", "name", "none", "ß", "call", "555-0100", "a@b.cd", "born", "..", "12", "Main", "Street", "é9"]
    table = "".join(r.choice(words) + r.choice([" ", " ", "\n", ", ", "  "]) for _ in range(4000)) + "7 " * 200
    field = pii.trained()
    noise = np.random.default_rng(2)
    loud = pii.Field(field.index, field.weights + noise.normal(size=field.weights.shape), *(x + noise.normal(size=x.shape) for x in (field.moves, field.first, field.last)))
    whole = None
    for f in (field, loud):
        for slice_, stretch, held in ((1 << 16, 1 << 18, 1 << 18), (7, 5, 3)):
            for name, size in (("SLICE", slice_), ("STRETCH", stretch), ("HELD", held)):
                monkeypatch.setattr(pii, name, size)
            taken = pii.base_spans(table)
            tokens = [t for first, edge, token in pii.stretches(table, taken) for t in (*pii._PART.findall(table, first, edge), *([token] if token else []))]
            assert whole in (None, tokens)
            whole = tokens
            lexicon = f.lexicon()
            got = f.labels(lexicon, np.concatenate([[0, 0], lexicon.rows(tokens), [0, 0]]).astype(np.int32))[2:-2]
            monkeypatch.setattr(pii, "LONGEST", 1 << 30)
            want = [plain_labels(f, run) for run in pii.chains(table, taken)]
            lines = [[]]
            for token, label in zip(tokens, got.tolist()):
                lines.append([]) if token == "\n" else lines[-1].append(label)
            assert [x for x in lines if x] == want


def test_every_token_is_looked_at():
    """A field that marks whatever it sees marks all of a text without digits or cues, in lines of any length."""
    k = len(pii.LABELS)
    weights = np.zeros((1, k))
    weights[0, pii.LABELS.index("person")] = 1
    field = pii.Field({"bias": 0}, weights, np.zeros((k, k)), np.zeros(k), np.zeros(k))
    texts = ["alpha beta " * 3000 + "end", "one\ntwo\n\nthree", "plain", "İ ab"]
    got = [[t[a:b] for _, a, b in added] for t, (_, added) in zip(texts, pii.all_spans(texts, field))]
    assert got == [[texts[0]], ["one", "two", "three"], ["plain"], ["İ ab"]]


def test_values_far_from_their_cues():
    """Values that lie beyond 64 characters from what announces them, and cues beside letters whose lower case is longer."""
    texts = [
        "Name:" + " " * 90 + "Anna Schneider",
        "date of birth" + " " * 90 + "07/11/1979",
        "passport" + " ." * 50 + "\nnumber of passport:" + " " * 80 + "X1234567",
        "İstanbul PASSWORD: opensesame",
    ]
    got = [[(k, t[a:b]) for k, a, b in added] for t, (_, added) in zip(texts, pii.all_spans(texts, pii.trained()))]
    assert got == [[("person", "Anna Schneider")], [("birth_date", "07/11/1979")], [("document_id", "X1234567")], [("secret", "opensesame")]]


def test_spans_beside_patterns():
    """A pattern span hides nothing else in the same run of characters; brackets belong to a number."""
    field = pii.trained()
    texts = ["jane@x.org,219-09-9999", "ring (718) 555-0100 now", "Version 3.0.1 of 2021", None, "", "call \n"]
    got = [[(k, t[a:b]) for k, a, b in added] for t, (_, added) in zip(texts, pii.all_spans(texts, field))]
    assert got == [[("national_id", "219-09-9999")], [("phone_local", "(718) 555-0100")], [], [], [], []]


def test_clean_prose_stays(spark):
    """Of the documents without any digit, at most one in a hundred gets a span."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r["text"] for r in docs.select("text").collect() if r["text"] and not re.search("[0-9]", r["text"])]
    assert sum(bool(a) for _, a in pii.all_spans(texts, pii.trained())) <= 0.01 * len(texts)


def test_clashing_names_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "write a@b.cd", "x", "y"), (1, "write a@b.cd", "x", "y"), (None, None, "x", "y")], "doc_id long, text string, __text string, _text string")
    rows = pii.find(df).collect()
    assert len(rows) == 3 and sorted(len(r["spans"]) for r in rows) == [0, 1, 1] and pii.find(df).columns == [*df.columns, "spans"]
    assert pii.redact(df).columns == df.columns and pii.redact(df).count() == 3


def test_query_and_redaction(spark, docs, tmp_path):
    texts = [None, "", "write to a.b@c.example or +1 (017) 555-7713, ip 1.2.3.4", "plain words", "plain words", "4111 1111 1111 1111 " * 3, 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" é a@b.cd']
    df = docs(texts)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in queries.op7_pii(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        want = brute(text or "")
        joined = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        r = rows[k]
        assert [r[f"n_{x}"] for x in pii.BASE] == [sum(s[0] == x for s in want) for x in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[0] is None and clean[3] == "plain words"
    assert clean[2] == "write to [EMAIL] or [PHONE], ip [IP]"
    assert clean[6] == 'token = "[SECRET]" é [EMAIL]'
    assert pii.find(df.selectExpr("*", "1 as spans").limit(0)).columns == ["doc_id", "text", "spans"]
    assert pii.redact(df.limit(0)).count() == 0
