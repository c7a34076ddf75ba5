import hashlib
import random

import pytest

from narrascope.llm import suffixes


def brute(rows, length):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinéß ") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(k) for k in (14, 20, 25, 30, 60, 200)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            if r.random() < 0.5:
                a = r.randint(0, len(p) // 3)
                p = p[a : a + r.randint(40, len(p))]
            parts += [prose(r.randint(0, 12)), p]
        rows.append((i, " ".join(parts)))
    for i in range(120, 150):  # near copies
        t = list(rows[i % 40][1])
        for _ in range(r.randint(0, 3)):
            if t:
                t[r.randrange(len(t))] = "Q"
        rows.append((i, "".join(t)))
    rows += [(150, None), (151, ""), (152, "a" * 5000), (153, "ab" * 700 + "x" + "ab" * 200), (154, "a" * 99), (155, "a" * 100), (None, rows[3][1])]
    r.shuffle(rows)
    return rows


def run(spark, rows, parts):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, doc string, v int").repartition(parts)
    return sorted((tuple(r) for r in suffixes.removal_report(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 7)])
def test_matches_brute_force(spark, seed, parts):
    rows = corpus(seed)
    assert run(spark, rows, parts) == brute(rows, 100)


def test_crowded_buckets_go_by_window(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_BUCKET", 2)
    rows = corpus(3)
    assert run(spark, rows, 3) == brute(rows, 100)


def test_rows_that_repeat_an_id(spark):
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh ") for _ in range(400))
    got = run(spark, [(1, text), (1, text), (2, text)], 2)
    assert [r[2] for r in got] == [0, 0, 400]


def test_no_documents(spark):
    assert run(spark, [], 1) == []


def same_eight_bits(text, r):
    """Another text whose hash ends in the same 8 bits."""
    import numpy as np

    from narrascope.llm.bytescan import Hasher

    def last(t):
        data = np.frombuffer(t.encode(), np.uint8)
        return int(Hasher(data).ranges(np.array([0]), np.array([len(data)]))[0]) & 0xFF

    while True:
        other = "".join(r.choice("ijklmnop ") for _ in range(300))
        if last(other) == last(text):
            return other


def test_texts_of_one_id_are_told_apart(spark):
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(150))
    second = "xxx" + passage + "tail"
    rows = [(1, passage), (2, second), (2, same_eight_bits(second, r)), (None, "z" * 30), (None, passage[:120]), (3, None), (3, "short")]
    got = run(spark, rows, 3)
    assert sorted((r[1], r[2]) for r in got) == sorted([(30, 0), (120, 0), (150, 120), (len(second), 150), (300, 0), (0, 0), (5, 0)])


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_and_null_ids_match_brute_force(spark, parts):
    rows = [(None if d is None or d % 11 == 0 else d // 3, t) for d, t in corpus(4)]
    rows += rows[:10]
    each = sorted({(d, t or "") for d, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(x[1].encode()).hexdigest()))
    report = {x: y[1:] for x, y in zip(each, brute([(k, t) for k, (_, t) in enumerate(each)], 100))}
    want = [(d, *report[d, t or ""]) for d, t in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(run(spark, rows, parts), key=key) == sorted(want, key=key)


def test_columns_of_any_name_pass_through(spark):
    r = random.Random(6)
    text = "".join(r.choice("abcdefgh ") for _ in range(300))
    df = spark.createDataFrame([(1, text, 1, "k", "s"), (2, text + "end", 2, "l", "t"), (2, "other", 3, "m", "u")], "doc_id long, text string, _key int, spans string, _spans string")
    got = {(x.doc_id, x._key): (x.text, x.spans, x._spans) for x in suffixes.remove_repeats(df).collect()}
    assert got == {(1, 1): (text, "k", "s"), (2, 2): ("end", "l", "t"), (2, 3): ("other", "m", "u")}
