import random
import re

import pytest

from narrascope.llm import ngramjoin


def brute(rows, n, num, den):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}

    s = [(d, shingles(t)) for d, t in rows]
    at = {d: d for d, _ in s}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                at[q] = p
    return sorted((d, len(x), find(d)) for d, x in s)


def corpus(seed, n_docs=160):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéÀ,.") for _ in range(r.randint(1, 5))) for _ in range(400)]
    prose = lambda k: [r.choice(vocabulary) for _ in range(k)]
    shared = prose(60)
    rows = []
    for i in range(n_docs):
        if rows and r.random() < 0.6:
            w = list(r.choice(rows)[1])
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                if w:
                    k = r.randrange(len(w))
                    w[k : k + r.randint(0, 2)] = prose(r.randint(0, 2))
        else:
            w = prose(r.choice([1, 2, 3, 4, 5, 8, 30, 80, 200]))
            if r.random() < 0.5:
                k = r.randint(0, len(w))
                w[k:k] = shared
        rows.append((i * 7 % 1009, w))
    rows = [(d, r.choice([" ", "\n", "\t"]).join(w)) for d, w in rows]
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5003, "A b"), (5004, "a B"), (5005, "a")]
    r.shuffle(rows)
    return rows


def run(spark, rows, parts, *how):
    df = spark.createDataFrame([(d, t, 0, "t") for d, t in rows], "doc_id long, text string, n int, doc string").repartition(parts)
    return sorted(tuple(r) for r in ngramjoin.ngram_components(df, *how).collect())


@pytest.mark.parametrize("seed,parts,how", [(1, 3, (4, 85, 100)), (2, 1, (5, 80, 100)), (3, 8, (4, 85, 100))])
def test_matches_brute_force(spark, seed, parts, how):
    rows = corpus(seed)
    assert run(spark, rows, parts, *how) == brute(rows, *how)


def test_long_lists_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "LIST_ROWS", 2)
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", 2)
    rows = corpus(4)
    assert run(spark, rows, 4, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_odd_tables(spark):
    assert run(spark, [], 1) == []
    text = " ".join(map(str, range(50)))
    got = ngramjoin.ngram_components(spark.createDataFrame([(None, text), (3, text), (3, text), (4, "x")], "doc_id long, text string")).collect()
    assert sorted((r[0] is not None, r[0] or 0, r[2]) for r in got) == [(False, 0, None), (True, 3, None), (True, 3, None), (True, 4, 4)]


@pytest.mark.parametrize("seed", [5, 6])
def test_what_the_turns_leave_open_is_derived_from_leaders(spark, monkeypatch, seed):
    monkeypatch.setattr(ngramjoin, "MOST_TURNS", 1)
    monkeypatch.setattr(ngramjoin, "NEIGHBOURS", 1)
    derived = []
    real = ngramjoin._derived

    def seen(texts, pairs, links, *how):
        out = real(texts, pairs, links, *how)
        derived.append((pairs.count(), ngramjoin.leaders_of(links, 85, 100).count(), out.count()))
        return out

    monkeypatch.setattr(ngramjoin, "_derived", seen)
    monkeypatch.setattr(ngramjoin, "ALIKE", (85, 100))
    rows = corpus(seed, 220)
    assert run(spark, rows, 3, 4, 85, 100) == brute(rows, 4, 85, 100)
    assert derived and derived[0][0] > 20 and derived[0][1] > 5 and derived[0][2] > 0


def test_bounds_hold(spark):
    """Leaders decide what bounds can; what they leave open is compared itself."""
    base = [f"w{i}" for i in range(300)]
    texts = {1: base, 2: base[:-3] + ["a", "b"], 10: base[:270] + [f"x{i}" for i in range(25)], 11: base[:270] + [f"x{i}" for i in range(22)] + ["y"], 30: [f"z{i}" for i in range(300)]}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc long, text string")
    size = {k: len(w) - 3 for k, w in texts.items()}
    shingle = {k: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for k, w in texts.items()}
    pairs = [(x, y) for x in texts for y in texts if x < y and (x, y) not in ((1, 2), (10, 11))]
    links = ngramjoin._compared(df, spark.createDataFrame([(1, 2), (10, 11)], "x long, y long"), 4, 85, 100)
    assert {(x.doc, x.leader) for x in ngramjoin.leaders_of(links).collect()} == {(2, 1), (11, 10)}
    p = spark.createDataFrame([(x, y, size[x], size[y]) for x, y in pairs], "x long, y long, nx long, ny long")
    for num in (75, 80, 85, 95):
        got = {(x.v, x.u) for x in ngramjoin._derived(df, p, links, 4, num, 100).collect()}
        want = {(x, y) for x, y in pairs if 100 * len(shingle[x] & shingle[y]) >= num * len(shingle[x] | shingle[y])}
        assert got == want, num
