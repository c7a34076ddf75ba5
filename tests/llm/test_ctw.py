import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from narrascope.llm import ctw


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def train_of(rows):
    return [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]


def brute_base(rows):
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    c = Counter(w for _, t in train_of(rows) for w in words(t))
    n, v = sum(c.values()), len(c)
    return {d: (len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for d, t in rows}


def brute_ctw(rows, depth):
    """Node by node, as the method is defined: counts, block probabilities, then conditional mixtures."""
    counts = defaultdict(lambda: [0, 0])

    def decisions(t):
        data = bytes(depth) + low(t).encode() + b"\0"
        for i in range(depth, len(data)):
            for k in range(8):
                yield data[i - depth : i], (1 << k) | (data[i] >> (8 - k)), (data[i] >> (7 - k)) & 1

    for _, t in train_of(rows):
        for context, node, bit in decisions(t):
            for d in range(depth + 1):
                counts[context[depth - d :], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    children, weighted = defaultdict(float), {}
    for (context, node), (a, b) in sorted(counts.items(), key=lambda x: -len(x[0][0])):
        own = kt(a, b)
        weighted[context, node] = own if len(context) == depth else math.log(0.5 * math.exp(own - max(own, children[context, node])) + 0.5 * math.exp(children[context, node] - max(own, children[context, node]))) + max(own, children[context, node])
        if context:
            children[context[1:], node] += weighted[context, node]
    out = {}
    for doc, t in rows:
        total = 0.0
        for context, node, bit in decisions(t):
            p = 0.5
            for d in range(depth, -1, -1):
                c = context[depth - d :], node
                if c not in counts:
                    p = 0.5
                    continue
                a, b = counts[c]
                own = ([a, b][bit] + 0.5) / (a + b + 1)
                w = 1.0 if d == depth else math.exp(kt(a, b) - math.log(2) - weighted[c])
                p = w * own + (1 - w) * p
            total += math.log10(p)
        out[doc] = total
    return out


def corpus():
    r = random.Random(3)
    words = ["the", "The", "and", "été", "of", "stone", "river,", "x"] + ["".join(r.choice("abcde") for _ in range(4)) for _ in range(40)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, "\n \t"), (63, "unseen" * 30), (64, "a" * 3000)]


@pytest.mark.parametrize("depth,shards", [(4, None), (2, 7)])
def test_matches_the_definition(spark, monkeypatch, depth, shards):
    if shards:
        monkeypatch.setattr(ctw, "WORD_SHARD", 9)
        monkeypatch.setattr(ctw, "GRAM_SHARD", 200)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1.0, "z") for d, t in rows], "doc_id long, text string, score double, base string").repartition(3)
    got = {r.doc_id: r for r in ctw.score_documents(df, depth).collect()}
    base, model = brute_base(rows), brute_ctw(rows, depth)
    for d, _ in rows:
        g = got[d]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (zlib.crc32(str(d).encode()) % 7 == 2, *base[d][:3])
        assert g.base_score == pytest.approx(base[d][3], rel=1e-9)
        assert g.score == pytest.approx(model[d], rel=1e-9)


def test_odd_tables(spark):
    assert ctw.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = ctw.score_documents(spark.createDataFrame([(2, "a b"), (2, "a b"), (None, "a")], "doc_id long, text string")).collect()
    assert len(got) == 3 and len({r.score for r in got if r.doc_id == 2}) == 1


def test_held_out_text_is_coded_well(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bytes_of = docs.selectExpr("doc_id", "octet_length(text) + 1 AS n")
    bits = {}
    for depth in (2, 4):
        r = ctw.score_documents(docs, depth).where("held_out").join(bytes_of, "doc_id").selectExpr("sum(score) AS s", "sum(n) AS n").first()
        bits[depth] = -r.s / math.log10(2) / r.n
    assert bits[4] < bits[2] < 3.2 and bits[4] < 2.6
