import math
import random
import re
from collections import Counter

import pytest

from narrascope.llm import quality


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


TEXTS = [
    None, "", "  \n\t ", "one", "a b", "a b c", "a b c a b c", "x " * 60, "a\x0bb\x0cc\rd  e f", "l1 w\nl1 w\n\n \nl2\nl1 w", "é$ß|日本 #", " lead and trail \n",
    "the quick a b c d " * 20, " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)), " ".join(["a b c"] + [f"w{i}" for i in range(60)] + ["a b c a b"]),
]


def test_base_columns(spark):
    df = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: tuple(r)[1:7] for r in quality.judge(df).collect()}
    assert got == {i: base(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("p,q", [([1, 2, 3], [3, 2, 1]), ([1, 0], [0, 5]), ([2, 2], [1, 1])])
def test_distance(spark, p, q):
    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
    want = math.sqrt(sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(a, b)) / 2)
    df = spark.createDataFrame([(p, q, [0, 0])], "p array<long>, q array<long>, z array<long>")
    row = df.select(quality.js_distance(df.p, df.q), quality.js_distance(df.p, df.z)).first()
    assert row[0] == pytest.approx(want, abs=1e-12) and row[1] is None


def test_verdicts(spark):
    r = random.Random(1)
    word = lambda: r.choice(["the", "of", "and", "to", "in", "is", "that"]) if r.random() < 0.4 else "".join(r.choice("abcdefg") for _ in range(5))
    rows = [(i, ". ".join(" ".join(word() for _ in range(12)) for _ in range(12)), "en") for i in range(300)]
    rows.append((1000, "".join(f"w{i}### v{i}$$$ u{i}%%% " for i in range(60)), "en"))
    rows.append((1001, " ".join(f"keyword{i}, offer{i}" for i in range(60)), None))
    rows.append((1002, "| ".join(f"keyword{i} offers" for i in range(90)), "en"))
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i in range(300)) and not kept[1000] and not kept[1002]
    assert kept[1001]  # the only document without a language is its own reference


def test_no_documents(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_long_texts_and_clashing_names(spark):
    long = " ".join(f"w{i % 977} x{i}" for i in range(40_000))
    df = spark.createDataFrame([(1, long, "en", 7, "k"), (1, long, "en", 8, "l")], "doc_id long, text string, lang string, n_words int, _words string")
    assert [tuple(r)[1:7] for r in quality.judge(df).collect()] == [base(long)] * 2
    with pytest.raises(ValueError):
        quality.judge(df, ["doc_id", "N_words"])
