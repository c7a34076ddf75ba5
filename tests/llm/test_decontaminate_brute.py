"""The operator against its definition, window by window, and its recall on re-parameterised questions."""

import math
import random

import pytest
import regex

from narrascope.llm.decontaminate import UNITS, contaminated
from test_decontaminate import prose


def token_lists(text):
    """words, raw, template"""
    text = text or ""
    text = regex.sub(r"\p{Lu}(?<![\p{L}\p{N}].)(?=\p{Ll})", lambda m: "\x01" + m[0], text)
    text = regex.sub(r"\x01([\p{L}\p{N}]+)[\x09-\x0D ]+(?=\x01)", lambda m: f"\x01{m[1]}\x05", text)
    text = regex.sub(r"(?<=\p{N})[.,](?=\p{N})", "\x04", text)
    raw = regex.findall(r"[\p{L}\p{N}\x01\x04\x05]+", text.lower())
    words = regex.findall(r"[\p{L}\p{N}]+", " ".join(raw).replace("\x01", ""))
    template = []
    for t in raw:
        slot = "\x01" if t[0] == "\x01" else "\x02" if regex.match(r"\p{L}*+\p{N}", t) else t
        template.append("\x03" if slot in UNITS and template and template[-1] == "\x02" else slot)
    return words, raw, template


def brute(docs, items, n=8, least_literals=4, least_tokens=13, share=0.6):
    slot = lambda t: t in ("\x01", "\x02", "\x03")
    out = {}
    for doc, text in docs:
        words, raw, template = token_lists(text)
        for item, said in items:
            i_words, i_raw, i_template = token_lists(said)
            for mine, theirs in ((words, i_words), (template, i_template)):
                k = min(n, len(theirs))
                need = min(least_tokens, math.ceil(len(theirs) * share))
                runs = {}
                for at in range(len(theirs) - k + 1 if k else 0):
                    w = theirs[at : at + k]
                    if theirs is i_template and sum(not slot(t) for t in w) < least_literals:
                        continue
                    for pos in range(len(mine) - k + 1):
                        if mine[pos : pos + k] == w:
                            runs.setdefault(pos - at, set()).update(range(at, at + k))
                parts, last = [], None
                for shift in sorted(runs):
                    if last is None or shift - last > n:
                        parts.append([])
                    parts[-1].append(shift)
                    last = shift
                for part in parts:
                    if len(set().union(*(runs[s] for s in part))) < need:
                        continue
                    good = set()
                    for s in part:
                        pairs = {(i_template[i], i_raw[i], raw[i + s]) for i in runs[s] if slot(i_template[i])} if theirs is i_template else set()
                        if len(pairs) == len({p[:2] for p in pairs}):
                            good |= runs[s]
                    if len(good) >= need:
                        out[doc, item] = max(out.get((doc, item), 0), len(good))
    return out


FIRST = "Tom Sara Priya Kenji Olga Bruno Amara Lukas Ines Piet".split()
OTHER = ["Mia", "Bob", "Mary Lou", "Zed", "Anna Maria", "Yusuf", "Kai", "Rosa", "Jean Paul", "Eve"]
THINGS = "apples pencils marbles books stamps cards tickets shells coins kites".split()
SHAPES = [
    "{a} has {x} red {t}. {b} gives {a} {y} more {t} after lunch. How many red {t} does {a} have in all?",
    "A train leaves at {x} and runs {y} km in {z} hours while {a} waits {w} minutes. How fast does the train of {a} go on average?",
    "{a} buys {x} {t} for {y} dollars each and sells them for {z} dollars each. What profit does {a} make on the whole sale?",
    "If {a} reads {x} pages of a book every day and {b} reads {y} pages, who will first finish a book of {z} pages and when?",
    "In a box there are {x} {t} and {y} {u}. {a} takes away {z} {t} without looking. How likely is it that none is broken?",
    "{a} and {b} walk towards each other from towns {x} km apart at {y} and {z} km per hour. When do they meet on the road?",
]


def question(r, names, number):
    t, u = r.sample(THINGS, 2)
    return r.randrange(len(SHAPES)), t, u, r.sample(names, 2), [number(r) for _ in range(4)]


def said(q, names=None, numbers=None):
    shape, t, u, own, ns = q
    a, b = names or own
    x, y, z, w = numbers or ns
    return SHAPES[shape].format(a=a, b=b, x=x, y=y, z=z, w=w, t=t, u=u)


def plain(r):
    return str(r.randint(2, 97))


def odd(r):
    return r.choice([f"{r.randint(1, 9)},{r.randint(100, 999)}", f"{r.randint(1, 40)}.{r.randint(10, 99)}", str(r.randint(2, 9999))])


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_the_definition(spark, seed):
    r = random.Random(seed)
    items = [(i, said(question(r, FIRST, plain))) for i in range(12)]
    items += [(20, "Short Tom has 3"), (21, "7 8 9 10 11 12 13 14 15"), (22, None), (23, ""), (24, prose(77, 30)), (25, items[0][1])]
    docs = []
    for k in range(60):
        text = r.choice([i for i in items if i[1]])[1]
        w = text.split(" ")
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], ["Zoe"], ["5"], ["other"], [w[at], "new"], [w[at].upper()], ["1,5"], ["Jo", "Ann"]])
        docs.append((k, f"{prose(k, r.randint(0, 20))}{r.choice(['. ', ' ', chr(10)])}{' '.join(w)}{r.choice(['', ' ', '! '])}{prose(k + 100, r.randint(0, 9))}"))
    docs += [(90, None), (91, ""), (92, "\x01 \x02 Tom \x04 7"), (93, prose(9, 3000) + " " + items[3][1])]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.n_tokens for x in contaminated(d, b).collect()}
    assert got == brute(docs, items) and len(got) > 40


def test_recall_on_other_names_and_numbers(spark):
    r = random.Random(8)
    questions = [question(r, FIRST, plain) for _ in range(120)]
    b = spark.createDataFrame([(i, said(q)) for i, q in enumerate(questions)], "item_id long, text string")
    docs = []
    for i, q in enumerate(questions):
        names = r.sample(OTHER, 2)
        values = {v: odd(r) for v in q[4]}  # one value for each
        docs.append((i, f"{prose(i, 40)}. {said(q, names, [values[v] for v in q[4]])} {prose(i + 500, 30)}"))
        docs.append((1000 + i, prose(i + 2000, 90)))
    pairs = {(x.doc_id, x.item_id) for x in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert sum((i, i) in pairs for i in range(120)) >= 0.9 * 120
    assert not [p for p in pairs if p[0] >= 1000]


def test_contradicting_slots_are_no_match_however_long(spark):
    tail = prose(31, 5)
    item = f"first {tail} at 10 then {prose(32, 5)} at 10 and {prose(33, 5)} at 10 end"
    other = f"first {tail} at 11 then {prose(32, 5)} at 12 and {prose(33, 5)} at 13 end"
    same = f"first {tail} at 11 then {prose(32, 5)} at 11 and {prose(33, 5)} at 11 end"
    docs = [(1, other), (2, same)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in contaminated(d, b).collect()}
    assert got == set(brute(docs, [(1, item)])) == {(2, 1)}
