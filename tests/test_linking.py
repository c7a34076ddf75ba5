import random

from narrascope.operators.linking import link_aliases


def plain(text, names):
    words, at, out = text.lower().split(), 0, []
    while at < len(words):
        fits = [n for n in range(1, 6) if " ".join(words[at : at + n]) in names and at + n <= len(words)]
        if fits:
            said = " ".join(words[at : at + max(fits)])
            out.append((at, max(fits), said, names[said]))
            at += max(fits)
        else:
            at += 1
    return out


def test_longest_name_that_begins_first(spark):
    draw = random.Random(8)
    texts = {k: " ".join(draw.choice("a b c D e é".split()) for _ in range(draw.randrange(0, 40))) for k in range(60)}
    aliases = [(" ".join(draw.choice("A b c d e É".split()) for _ in range(draw.randrange(1, 5))), f"n{k}") for k in range(25)] + [("a, b!", "n90"), ("", "n91"), (None, "n92"), ("c", None)]
    names = {}
    for alias, entity in aliases:
        said = " ".join((alias or "").lower().replace(",", " ").replace("!", " ").split())
        if said and entity:
            names[said] = min(entity, names.get(said, entity))
    rows = [(k, t, "x") for k, t in texts.items()] + [(100, None, "x"), (0, texts[0], "x"), (101, "a " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, alias string").repartition(3)
    table = spark.createDataFrame(aliases, "alias string, entity_id string")
    got = sorted(map(tuple, link_aliases(docs, table).collect()))
    assert got == sorted((k, *x) for k, t in {**texts, 101: "a " * 3000}.items() for x in plain(t, names))
    assert link_aliases(docs, table.limit(0)).count() == 0 and link_aliases(docs.limit(0), table).count() == 0
