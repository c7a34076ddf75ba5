import hashlib
import zlib

import pytest

from narrascope.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    said = ["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*row[:4], text)]
    return h(*said)


def tree(nodes):
    """Root, and for each node the siblings level by level as (left, right)."""
    ways = [[] for _ in nodes]
    at, level = list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for way, p in zip(ways, at):
            run = p // 16 * 16
            way.append((level[run:p], level[p + 1 : run + 16]))
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [p // 16 for p in at]
    return level[0], ways


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, held = [], []
    for s in order:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        root, ways = tree([leaf(r, r[4]) for r in own])
        subs.append(root)
        held.append((own, ways))
    root, over = tree(subs)
    out = []
    for sub, above, (own, ways) in zip(subs, over, held):
        for r, way in zip(own, ways):
            way = way + above
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if c.isascii() else c for c in text)
            node = leaf(r, text)
            for a, b in way:
                node = h(*a, node, *b)
            out.append((r[0], leaf(r, r[4]), sub, root, h(*[x for a, b in way for x in (*a, *b)]), node, node == root))
    return out


ROWS = [(i, ["hot", "hot", "hot", f"s{i % 7}", None, "é", "Z"][i % 7], "en" if i % 3 else None, i if i % 5 else None, ["Text " + "x" * (i % 90), "ÄB c", None, ""][i % 4]) for i in range(700)]
ROWS += [(5, "hot", "en", 1, "twin"), (5, "hot", "en", 1, "twin"), (5, "hot", "en", 1, "Other"), (None, "hot", "en", 1, "No id"), (None, None, None, None, None), (9007199254740993, "lone", "en", 3, "A" * 300_000)]
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int").repartition(5)


@pytest.mark.parametrize("levels, top", [(3, 2000), (1, 30), (1, 4)])
def test_against_brute_force(spark, levels, top):
    # 30: several rounds of blocks; 4: more sources than the driver takes
    got = merkle.manifest(table(spark, ROWS), levels=levels, most_top=top)
    assert got.columns == COLUMNS
    key = lambda r: (str(r[0]), r[1], r[4])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(ROWS), key=key)


def test_proofs_tell_what_was_changed(spark):
    got = merkle.manifest(table(spark, ROWS)).collect()
    assert any(not r.verified for r in got) and any(r.verified for r in got)
    for r in got:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5:
            assert r.verified


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "lone leaf")], [(i, "s", None, None, "t") for i in range(17)]])
def test_small_tables(spark, rows):
    got = merkle.manifest(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows) if rows else [], key=str)
