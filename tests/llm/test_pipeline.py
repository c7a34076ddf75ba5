import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from narrascope.llm.registry import vocabulary


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    r = random.Random(8)
    stop = ["the", "of", "and", "to", "in", "is", "that", "it", "as", "with"]
    word = lambda: r.choice(stop) if r.random() < 0.4 else "".join(r.choice("abcdefghé") for _ in range(r.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    texts = [prose(90) for _ in range(40)]
    rows = dict(enumerate(texts))
    rows[100] = texts[3]  # a copy
    rows[101] = texts[4].replace(" the ", " the  ", 1)  # the same words
    passage = prose(60)
    rows[102], rows[103] = f"{prose(70)} {passage}", f"{prose(80)} {passage} {prose(30)}"
    item = prose(30)
    rows[104] = f"{prose(70)} {item} {prose(10)}"
    rows[105], rows[106], rows[107] = "too short", None, " ".join(f"w{i}###" for i in range(120))
    data = [(k, t, "en", "s", None if t is None else len(t)) for k, t in rows.items()]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), rows, passage


def test_stages_take_effect(spark, tables):
    where, rows, passage = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = corpus_pipeline.runtime.staged(docs, "stage")
        kept.append({r.doc_id: r for r in docs.collect()})
    clean = set(range(40))
    assert set(kept[0]) == clean | {100, 101, 102, 103, 104}
    assert set(kept[1]) == clean | {102, 103, 104}
    assert set(kept[2]) == set(kept[1]) and passage[5:-5] not in kept[2][103].text and passage in kept[2][102].text
    assert all(r.n_chars == len(r.text) for r in kept[2].values())
    assert all(kept[2][i].text == rows[i] for i in clean)
    assert set(kept[3]) == clean | {102, 103}
    texts = {k: r.text for k, r in kept[3].items()}

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    got = corpus_pipeline.run(spark, where).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        ids = [*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, spans string, kept boolean, length int"


def stored(spark, where, rows, items=()):
    spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t), 7, "x", False, 1) for k, t in rows], SCHEMA).repartition(2).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def stages(spark, where):
    docs, out = spark.read.parquet(f"{where}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.runtime.staged(stage(spark, docs, where), "stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        out.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr))
    return out, corpus_pipeline.STAGES[-1][1](spark, docs, where)


def test_no_documents(spark, tmp_path):
    kept, packed = stages(spark, stored(spark, tmp_path, []))
    assert kept == [[], [], [], []] and packed.count() == 0


def test_repeated_and_null_ids_odd_texts_and_other_columns(spark, tmp_path):
    r = random.Random(12)
    stop = ["the", "of", "and", "to", "in", "is", "that", "it", "as", "with"]
    word = lambda: r.choice(stop) if r.random() < 0.4 else "".join(r.choice("abcdefghé") for _ in range(r.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    a, b, c, long = prose(120), prose(130), prose(110), prose(40_000)
    base = [(k, prose(100)) for k in range(20, 60)]
    rows = [*base, (1, a), (1, a), (2, b), (2, "short"), (3, c), (4, c), (5, long), (6, ""), (7, None), (None, None), (None, "short too"), (None, prose(90)), (8, long + " end")]
    kept, packed = stages(spark, stored(spark, tmp_path, rows, [(1, None), (None, "x"), (2, "")]))
    ids = [{k for k, _ in x} for x in kept]
    clean = {k for k, _ in base}
    assert ids[0] == clean | {1, 3, 4, 5, 8, None}  # 2 goes with its short text
    assert ids[1] == clean | {1, 3, 5, None} and [x for x in kept[1] if x[0] == 1] == [(1, a), (1, a)]
    assert (5, long) in kept[2] and (None, None) not in kept[2] and (None, "short too") in kept[2]
    assert kept[3] == kept[2]
    pieces = packed.collect()
    assert {p.doc_id for p in pieces} == ids[3] and max(p.piece for p in pieces if p.doc_id == 5) > 20
