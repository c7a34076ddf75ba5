import random

import pytest

from narrascope.llm import ctw, registry
from test_ctw import brute_ctw, corpus


def test_query_mixes_contexts_of_seven_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ctw, "GRAM_SHARD", 3000)
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    model = brute_ctw(rows, 7)
    got = {r.doc_id: r.score for r in registry.queries()["op8_context_tree_lm"](spark, str(tmp_path)).collect()}
    assert got == {d: pytest.approx(model[d], rel=1e-9) for d, _ in rows}


def test_blocks_keep_contexts_whole(monkeypatch):
    import numpy as np

    monkeypatch.setattr(ctw, "BLOCK", 10)
    r = random.Random(1)
    key = np.array([(r.randrange(1 << 40) << 24) | (r.choice([3, 77, 900, 65535]) << 8) | r.randrange(256) for _ in range(60)], np.uint64)
    parts = [set(((k >> np.uint64(8)) & np.uint64(0xFFFF)).tolist()) for k, _ in ctw._blocks(key, np.arange(60))]
    assert sum(map(len, parts)) == 4 and list(ctw._blocks(key[:0], np.arange(0))) == []


def test_runs_come_back_whole():
    import numpy as np

    key = np.array([0, 5, 5 + (1 << 40), (1 << 64) - 1], np.uint64)
    for values in (np.array([1, 0, 3, 1 << 50]), np.array([0.5, -1.25, 0.0, 1e300])):
        k, v = ctw.unpack_run(ctw.pack_run(key, values), values.dtype.type)
        assert k.tolist() == key.tolist() and v.tolist() == values.tolist()
    k, v = ctw.unpack_run(ctw.pack_run(key[:0], np.zeros(0)), np.float64)
    assert not len(k) and not len(v)
