import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from narrascope.llm.packing import pack, plan_best_fit
from narrascope.llm.registry import vocabulary
from narrascope.llm.tokenfile import StoredTokens, TokenFile, encode_file, read_token_files, store, write_token_files

ODD = [
    "", None, " ", "\n\n", "a", "Hello world", " don't  stop.\nNow\tgo.\n\n  end ", "naïve café  x　y é,è!", "word,word.Word;x", "x" * 5000,
    "<|endoftext|> it's <|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>.y <|endoftext|>\n<|endoftext|>  z<|endoftext", "<|endoftext|><|endoftext|>", "日本語 text 123,456.78   z", "a \n b\n\nc \r\n d", "é à\nÉ\n.\n!", "1. 2, 3:4 ?!",
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start string, piece int")


@pytest.fixture(scope="module")
def rows():
    out = [(i * 3 % 17, t, "x", None) for i, t in enumerate(ODD)]
    return [*out, (3, "twice", None, 1), (3, "twice", None, 1), (None, "no id", None, None), (99, " ".join(f"w{i}" for i in range(6000)), "y", 1)]


def ids_of(text, end):
    t = Tokenizer.from_file(vocabulary())
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_codes_give_any_token():
    ids = np.array([0, 255, 256, 65535, 65536, 2**31, 7] * 400, np.uint32)
    f = TokenFile(b"".join(encode_file([5, None], np.array([1000, 1800]), ids)))
    assert [f.token(i) for i in range(0, len(ids), 37)] == ids[::37].tolist()
    for lo, hi in ((0, 0), (3, 900), (511, 513), (1000, 2800), (2799, 2800)):
        assert f.tokens(lo, hi).tolist() == ids[lo:hi].tolist()
    assert f.document(1).tolist() == ids[1000:].tolist()


def test_stored_files_give_any_token_by_few_bytes(tmp_path):
    ids = np.random.default_rng(4).integers(0, 70_000, 5000).astype(np.uint32)
    uri = f"file://{tmp_path}/x/one.dac"
    store(uri, encode_file([5, None, 9], np.array([1000, 0, 4000]), ids))
    with StoredTokens(uri) as f:
        opened = f.bytes_read
        assert [f.token(i) for i in range(0, len(ids), 41)] == ids[::41].tolist()
        assert f.bytes_read - opened < len(range(0, len(ids), 41)) * 3 * (1 + 8 + 64)
        assert f.document_span(2) == (9, 1000, 5000) and f.document_span(1) == (None, 1000, 1000) and len(f) == 5000
        with pytest.raises(IndexError):
            f.token(5000)


def test_token_files_match_the_library(spark, rows):
    got = read_token_files(write_token_files(frame(spark, rows), vocabulary(), file_tokens=4000)).collect()
    want, start = [], 0
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = ids_of(text, 2)
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_no_documents(spark):
    assert read_token_files(write_token_files(frame(spark, []), vocabulary())).count() == 0
    assert pack(frame(spark, []), vocabulary()).count() == 0


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, rows, capacity):
    got = pack(frame(spark, rows), vocabulary(), capacity=capacity).collect()
    want = []
    for doc, text, *_ in rows:
        ids = ids_of(text, 0)
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(doc, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in got) // capacity)
    assert len(sequences) <= least * 1.1 + 1


def test_plan_is_best_fit_over_counts():
    plan = plan_best_fit({7: 3, 5: 2, 3: 4, 10: 1}, 10)
    used = defaultdict(int)
    for length, lo, hi, first, offset in plan:
        for k in range(hi - lo):
            assert used[first + k] == offset
            used[first + k] += length
    assert max(used.values()) <= 10 and len(used) == 6


def test_a_full_cache_starts_anew_and_loses_nothing(monkeypatch):
    from narrascope.llm import tokenize

    monkeypatch.setattr(tokenize, "CACHE", 5)
    enc, plain = tokenize.PieceEncoder(vocabulary()), Tokenizer.from_file(vocabulary())
    r = np.random.default_rng(1)
    words = ["the", "of", "river", "stone", "été", "x1"] + [f"w{k}" for k in range(40)]
    for _ in range(12):
        texts = [" ".join(r.choice(words, r.integers(0, 30))) for _ in range(6)]
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
        ids, counts = enc.encode(raw, off)
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
