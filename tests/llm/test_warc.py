import base64
import hashlib
import struct

import zstandard

from narrascope.llm import warc

PAGES = [(5, "http://a/", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "http://b/\r\nX: y", "<p>é</p>"), (2, "u", None), (7, "v", ""), (8, "w", "x\r\n\r\ny"), (None, "n", "only")] + [(100 + i, f"http://h/{i}", "<html>" + "body " * (i % 40) + "</html>") for i in range(90)]


def want(pages, least):
    first = {}
    for p, _, h in sorted(pages, key=lambda r: (r[0] is not None, r[0] or 0)):
        first.setdefault(h or "", p)
    out = []
    for p, _, h in pages:
        raw = (h or "").encode()
        refers = first[h or ""] if len(raw) >= least and first[h or ""] != p else None
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def run(spark, pages, parts=3, **how):
    df = spark.createDataFrame([(p, u, h, "x") for p, u, h in pages], "page_id long, url string, html string, digest string").repartition(parts)
    return sorted((tuple(r) for r in warc.read_archives(warc.write_archives(df, **how)).collect()), key=str)


def test_round_trip(spark):
    assert run(spark, PAGES) == want(PAGES, 0)
    assert run(spark, PAGES, 1, least_bytes=20) == want(PAGES, 20)


def test_repeated_rows_and_no_pages(spark):
    got = run(spark, [(1, "a", "same"), (1, "a", "same"), (2, "b", "same")])
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert run(spark, []) == []


def test_files_carry_their_dictionary():
    records = [warc.make_record(i, f"http://h/{i}", (f"<html>{i}" + "words of a page " * 40).encode(), "D", None, False, "2024-01-01T00:00:00Z") for i in range(50)]
    raw = b"".join(warc.encode_file(records))
    magic, size = struct.unpack_from("<II", raw)
    assert magic == 0x184D2A5D and size > 0
    assert [b for _, b in warc.read_file(raw)] == [warc.parse_record(r)[1] for r in records]
    words = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    at = raw.rindex(b"\x28\xb5\x2f\xfd")  # the last record's frame alone, by its offset
    assert zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(raw[at:]) == records[-1]
    assert len(raw) < sum(map(len, records)) // 5


def test_any_record_by_its_number(tmp_path):
    records = [warc.make_record(i, None, bytes([65 + i % 26]) * (i * 37 % 5000), "D", None, False, "2024-01-01T00:00:00Z") for i in range(200)]
    (tmp_path / "a.warc.zst").write_bytes(b"".join(warc.encode_file(records)))
    held = warc.StoredArchive(f"file://{tmp_path}/a.warc.zst")
    assert len(held) == 200 and all(held[k] == warc.parse_record(records[k]) for k in (199, 0, 73))


def test_a_plain_reader_skips_both_frames(tmp_path):
    """A reader that knows frames, a dictionary and WARC headers, and nothing of the writer."""
    records = [warc.make_record(i, f"http://h/{i}", b"x" * 50 * i, "D", None, False, "2024-01-01T00:00:00Z") for i in range(30)]
    raw = b"".join(warc.encode_file(records))
    size = struct.unpack_from("<I", raw, 4)[0]
    words = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    stream = zstandard.ZstdDecompressor(dict_data=words).stream_reader(raw, read_across_frames=True)
    plain, at, seen = stream.read(), 0, []
    while at < len(plain):
        assert plain.startswith(b"WARC/1.1\r\n", at)
        end = plain.index(b"\r\n\r\n", at)
        fields = dict(x.split(b": ", 1) for x in plain[at:end].split(b"\r\n")[1:])
        at = end + 4 + int(fields[b"Content-Length"]) + 4
        seen.append(fields[b"X-Page-Id"])
    assert seen == [str(i).encode() for i in range(30)]


def test_reading_takes_linear_time():
    import random
    import time

    draw, took = random.Random(1), {}
    for n in (2_000, 16_000):
        raw = b"".join(warc.encode_file([warc.make_record(i, None, draw.randbytes(1000), "D", None, False, "2024-01-01T00:00:00Z") for i in range(n)]))
        began = time.process_time()
        assert sum(1 for _ in warc.read_file(raw)) == n
        took[n] = time.process_time() - began
    assert took[16_000] < 16 * took[2_000] + 0.5


def test_ids_are_of_one_record(spark):
    pages = [(1, "a", "one"), (1, "a", "two"), (1, "b", "one"), (None, "c", "x"), (None, "d", "x"), (None, "c", "y"), (4, "e", "one"), (5, "f", "y")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    found = [fields for r in warc.write_archives(df).collect() for fields, _ in warc.read_file(warc.load(r.path))]
    ids = {f["WARC-Record-ID"]: f for f in found}
    assert len(ids) == len(found) == 8
    for f in found:
        if f["WARC-Type"] == "revisit":
            response = ids[f["WARC-Refers-To"]]
            assert response["WARC-Type"] == "response" and response["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and response["X-Page-Id"] == f["X-Refers-To-Page-Id"]


def test_a_very_long_page(spark):
    pages = [(1, "a", "é" * 3_000_000), (2, "b", "é" * 3_000_000), (3, "c", "short")]
    assert run(spark, pages) == want(pages, 0)
