"""WARC archives of pages, compressed record by record against a dictionary that each file carries.

A file begins with a skippable Zstandard frame that holds a dictionary built from records of that file; every record
follows as a frame of its own, and a last skippable frame holds the offsets of all of them. So a record is read by its
number with the ends of the file and its own bytes (``StoredArchive``), and a reader that knows of none of this skips
both frames. A page whose payload an earlier page has is written as a revisit of that page. Records have ids of their
own; only rows alike in page, url and payload are copies of one record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.llm.joins import join_dealt, join_sized
from narrascope.llm.tokenfile import load, store

DICTIONARY_FRAME, INDEX_FRAME = 0x184D2A5D, 0x184D2A5E
#: Bytes that a reader hands on at a time where a file has no index.
STEP = 1 << 14
#: Bytes of payload after which a file is closed, bytes of records spread over it that the dictionary is built from, and its size.
FILE_BYTES = 64 << 20
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 96 << 10
NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page} {digest} {url!r}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value keeps to its line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def make_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, has_reference: bool, date: str, refers_url: str | None = None) -> bytes:
    """A record; ``refers_to`` and ``refers_url`` are those of the response with the same payload, if it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if has_reference else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if has_reference else 'response'}", f"WARC-Record-ID: {record_id(page, url, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"X-Page-Id: {'' if page is None else page}"]
    if has_reference:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}", f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    return fields, rest[:size]


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES):
    """Trained where there are enough records, else their first bytes as they are."""
    import zstandard

    try:
        if len(samples) >= 8:
            return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples)
    except zstandard.ZstdError:
        pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def encode_file(records: list[bytes], level: int = 3) -> list[bytes]:
    import zstandard

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    words = build_dictionary(records[::step])
    own = words.as_bytes()
    press = zstandard.ZstdCompressor(level=level, dict_data=words)
    frames = [press.compress(x) for x in records]
    offsets = [8 + len(own)]
    for x in frames:
        offsets.append(offsets[-1] + len(x))
    index = struct.pack(f"<{len(offsets)}QQ", *offsets, len(offsets))
    return [struct.pack("<II", DICTIONARY_FRAME, len(own)), own, *frames, struct.pack("<II", INDEX_FRAME, len(index)), index]


def _dictionary(head: bytes) -> int:
    """Bytes of the dictionary that a file begins with."""
    magic, size = struct.unpack_from("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the file has no dictionary frame")
    return size


def read_file(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file, in order: one frame after another, skippable ones passed over. Time grows with the file."""
    import zstandard

    size = _dictionary(raw)
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    at, view = 8 + size, memoryview(raw)
    while at < len(raw):
        magic = struct.unpack_from("<I", raw, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", raw, at + 4)[0]
            continue
        one, parts = plain.decompressobj(), []
        while not one.eof:  # what is left over is at most one step, and is handed on again
            if at >= len(raw):
                raise ValueError("the last frame is cut short")
            parts.append(one.decompress(view[at : at + STEP]))
            at = min(at + STEP, len(raw))
        at -= len(one.unused_data)
        yield parse_record(b"".join(parts))


class StoredArchive:
    """Any record of a stored file by its number: the ends of the file are read once, then the record's bytes alone."""

    def __init__(self, uri: str):
        import zstandard
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = _dictionary(self._bytes(0, 8))
        self.plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(self._bytes(8, size)))
        end = self.file.size()
        n = struct.unpack("<Q", self._bytes(end - 8, 8))[0]
        if struct.unpack("<II", self._bytes(end - 16 - 8 * n, 8)) != (INDEX_FRAME, 8 * n + 8):
            raise ValueError("the file has no index frame")
        self.offsets = struct.unpack(f"<{n}Q", self._bytes(end - 8 - 8 * n, 8 * n))

    def _bytes(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, k: int) -> tuple[dict[str, str], bytes]:
        if not 0 <= k < len(self):
            raise IndexError(k)
        frame = self._bytes(self.offsets[k], self.offsets[k + 1] - self.offsets[k])
        return parse_record(self.plain.decompressobj().decompress(frame))


FILES = "path string, n_records long"


def write_archives(pages: DataFrame, *, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write every page as a record; one row a file: path, n_records.

    Of pages with equal payloads of at least ``least_bytes`` the one with the smallest page_id is a response and the
    others revisit it; smaller payloads are all responses. Null html is an empty payload, a null page_id counts as
    the smallest, and rows that repeat a page_id and its payload are all written as that page is. A payload of any
    length is one record, held whole. Other columns are ignored, whatever their names; an empty table has no files. A
    repeated task writes new files; only those of the attempt that ended are listed.
    """
    spark = pages.sparkSession
    runtime.prepare(spark)
    folder = runtime.fresh_path(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page"), F.col("url").cast("string").alias("url"), html.alias("html"))
    base = base.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("size", F.octet_length("html").cast("long"))
    facts = runtime.staged(base.select("page", "url", "digest", "size"), "digests")
    first = facts.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min(F.struct("page", "url")).alias("_first"), F.count("*").alias("n")).where("n > 1")
    heads = first.select("digest", "size", F.col("_first.page").alias("refers_to"), F.col("_first.url").alias("refers_url"))
    # one payload, such as the empty one, may be that of a large part of all pages
    later = join_dealt(facts, runtime.staged(heads, "repeated-payloads"), ["digest", "size"], "page")
    later = runtime.staged(later.where("page != refers_to").select("page", "digest", "refers_to", "refers_url").distinct(), "revisits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            store(path, encode_file(records, level))
            row = pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([len(records)], pa.int64())})
            records.clear()
            return row

        for batch in batches:
            for page, url, text, refers, at in zip(*(batch.column(k) for k in range(5))):
                page, refers = page.as_py(), refers.as_py()
                payload = text.as_buffer().to_pybytes()
                known = lambda x: None if x == NO_ID else x
                records.append(make_record(known(page), url.as_py(), payload, base32_sha1(payload), known(refers), refers is not None, date, at.as_py()))
                held += len(payload)
                if held >= FILE_BYTES:
                    yield flush()
                    held = 0
        if records:
            yield flush()

    joined = join_sized(base, later, ["page", "digest"], "left")
    return runtime.staged(joined.select("page", "url", "html", "refers_to", "refers_url").mapInArrow(write, FILES), "archives")


ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(files: DataFrame) -> DataFrame:
    """One row a record, from the archives: length and digest of the whole payload (checked where it is there)."""
    runtime.prepare(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for fields, block in read_file(load(path)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.decode().rpartition("Content-Length: ")[2])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"{path}: payload of {fields['X-Page-Id']} differs from its header")
                    number = lambda x: int(x) if x else None
                    rows.append((number(fields["X-Page-Id"]), size, digest, fields["WARC-Type"], number(fields.get("X-Refers-To-Page-Id"))))
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split(" ")[0] for x in ROW.split(", ")])

    wide = max(1, min(10_000, files.count()))
    return files.select("path").repartition(wide).mapInArrow(read, ROW)
