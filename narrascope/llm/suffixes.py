"""Removal of repeated passages by sparse suffix sorting with bucket-pointer refinement.

A byte goes if some ``length``-byte string that covers it also starts earlier in the corpus. Sorting all suffixes
would move every byte many times over, so it is done in three rounds, each on what the round before left open:

1. Every window of ``length`` bytes is named by an anchor, the least hashed q-gram in it; windows with one anchor
   form a run. Equal windows have equal anchors, so the q-gram buckets of the anchors hold all repeats. A run whose
   text repeats an earlier run is settled here, as is a run alone in its bucket.
2. Runs that share an anchor but not the whole text (the rims of repeats, chance q-grams) are refined: the bucket is
   split by the q-grams beside the anchor, and inside each bucket the suffixes are sorted by the bucket identifiers
   at later offsets, 32 to 64 to ``length`` bytes deep; each round uses the identifiers that the last one wrote.
3. Covered stretches are merged by document and cut out.

Order is by (doc_id, start), a null id first; rows with one id and one text count as one document, and texts of one
id as documents of their own, in order of their digests. Equal runs of a batch of rows leave it as one, so a passage
that a large part of the corpus holds sends few rows to the task of its anchor. Buckets of over ``HOT_BUCKET``
different runs go to no single task: their windows are settled one by one, by a hash aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.llm.anchors import find_runs
from narrascope.llm.bytescan import U64, Hasher, chunks, text_bytes
from narrascope.llm.joins import join_sized

Q = 32
NO_ID = -(1 << 63)
HOT_BUCKET = 100_000
_N_BITS = 24  # of a packed place: bytes covered

RUN = "a long, s long, doc long, v long"
MARK = "a long, doc long, v long"
CONTEXT = "bucket long, doc long, v long, bytes binary"


def pack(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start (39 bits), covered bytes (24 bits), ordered by start."""
    return (start.astype(np.int64) << _N_BITS) | size.astype(np.int64)


def unpack(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return v >> _N_BITS, v & ((1 << _N_BITS) - 1)


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)


def scan_runs(length: int):
    """Runs of each text. Of equal runs of one batch only the first goes on; the others are covered already (s = 0)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            docs = batch.column(0).to_numpy()
            found = []
            for i, j in chunks(off):
                rel = off[i : j + 1] - off[i]
                if rel[-1] < length:
                    continue
                hasher = Hasher(raw[off[i] : off[j]])
                runs, anchor = find_runs(hasher, rel, Q, length)
                size = runs.n + length - 1
                body = hasher.ranges(runs.start, runs.start + size) | U64(1)
                place = pack(runs.start - rel[runs.text], size)
                found.append((anchor, body, docs[i:j][runs.text], place))
            if not found:
                continue
            a, s, doc, v = (np.concatenate(x) for x in zip(*found))
            if np.any(docs[1:] <= docs[:-1]):
                order = np.lexsort((v, doc))
                a, s, doc, v = a[order], s[order], doc[order], v[order]
            _, first = np.unique(s, return_index=True)
            # a run of the same document and place is not earlier
            later = np.ones(len(s), bool)
            later[first] = False
            out_s = s.copy()
            out_s[later] = 0
            a[later] = doc[later].astype(np.uint64) * U64(0x9E3779B97F4A7C15)
            twin = np.zeros(len(s), bool)
            twin[1:] = later[1:] & (doc[1:] == doc[:-1]) & (v[1:] == v[:-1])
            keep = ~twin
            yield _batch(RUN, a[keep].view(np.int64), out_s[keep].view(np.int64), doc[keep], v[keep])

    return scan


def mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, s, doc, v). Out: covered runs (a = 0), and first runs of anchors with several texts."""
    last = None  # a, s, doc, v of the row before
    waiting = None  # the last first run: a, doc, v, and whether the one before it has its anchor
    for batch in batches:
        a, s, doc, v = (batch.column(k).to_numpy() for k in range(4))
        local = s == 0
        out = [(np.zeros(int(local.sum()), np.int64), doc[local], v[local])]
        a, s, doc, v = a[~local], s[~local], doc[~local], v[~local]
        if len(a):
            before = [np.concatenate(([0 if last is None else last[k]], x[:-1])) for k, x in enumerate((a, s, doc, v))]
            fresh = (a != before[0]) | (s != before[1])
            if last is None:
                fresh[0] = True
            same = ~fresh & (doc == before[2]) & (v == before[3])
            last = a[-1], s[-1], doc[-1], v[-1]
            gone = ~fresh & ~same
            out.append((np.zeros(int(gone.sum()), np.int64), doc[gone], v[gone]))
            fa, fd, fv = a[fresh], doc[fresh], v[fresh]
            if len(fa):
                had = np.zeros(len(fa), bool)
                had[1:] = fa[1:] == fa[:-1]
                if waiting is not None:
                    had[0] = fa[0] == waiting[0]
                    if waiting[3] or had[0]:
                        out.append(tuple(np.array([x], np.int64) for x in waiting[:3]))
                more = np.append(fa[1:] == fa[:-1], False)
                pick = had | more
                pick[-1] = False
                waiting = fa[-1], fd[-1], fv[-1], bool(had[-1])
                out.append((fa[pick], fd[pick], fv[pick]))
        yield _batch(MARK, *(np.concatenate(x) for x in zip(*out)))
    if waiting is not None and waiting[3]:
        yield _batch(MARK, *(np.array([x], np.int64) for x in waiting[:3]))


def cut_contexts(length: int):
    """The bytes of open runs, in two parts by the side on which a window leaves the anchor: each part has a core of
    half the window besides the q-gram, and the core names its bucket."""
    side = (length - Q) // 2  # bytes beside the anchor that all windows of a part hold

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, rel, hasher, text, start, size in _asked(batch):
                data = hasher.data
                lo = start + rel[text]
                n = size - length + 1
                grams = hasher.windows(Q)
                span = length - Q + 1
                anchor = np.empty(len(lo), np.int64)
                for k in range(0, len(lo), 4096):  # the leftmost least q-gram of the first window
                    some = lo[k : k + 4096]
                    anchor[k : k + 4096] = some + np.argmin(grams[some[:, None] + np.arange(span)] & ~U64((1 << 24) - 1), axis=1)
                ids = docs[text]
                first, last = lo, lo + n - 1
                turn = anchor - side
                out = []
                for left in (True, False):
                    a = first if left else np.maximum(first, turn + 1)
                    b = np.minimum(last, turn) if left else last
                    some = np.flatnonzero(a <= b)
                    if not len(some):
                        continue
                    core = anchor[some] - side if left else anchor[some]
                    bucket = hasher.ranges(core, core + Q + side) ^ U64(0x5555 if left else 0)
                    beg, end = a[some], b[some] + length
                    cover = end - beg
                    joined = np.concatenate(([0], np.cumsum(cover)))
                    flat = data[np.repeat(beg - joined[:-1], cover) + np.arange(joined[-1])]
                    binary = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(joined.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                    place = pack(beg - rel[text[some]], cover)
                    out.append(_batch(CONTEXT, bucket.view(np.int64), ids[some], place, binary))
                yield from out

    return cut


def refine_buckets(q_ids: np.ndarray, live: np.ndarray, q: int, depth: int) -> np.ndarray:
    """Bucket identifiers of the suffixes ``live`` at ``depth`` bytes, from the identifiers of all positions at q bytes.

    A round sorts pairs (own bucket, bucket ``step`` later) and writes new identifiers, which the next round reads.
    A bucket of one suffix is done and is not sorted again.
    """
    ids, have = q_ids.astype(np.int64), q
    while have < depth:
        step = min(have, depth - have)
        at = np.arange(len(ids) - step) if have + step < depth else live
        size = np.bincount(ids, minlength=1)
        fresh = np.zeros(len(ids), np.int64)
        several = at[size[ids[at]] > 1]
        alone = at[size[ids[at]] == 1]
        pair = (ids[several].astype(np.uint64) << U64(32)) | ids[several + step].astype(np.uint64)
        _, number = np.unique(pair, return_inverse=True)
        top = int(number.max()) + 1 if len(number) else 0
        fresh[several] = number
        fresh[alone] = top + np.arange(len(alone))
        if have + step < depth:
            fresh[len(ids) - step :] = top + len(alone)
        ids, have = fresh, have + step
    return ids[live]


def refine_contexts(length: int):
    """Covered stretches of windows that are not the first of their text. Rows come sorted by (bucket, doc, v).

    Of the bucket that a batch ends in, the hashes of the windows seen go on to the next batch.
    """

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, seen = None, np.zeros(0, np.uint64)
        for batch in batches:
            bucket, doc, place = (batch.column(k).to_numpy() for k in range(3))
            if not len(bucket):
                continue
            differs = bucket[1:] != bucket[:-1]
            alone = np.append(True, differs) & np.append(differs, False)
            alone[0] &= carry is None or bucket[0] != carry
            pick = np.flatnonzero(~alone)
            if not len(pick):
                continue
            data, rel = text_bytes(batch.column(3).take(pa.array(pick)))
            b, d, place = bucket[pick], doc[pick], place[pick]
            data, rel = data[rel[0] : rel[-1]], rel - rel[0]
            n = np.diff(rel) - length + 1
            row = np.repeat(np.arange(len(pick)), n)
            live = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + rel[:-1][row]
            hasher = Hasher(data)
            _, q_ids = np.unique(hasher.windows(Q), return_inverse=True)
            grams = refine_buckets(q_ids, live, Q, length)
            # rows of a bucket are in order of (doc, v), and equal windows share their bucket
            _, first, number = np.unique(grams, return_index=True, return_inverse=True)
            start, _ = unpack(place)
            where = start[row] + live - rel[:-1][row]
            head = first[number]
            later = (d[row] != d[row[head]]) | (where != where[head])
            ends = b[row] == b[-1]
            windows = np.unique(hasher.ranges(live[ends], live[ends] + length))
            if carry is not None and b[0] == carry:
                own = np.flatnonzero(b[row] == carry)
                later[own[np.isin(hasher.ranges(live[own], live[own] + length), seen)]] = True
                seen = np.union1d(seen, windows) if b[-1] == carry else windows
            else:
                seen = windows
            carry = b[-1]
            gone = np.flatnonzero(later)
            if len(gone):
                cut = np.flatnonzero((np.diff(gone) != 1) | (np.diff(row[gone]) != 0))
                lo, hi = gone[np.concatenate(([0], cut + 1))], gone[np.concatenate((cut, [len(gone) - 1]))]
                yield _batch("doc long, v long", d[row[lo]], pack(where[lo], where[hi] - where[lo] + length))

    return refine


def explode_windows(length: int):
    """One row for each window of the runs asked for: its hash and place."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rel, hasher, text, start, size in _asked(batch):
                n = size - length + 1
                row = np.repeat(np.arange(len(n)), n)
                where = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                lo = where + rel[text[row]]
                yield _batch("g long, doc long, v long", hasher.ranges(lo, lo + length).view(np.int64), ids[text[row]], pack(where, np.full(len(row), length)))

    return explode


def _asked(batch: pa.RecordBatch):
    """By chunk: document ids, offsets, hasher, and text, start and size of each run asked for in column 2."""
    raw, off = text_bytes(batch.column(1))
    docs, wanted = batch.column(0).to_numpy(), batch.column(2)
    values = wanted.flatten().to_numpy(zero_copy_only=False)
    counts = wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    reach = np.concatenate(([0], np.cumsum(counts)))
    for i, j in chunks(off):
        rel = off[i : j + 1] - off[i]
        hasher = Hasher(raw[off[i] : off[j]])
        text = np.repeat(np.arange(j - i), counts[i:j])
        start, size = unpack(values[reach[i] : reach[j]])
        if len(start):
            yield docs[i:j], rel, hasher, text, start, size


def merge_spans(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of stretches: starts and ends of the maximal ones; stretches that touch are one."""
    order = np.argsort(start, kind="stable")
    lo, hi = start[order], np.maximum.accumulate((start + size)[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    return lo[new], np.append(hi[:-1][new[1:]], hi[-1])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for places in batch.column(1):
            lo, hi = merge_spans(*unpack(places.values.to_numpy()))
            out.append(np.stack((lo, hi), axis=1).ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc", "spans"])


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a number that rows of one id and one text share and no others, in order of the ids (null first).

    It is the id itself, unless some id has several texts: then the place among all (id, digest of the text).
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashes = docs.select(doc.alias("doc"), F.xxhash64(text).alias("h")).groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    if not hashes.where("a != b").limit(1).count():
        return docs.withColumn(key, doc)
    said, own = _free(docs, "_said"), _free(docs, "_own")
    names = docs.select(doc.alias(own), F.sha2(text, 256).alias(said)).distinct().repartitionByRange(own, said).sortWithinPartitions(own, said)
    names = runtime.staged(names.withColumn(key, F.monotonically_increasing_id()), "row-keys")  # ranges of ids lie in order of their partitions
    return join_sized(docs.withColumn(own, doc).withColumn(said, F.sha2(text, 256)), names, [own, said]).drop(own, said)


def repeated_spans(texts: DataFrame, length: int = 100) -> DataFrame:
    """Staged (doc, spans) of texts (doc, text), a number and a text: starts and ends of the covered bytes, in turn."""
    spark = texts.sparkSession
    runtime.prepare(spark)
    runs = texts.mapInArrow(scan_runs(length), RUN).repartition("a").sortWithinPartitions("a", "s", "doc", "v")
    marks = runtime.staged(runs.mapInArrow(mark_runs, MARK), "marks")
    opened = marks.where("a != 0")
    crowded = runtime.staged(opened.groupBy("a").count().where(F.col("count") > HOT_BUCKET).select("a"), "crowded")  # a row for each HOT_BUCKET runs at most
    crowd = crowded.count() > 0
    cold = join_sized(opened, crowded, "a", "left_anti") if crowd else opened
    wanted = runtime.staged(cold.groupBy("doc").agg(F.collect_list("v").alias("wanted")), "open-runs")
    cut = join_sized(texts, wanted, "doc").select("doc", "text", "wanted").mapInArrow(cut_contexts(length), CONTEXT)
    contexts = cut.repartition("bucket").sortWithinPartitions("bucket", "doc", "v")
    refined = contexts.mapInArrow(refine_contexts(length), "doc long, v long")
    if crowd:  # buckets that no one task should hold: by the hash of each window
        hot = runtime.staged(join_sized(opened, crowded, "a", "left_semi").groupBy("doc").agg(F.collect_list("v").alias("wanted")), "crowded-runs")
        windows = runtime.staged(join_sized(texts, hot, "doc").select("doc", "text", "wanted").mapInArrow(explode_windows(length), "g long, doc long, v long"), "windows")
        heads = windows.groupBy("g").agg(F.min(F.struct("doc", "v")).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
        refined = refined.unionByName(windows.join(heads, "g").where("head.doc != doc or head.v != v").select("doc", "v"))
    covered = marks.where("a = 0").select("doc", "v").unionByName(refined)
    return runtime.staged(covered.groupBy("doc").agg(F.collect_list("v").alias("places")).mapInArrow(_merged, "doc long, spans array<long>"), "spans")


def _spans_of(spans: pa.Scalar) -> list[tuple[int, int]]:
    flat = spans.as_py() or []
    return list(zip(flat[::2], flat[1::2]))


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal_report(docs: DataFrame, length: int = 100) -> DataFrame:
    """One row a document: bytes, bytes removed, maximal removed stretches, sha256 of the rest.

    A null text is empty; texts under ``length`` bytes lose nothing; an empty table gives no rows. Rows that repeat an
    id and its text are one document and lose the same; texts of one id are told apart by their digests. A null id
    comes first. Of equal stretches the first stays, however many there are. A text of any length is held whole by
    one task. Other columns are ignored, whatever their names.
    """
    texts = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc")
    spans = repeated_spans(texts.select("doc", "text"), length)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            size, removed, count, digest = [], [], [], []
            for k in range(batch.num_rows):
                data = memoryview(raw)[off[k] : off[k + 1]]
                gone = _spans_of(batch.column(2)[k])
                sha, at = hashlib.sha256(), 0
                for a, b in gone:
                    sha.update(data[at:a])
                    at = b
                sha.update(data[at:])
                size.append(len(data)), removed.append(sum(b - a for a, b in gone)), count.append(len(gone)), digest.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], [x.split(" ")[0] for x in REPORT.split(", ")])

    joined = join_sized(texts, spans, "doc", "left")
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(report, REPORT)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """All columns of ``docs``; repeated bytes are cut from ``text`` and ``n_chars`` is the length of what is left.

    A character of several bytes that only in part lies in a repeat stays whole. Null texts stay null. Ids and texts
    count as in ``removal_report``; columns of any other name pass through.
    """
    key, cuts = _free(docs, "_key"), _free(docs, "_spans")
    rows = keyed(docs, key)
    spans = repeated_spans(rows.select(F.col(key).alias("doc"), F.col("text").cast("string").alias("text")), length)
    hit = join_sized(rows, _renamed(_renamed(spans, "doc", key), "spans", cuts), key, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index("text"))
            raw, off = text_bytes(column)
            spans_of = batch.column(names.index(cuts))
            texts = []
            for k in range(batch.num_rows):
                stretches = _spans_of(spans_of[k])
                if not stretches:
                    texts.append(column[k].as_py())
                    continue
                data = raw[off[k] : off[k + 1]]
                keep = np.ones(len(data), bool)
                for a, b in stretches:
                    while a < b and 0x80 <= data[a] < 0xC0:
                        a += 1
                    while b > a and b < len(data) and 0x80 <= data[b] < 0xC0:
                        b -= 1
                    keep[a:b] = False
                texts.append(data[keep].tobytes().decode("utf-8"))
            out = [pa.array(texts, pa.string()) if n == "text" else batch.column(names.index(n)) for n in wanted]
            yield pa.RecordBatch.from_arrays(out, wanted)

    wanted = docs.columns
    out = hit.select(*wanted, cuts).mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in wanted else out


def _renamed(staged: DataFrame, old: str, new: str) -> DataFrame:
    out = staged.withColumnRenamed(old, new)
    out._narrascope_path = staged._narrascope_path
    return out
