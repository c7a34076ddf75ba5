"""Personal data in texts: exact rules, and a character tagger (bidirectional LSTM with CRF) that adds what is written otherwise.

Rules find e-mail addresses, IPv4 addresses, payment cards and international phone numbers. A tagger is trained on the
driver from labelled spans: windows of a bounded sample of the documents with the rules' own spans, and the same windows
with spans put in that are written in ways the rules don't know (``name (at) host dot org``, ``10[.]1[.]2[.]3``, phone
numbers without a plus, cards with dots), beside numbers that are none of these (dates, versions, prices, digests).

Every whole text is cut into windows of ``WIDTH`` characters, each half over the next. A window without a digit, an at
sign or the word at holds nothing that could pass for a span (``holds``), so it is outside all through; the others are decoded.
Spans that a window's edge may have cut are left to the neighbour, which sees them whole up to ``WIDTH / 2`` characters;
of what all windows of a text propose, the set of spans without overlap that is surest in sum is kept. Spans of the rules
stay as they are, and proposals over them go.

Nulls: a null text is empty; null and repeated ids are rows like others. A text without spans, or an empty one, has counts
of 0 and empty lists. Places are code points. Texts of any length are searched whole, in time that grows with the length.
An empty table gives an empty table, and nothing is trained. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.llm.bilstm import PAD, Tagger, classes

KINDS = ("email", "ip", "card", "phone")
WIDTH = 128
#: Bounds of what is trained on: documents that are looked at, windows that come of them.
SAMPLE_ROWS, SAMPLE_WINDOWS = 4_000, 1_500
HIDDEN, STEPS, BATCH, RATE, SEED = 16, 500, 48, 0.02, 11
#: Least mean probability of a span's labels.
SURE = 0.9

Span = tuple[int, int, int]  # start, end, kind

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """At each at sign: the run of local characters before it that no span has taken, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at - _LOCAL.match(text[done:at][::-1]).end()
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = max(done, at + 1)  # an at sign is in no local part
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """What the rules find, by start, then kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m.group().split("."))):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group()) if m.end() - m.start() <= 37 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def said(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


# ---- what the tagger is trained on

_AT, _DOT = ("@", " @ ", "(at)", " (at) ", "[at]", " at "), (".", " . ", "(dot)", " (dot) ", "[dot]", " dot ")
_SEPARATE = {"card": ("", " ", "-", ".", "/", "  "), "phone": (" ", "-", ".", "/")}


def _digits(draw: np.random.Generator, n: int) -> str:
    return "".join(map(str, draw.integers(0, 10, n)))


def _card(draw: np.random.Generator) -> str:
    n = int(draw.choice([13, 15, 16, 16, 16, 16, 19]))
    digits = str(draw.integers(2, 7)) + _digits(draw, n - 2)
    digits += next(c for c in "0123456789" if luhn(digits + c))
    sep = str(draw.choice(_SEPARATE["card"]))
    return sep.join(digits[i : i + 4] for i in range(0, n, 4))


def _phone(draw: np.random.Generator) -> str:
    a, b, c, sep = _digits(draw, 3), _digits(draw, 3), _digits(draw, 4), str(draw.choice(_SEPARATE["phone"]))
    country = str(draw.integers(1, 99))
    forms = [f"+{country} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", sep.join([a, b, c]), sep.join(["+" + country, a, b, c]), sep.join(["00" + country, a, b, c]), sep.join([country, a, b, c]), f"tel:{a}-{b}-{c}"[4:]]
    return forms[draw.integers(len(forms))]


def _word(draw: np.random.Generator, words: list[str]) -> str:
    return re.sub(r"[^A-Za-z]", "", words[draw.integers(len(words))])[:12].lower() or "info"


def _email(draw: np.random.Generator, words: list[str]) -> str:
    k, name = int(draw.integers(len(_AT))), _word(draw, words)
    name += ["", _digits(draw, 2), "." + _word(draw, words), "_" + _word(draw, words)][draw.integers(4)]
    host = [_word(draw, words) + ["", _digits(draw, 1)][draw.integers(2)] for _ in range(int(draw.integers(1, 3)))]
    dot = _DOT[k] if draw.random() < 0.7 else "."
    return name + _AT[k] + dot.join([*host, str(draw.choice(["com", "org", "net", "de", "fr", "io"]))])


def _ip(draw: np.random.Generator) -> str:
    return str(draw.choice([".", ".", "[.]", " . ", "(.)"])).join(map(str, draw.integers(0, 256, 4)))


def _other(draw: np.random.Generator) -> str:
    """Numbers that are nobody's."""
    d = lambda n: _digits(draw, n)
    y, m, day = 1900 + int(draw.integers(0, 130)), 1 + int(draw.integers(0, 12)), 1 + int(draw.integers(0, 28))
    while luhn(card := str(draw.integers(1, 10)) + d(int(draw.integers(11, 18)))):
        pass
    forms = [f"{y}-{m:02}-{day:02}", f"{day}.{m}.{y}", f"{m}/{day}/{y}", str(y), f"{d(1)}.{d(1)}.{d(2)}", f"Version {d(1)}.{d(1)}", f"${draw.integers(1, 999)},{d(3)}.{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", card, d(int(draw.integers(1, 9))), hashlib.sha1(d(6).encode()).hexdigest(), f"{draw.integers(256, 999)}.{d(3)}.{d(2)}.{draw.integers(256, 999)}", f"{d(1)}.{d(int(draw.integers(2, 9)))}", f"{d(3)},{d(3)},{d(3)}", f"pp. {d(3)}-{d(3)}", f"{y}-{y + 1}", f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"@{_digits(draw, 2)}", "(a.1) 2-3 4"]
    return forms[draw.integers(len(forms))]


def variations(windows: list[tuple[str, list[Span]]], seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """The labelled windows, and for each two more with something put in at a word's border: a span in any writing, or a number that is none."""
    draw, out = np.random.default_rng(seed), []
    words = [w for text, _ in windows for w in text.split() if w.isalpha()] or ["info", "mail", "post"]
    for text, spans in windows:
        out.append((text, spans))
        for _ in range(2):
            borders = [m.end() for m in re.finditer(r"\s", text) if not any(a < m.end() < b for a, b, _ in spans)] or [0]
            at, kind = borders[draw.integers(len(borders))], int(draw.integers(0, 7))
            new = [lambda: _email(draw, words), lambda: _ip(draw), lambda: _card(draw), lambda: _phone(draw)][kind]() if kind < 4 else _other(draw)
            tail = [" ", ", ", ". ", "\n"][draw.integers(4)]
            n = len(new) + len(tail)
            moved = [(a, b, k) if b <= at else (a + n, b + n, k) for a, b, k in spans]
            out.append((text[:at] + new + tail + text[at:], [*moved, *([(at, at + len(new), kind)] if kind < 4 else [])]))
    return out


def encode(windows: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    """Classes and labels, (time, windows)."""
    x, y = np.full((WIDTH, len(windows)), PAD, np.uint8), np.zeros((WIDTH, len(windows)), np.int64)
    for i, (text, spans) in enumerate(windows):
        own = classes(text[:WIDTH])
        x[: len(own), i] = own
        for a, b, k in spans:
            y[a : min(b, WIDTH), i] = 2 + 2 * k
            y[a : a + 1, i] = 1 + 2 * k
    return x, y


def train(windows: list[tuple[str, list[Span]]], steps: int = STEPS, seed: int = SEED) -> Tagger:
    """A tagger from labelled windows of at most WIDTH characters (what is over is left out)."""
    x, y = encode(windows)
    tagger = Tagger.fresh(len(KINDS), HIDDEN, seed)
    tagger.fit(x, y, steps, BATCH, RATE, seed)
    return tagger


def _labelled(text: str) -> Iterator[tuple[str, list[Span]]]:
    """Windows of a text for training: one around its first rule span, one around its first other digit, its first."""
    spans = base_spans(text)
    taken = [x for a, b, _ in spans for x in (a, b)]
    digit = next((m.start() for m in _DIGIT.finditer(text) if bisect_right(taken, m.start()) % 2 == 0), None)
    for at in {0, *([spans[0][0]] if spans else []), *([digit] if digit is not None else [])}:
        a = max(0, at - WIDTH // 3)
        b = a + WIDTH * 3 // 4
        a = next((s for s, e, _ in spans if s < a < e), a)
        b = next((e for s, e, _ in spans if s < b < e), b)
        inside = [(s - a, e - a, k) for s, e, k in spans if a <= s and e <= b]
        once = [s for i, s in enumerate(inside) if not any(s[0] < t[1] and t[0] < s[1] for t in inside[:i])]
        yield text[a:b], once


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [w for t in batch.column(0).to_pylist() for w in _labelled(t or "")]
        flat = [[x for s in spans for x in s] for _, spans in found]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array(flat, pa.list_(pa.int32()))], ["window", "spans"])


def sample_windows(docs: DataFrame, rows: int = SAMPLE_ROWS, windows: int = SAMPLE_WINDOWS) -> list[tuple[str, list[Span]]]:
    """At most ``windows`` labelled windows out of at most some ``rows`` documents: those whose ids have the smallest digests, spans first."""
    key = F.xxhash64("doc_id")
    last = docs.select(key.alias("_key")).orderBy("_key").limit(rows).agg(F.max("_key")).first()[0]
    if last is None:
        return []
    picked = docs.where(key <= F.lit(last)).select("text").mapInArrow(_sample, "window string, spans array<int>")
    best = picked.distinct().orderBy(F.size("spans") == 0, F.xxhash64("window"), "window").limit(windows).collect()
    return [(r["window"], [tuple(r["spans"][i : i + 3]) for i in range(0, len(r["spans"]), 3)]) for r in best]


# ---- windows, and what they say together

#: What every span that ``holds`` lets pass has inside: a digit, an at sign or the word at.
_MARK = re.compile(r"@|\bat\b", re.I)
_ANY_DIGIT = re.compile(r"\d")
_EMAIL_LIKE = re.compile(r"[\w.%+-]+ {0,2}(?:@|[(\[] ?at ?[)\]]|\bat\b) {0,2}[\w-]+(?: {0,2}(?:\.|[(\[] ?dot ?[)\]]|\bdot\b) {0,2}[\w-]+)+", re.I)
_IP_LIKE = re.compile(r"\d{1,3}(?:[\[( ]{0,2}\.[\]) ]{0,2}\d{1,3}){3}")
_CARD_LIKE = re.compile(r"\d(?:[ ./-]{0,3}\d)+")
_PHONE_LIKE = re.compile(r"[+(]?\d(?:[ ()./-]{0,3}\d)+")


def holds(kind: int, text: str) -> bool:
    """What a span must be made of to pass for its kind, whoever found it."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == 0:
        return bool(_EMAIL_LIKE.fullmatch(text))
    if kind == 1:
        return bool(_IP_LIKE.fullmatch(text)) and all(int(x) <= 255 for x in re.findall(r"\d+", text))
    if kind == 2:
        return bool(_CARD_LIKE.fullmatch(text)) and 12 <= len(digits) <= 19 and luhn(digits)
    return bool(_PHONE_LIKE.fullmatch(text)) and 9 <= len(digits) <= 15


def _starts(text: str) -> list[int]:
    """Windows by their start, without those that have nothing inside that a span of any kind must have."""
    half, hit = WIDTH // 2, set()
    at = 0
    while m := _ANY_DIGIT.search(text, at):  # one digit of each half window is enough
        hit.add(m.start() // half)
        at = (m.start() // half + 1) * half
    for m in _MARK.finditer(text):
        hit.update((m.start() // half, (m.end() - 1) // half))
    return sorted({s * half for h in hit for s in (h - 1, h) if s >= 0})


def surest(spans: dict[Span, float]) -> list[Span]:
    """The spans without overlap whose probabilities have the largest sum; of equals the earlier ending."""
    order = sorted(spans, key=lambda s: (s[1], s[0], s[2]))
    ends, best, take = [s[1] for s in order], [0.0], []
    for i, s in enumerate(order):
        free = bisect_right(ends, s[0], 0, i)
        with_it = best[free] + spans[s]
        take.append((with_it > best[i] + 1e-12, free))
        best.append(max(best[i], with_it))
    out, i = [], len(order)
    while i:
        taken, free = take[i - 1]
        if taken:
            out.append(order[i - 1])
        i = free if taken else i - 1
    return out[::-1]


def proposals(tagger: Tagger, texts: list[str], at_once: int = 512) -> list[dict[Span, float]]:
    """For each text the spans that its windows propose, with the most that a window gives each."""
    places = [(i, s) for i, text in enumerate(texts) for s in _starts(text)]
    out: list[dict[Span, float]] = [{} for _ in texts]
    for k in range(0, len(places), at_once):
        part = places[k : k + at_once]
        x = np.full((WIDTH, len(part)), PAD, np.uint8)
        for j, (i, s) in enumerate(part):
            own = classes(texts[i][s : s + WIDTH])
            x[: len(own), j] = own
        path, sure = tagger.decode(x)
        for j in np.flatnonzero(path.any(axis=0)).tolist():
            i, s = part[j]
            text, labels = texts[i], path[:, j].tolist()
            t = 0
            while t < WIDTH:
                a, kind = t, (labels[t] - 1) // 2
                t += 1
                if not labels[a]:
                    continue
                while t < WIDTH and labels[t] == 2 + 2 * kind:
                    t += 1
                cut = a == 0 and s > 0 or t == WIDTH and s + WIDTH < len(text)
                p = float(sure[a:t, j].mean())
                if not cut and s + t <= len(text) and p >= SURE and holds(kind, text[s + a : s + t]):
                    span = (s + a, s + t, kind)
                    out[i][span] = max(p, out[i].get(span, 0.0))
    return out


def find_all(tagger: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text what the rules find, and what the tagger adds to it."""
    base = [base_spans(t) for t in texts]
    added = []
    for spans, more in zip(base, proposals(tagger, texts) if tagger else [{}] * len(texts)):
        ordered = sorted(spans)
        ends = np.maximum.accumulate([0, *[b for _, b, _ in ordered]]).tolist()  # furthest end so far
        starts = [a for a, _, _ in ordered]
        free = {s: p for s, p in more.items() if ends[bisect_right(starts, s[1] - 1)] <= s[0]}
        added.append(surest(free))
    return list(zip(base, added))


def trained_on(docs: DataFrame) -> Tagger | None:
    """A tagger for these documents, from a bounded sample of them; None without documents."""
    windows = sample_windows(docs)
    return train(variations(windows)) if windows else None


def _slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some ``most`` bytes of text each, so that memory doesn't follow the session's batches."""
    start, held = 0, 0
    for i, text in enumerate(batch.column(1)):
        size = text.as_buffer().size if text.is_valid else 0
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


FOUND = "array<struct<kind:string,start:int,stop:int,by_rule:boolean>>"


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id and found: all spans of the text by start, with kind, places and whether a rule found it."""
    runtime.ship(docs.sparkSession)
    tagger = tagger or trained_on(docs)
    held = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = docs.schema["doc_id"].dataType

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("by_rule", pa.bool_())]))
        for whole in batches:
            for batch in _slices(whole):
                found = find_all(held.value, [t or "" for t in batch.column(1).to_pylist()])
                rows = [[{"kind": KINDS[k], "start": a, "stop": b, "by_rule": rule} for (a, b, k), rule in sorted([(s, True) for s in base] + [(s, False) for s in more], key=lambda x: (x[0][0], x[0][2]))] for base, more in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, spans_type)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind.simpleString()}, found {FOUND}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, rule spans by kind and their digest, and all spans as text, of what ``personal_data`` returns."""
    rules = F.filter("found", lambda s: s["by_rule"])

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["by_rule"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(rules), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(text: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """The text with spans (start, end, kind) replaced by ``[kind]``; spans that overlap become one, named by the first."""
    out, done = [], 0
    for a, b, kind in sorted(spans):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])
