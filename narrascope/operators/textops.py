"""Cleaning, chunking and scoring of text; columns wherever SQL can say it, Arrow functions where order inside a text matters."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope import runtime

#: Fixed values of the cleaning rules.
PAGE_PATTERNS = (r"^\s*[-—]?\s*\d+\s*[-—]?\s*$", r"(?i)^\s*page\s+\d+(\s+of\s+\d+)?\s*$", r"^\s*\d+\s*/\s*\d+\s*$")
TABLE_MARK, SECTION_MARK, MARK_END = "[[[TABLE_DATA:", "[[[SECTION_TITLE:", "]]]"
SGML_LINE = re.compile(r"^<(DOCUMENT|TYPE|SEQUENCE|FILENAME|DESCRIPTION|TEXT|/DOCUMENT|/TEXT)\b.*$\n?", re.I | re.M)
CHUNK_CHARS, OVERLAP_CHARS = 800, 100
HEADER_CHARS, HEADER_TIMES = 80, 3


def line_endings(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normal_whitespace(text: Column) -> Column:
    """Runs of spaces and tabs to one, none at the ends of lines, at most one blank line, none around the text."""
    text = F.regexp_replace(line_endings(text), "[ \t]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, " ?\n ?", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(text, "^[ \n]+|[ \n]+$", "")


def is_page_line(line: Column) -> Column:
    out = F.lit(False)
    for p in PAGE_PATTERNS:
        out = out | line.rlike(p)
    return out


def repeated_line_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Short lines that stand several times in one document: doc_id, line, n."""
    lines = docs.select("doc_id", F.explode(F.split(F.col(text), "\n")).alias("line")).withColumn("line", F.trim("line"))
    return lines.where((F.length("line") > 0) & (F.length("line") <= HEADER_CHARS)).groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= HEADER_TIMES)


def sentences(text: Column) -> Column:
    """Parts between sentence ends: white space after . ! ?, or a blank line."""
    cut = F.regexp_replace(F.regexp_replace(text, r"([.!?])\s+", "$1\u001f"), r"\n{2,}", "\u001f")
    return F.filter(F.split(cut, "\u001f"), lambda s: F.length(F.trim(s)) > 0)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_\-]", " ")), " "), lambda t: t != "")


def tone(docs: DataFrame, lexicon: DataFrame, categories: list[str]) -> DataFrame:
    """Hits of each lexicon category by token; the lexicon is a word list of fixed size.

    Tokens meet the lexicon where they are read, and one row a document is shuffled. Texts without a token have no row.
    """
    words = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("word")).join(F.broadcast(lexicon), "word", "left")
    scored = words.groupBy("doc_id").agg(F.count("*").alias("token_count"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in categories])
    return scored.select("doc_id", "token_count", *[F.round(F.col(c) / F.greatest("token_count", F.lit(1)), 6).alias(c) for c in categories])


def _sentence_spans(text: str) -> list[tuple[int, int]]:
    cuts = [m.end() for m in re.finditer(r"(?<=[.!?])\s+|\n{2,}", text)]
    ends = [*cuts, len(text)]
    return [(a, b) for a, b in zip([0, *ends[:-1]], ends) if b > a]


def pack_chunks(text: str, most: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, int]]:
    """Spans of whole sentences up to ``most`` characters; each begins with trailing sentences of the last under ``overlap``."""
    spans = _sentence_spans(text)
    out, i = [], 0
    while i < len(spans):
        j = i + 1
        while j < len(spans) and spans[j][1] - spans[i][0] <= most:
            j += 1
        if text[spans[i][0] : spans[j - 1][1]].strip():
            out.append((spans[i][0], spans[j - 1][1]))
        if j >= len(spans):
            break
        k = j
        while k - 1 > i and spans[j - 1][1] - spans[k - 1][0] < overlap:
            k -= 1
        i = k
    return out


def chunk_documents(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_index, start, end, text: sentence-packed chunks of each document."""
    runtime.ship(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, a, b, t[a:b]) for d, t in zip(batch["doc_id"], batch["text"]) if t for k, (a, b) in enumerate(pack_chunks(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start", "end", "text"])

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, chunk_index int, start int, end int, text string")


class _Page(HTMLParser):
    """Visible text of a page; headings and outermost tables become marked lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.mute = self.tables = 0
        self.heading: list[str] | None = None
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.mute += 1
        elif tag == "table":
            self.tables += 1
            if self.tables == 1:
                self.rows = []
        elif self.tables == 1 and tag == "tr":
            self.rows.append([])
        elif self.tables == 1 and tag in ("td", "th"):
            self.cell = []
        elif re.fullmatch("h[1-6]", tag) and not self.tables:
            self.heading = []
        elif tag in ("p", "div", "br", "li", "tr"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif tag == "table" and self.tables:
            self.tables -= 1
            if not self.tables and any(self.rows):
                self.out.append(f"\n{TABLE_MARK}{json.dumps({'rows': [r for r in self.rows if r]}, ensure_ascii=False)}{MARK_END}\n")
        elif self.tables == 1 and tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif re.fullmatch("h[1-6]", tag) and self.heading is not None:
            title = " ".join("".join(self.heading).split())
            if title:
                self.out.append(f"\n{SECTION_MARK}{title}{MARK_END}\n")
            self.heading = None

    def handle_data(self, data):
        if self.mute:
            return
        if self.tables:
            if self.cell is not None:
                self.cell.append(data)
        elif self.heading is not None:
            self.heading.append(data)
        else:
            self.out.append(data)


def page_text(source: str) -> str:
    """Visible text of markup; lines of an SGML wrapper go, white space is collapsed outside markers."""
    page = _Page()
    page.feed(SGML_LINE.sub("", source or ""))
    page.close()
    lines = [x.strip() if x.strip().startswith((TABLE_MARK, SECTION_MARK)) else " ".join(x.split()) for x in "".join(page.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_to_text(pages: DataFrame) -> DataFrame:
    runtime.ship(pages.sparkSession)

    @F.pandas_udf("string")
    def read(source: pd.Series) -> pd.Series:
        return source.map(lambda x: page_text(x) if x is not None else None)

    return pages.select("page_id", read("html").alias("text"))


#: Fixed values of the fusion: least share of a category that counts, and what is left of the confidence.
LEAST_SHARE, HEDGED_FACTOR, CONFLICT_FACTOR = 0.005, 0.75, 0.50


def fuse(rows: DataFrame) -> DataFrame:
    """Direction by the lexicon (largest share over the least; ties uncertainty, negative, positive) beside the extracted one.

    Adds lm_direction, agreement (agree, hedged, conflict), fused_tone and fused_confidence. Opposite directions are a
    conflict and count as negative; a mixed reading is hedged, so is one that the lexicon does not bear out.
    """
    top = F.greatest("uncertainty", "negative", "positive")
    lexicon = F.when(top <= LEAST_SHARE, "neutral").when(F.col("uncertainty") == top, "uncertainty").when(F.col("negative") == top, "negative").otherwise("positive")
    rows = rows.withColumn("lm_direction", lexicon)
    said, lm = F.col("direction"), F.col("lm_direction")
    up = F.when(lm == "negative", "conflict").when(lm == "positive", "agree").otherwise("hedged")
    down = F.when(lm == "positive", "conflict").when(lm == "neutral", "hedged").otherwise("agree")
    rows = rows.withColumn("agreement", F.when(said == "positive", up).when(said == "negative", down).when((said != "mixed") & (lm == "neutral"), "agree").otherwise("hedged"))
    agreement = F.col("agreement")
    tone_of = F.when(agreement == "conflict", "negative").when(agreement == "hedged", "hedged").when(said.isin("positive", "negative", "neutral"), said).otherwise("neutral")
    factor = F.when(agreement == "conflict", CONFLICT_FACTOR).when(agreement == "hedged", HEDGED_FACTOR).otherwise(1.0)
    return rows.withColumn("fused_tone", tone_of).withColumn("fused_confidence", F.round(F.col("confidence") * factor, 6))
