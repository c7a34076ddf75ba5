"""At which points a document is included, held against the gates of one point after another."""

import datetime as dt
import random

from narrascope.operators import cleaning, panel_run


def test_spans_are_the_outcomes_of_each_point(spark):
    draw = random.Random(6)
    start = dt.date(2024, 1, 1)
    texts = ["one story", "another  story", "a third story", None, "one story\n"]
    rows = []
    for k in range(120):
        day = None if k % 17 == 0 else start + dt.timedelta(days=draw.randrange(140))
        text = texts[draw.randrange(5)] if k % 3 else f"text {k}"
        rows.append((f"d{k:03d}", draw.randrange(60), "news" if k % 19 else " ", f"s{k}", day, f"f{k}.txt", text))
    raw = spark.createDataFrame(rows, "document_id string, row_number int, source string, source_id string, available_at date, raw_path string, raw_text string").repartition(3)
    points = [str(start + dt.timedelta(days=d)) for d in (90, 10, 45, 130, 11)]
    _, spans = panel_run.outcomes(raw, points)
    got = {(str(r.since), None if r.until is None else str(r.until), r.document_id) for r in spans.collect()}
    for p in points:
        alone = {r.document_id for r in cleaning.clean_documents(raw, p).where("outcome = 'included'").select("document_id").collect()}
        assert {d for since, until, d in got if since <= p and (until is None or p < until)} == alone, p
    assert len({d for _, _, d in got}) == len(got)
