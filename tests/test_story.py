"""Extraction, sentiment, cleaning, graph and panel operators on small fixtures, by brute force where there is no SQL."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from narrascope.operators import cleaning, exposure, extraction, governance, impacts, lineage, market, narration, reads, sentiment, signals, textops, validation
from narrascope.sources import config, readers, sinks


def day(text):
    return dt.date.fromisoformat(text)


def brute_sentiment(text):
    up, down = re.compile(sentiment.POSITIVE, re.I), re.compile(sentiment.NEGATIVE, re.I)
    negation = re.compile(sentiment.NEGATION)

    def negated(at):
        return any(negation.match(t) for t in text[:at].split()[-5:])

    pos = sum(not negated(m.start()) for m in up.finditer(text)) + sum(negated(m.start()) for m in down.finditer(text))
    neg = sum(negated(m.start()) for m in up.finditer(text)) + sum(not negated(m.start()) for m in down.finditer(text))
    direction = "positive" if pos > neg else "negative" if neg > pos else "mixed" if pos else "neutral"
    total = pos + neg
    level = "high" if total >= 4 else "moderate" if total >= 2 else "low"
    glad, wary, gloomy = (bool(re.search(p, text)) for p in (sentiment.OPTIMISTIC, sentiment.CAUTIOUS, sentiment.GLOOMY))
    stance = "negative" if gloomy and not glad else "cautious" if wary and not glad else "optimistic" if glad and not wary and not gloomy else "neutral"
    return direction, level, bool(re.search(sentiment.HEDGE, text)), stance, round(min(0.6 + 0.05 * total, 0.9) if total else 0.5, 9)


def test_sentiment_matches_brute_force(spark):
    r = random.Random(5)
    words = "We do not see strong demand, growth is robust (record) never weaker but challenging headwinds can't hurt well-positioned non-growing year-strong-growth no, risks below expectation ahead of plan may x y z the isn't Not".split(" ")
    texts = ["", "  ", "strong", "We do NOT see strong demand", "not a b c d strong", "not a b c d e strong", "no\nstrong  weaker"] + [" ".join(r.choice(words) for _ in range(r.randint(1, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "id int, text string")
    got = {x.id: (x.direction, x.confidence_tone, x.hedging, x.forward_stance, round(x.confidence, 9)) for x in sentiment.score_sentiment(df).collect()}
    assert got == {k: brute_sentiment(t) for k, t in enumerate(texts)} | {999: brute_sentiment("")}


def test_sentiment_run(spark):
    rows = [("a", day("2024-01-01"), "Cameco reports strong growth", None), ("b", day("2024-01-01"), "Cameco weaker", "analyst"), ("c", None, "Cameco weaker", None), ("d", day("2025-01-01"), "Cameco weaker", None), ("e", day("2024-01-01"), "nobody is strong", None), ("f", day("2024-02-01"), "rbc is not strong", "management")]
    got = sentiment.run_sentiment(spark.createDataFrame(rows, "chunk_id string, available_at date, text string, speaker_role string"), "2024-06-30")
    assert {(x.chunk_id, x.company, x.direction) for x in got.collect()} == {("a", "Cameco", "positive"), ("f", "Royal Bank of Canada", "negative")}
    tone = spark.createDataFrame([("a", day("2024-01-01"), 0.0, 0.1, 0.0), ("f", day("2025-01-01"), 0.0, 0.0, 0.0)], "chunk_id string, available_at date, positive double, negative double, uncertainty double")
    fused = sentiment.fuse_with_tone(got, tone, "2024-06-30").collect()
    assert [(x.chunk_id, x.agreement, x.fused_tone, x.fused_confidence) for x in fused] == [("a", "conflict", "negative", 0.35)]
    none = sentiment.fuse_with_tone(got, tone.where("false"), "2024-06-30")
    assert none.count() == 2 and sentiment.sentiment_panel(none, "2024-06-30").count() == 0


def test_names_are_cleaned(spark):
    names = [("Company", "Suncor  Energy Inc."), ("Company", "su"), ("Company", "Jane Doe"), ("Company", "Barrick Gold"), ("Company", "Q3 results"), ("Company", "The Registrant"), ("Event", "ab"), ("EconomicConcept", " Energy   Transition "), ("Company", "Fortis, Ltd")]
    df = spark.createDataFrame([(k, day("2024-01-01"), t, n) for k, (t, n) in enumerate(names)], "chunk_id int, available_at date, entity_type string, name string")
    universe = spark.createDataFrame([("barrick gold",)], "name string")
    got = {x.chunk_id: x.name for x in extraction.clean_names(df, universe).collect()}
    assert got == {0: "Suncor Energy", 3: "Barrick Gold", 7: "Energy Transition", 8: "Fortis"}


def test_edges_hang_on_triggers_and_known_ends(spark):
    rows = [(1, day("2024-02-01"), "Cameco is exposed to uranium with headwinds"), (2, day("2024-01-01"), "Cameco: uranium exposure boosts"), (3, None, "uranium in Canada"), (4, day("2024-01-01"), None), (5, day("2024-01-01"), "")]
    out = extraction.run_extraction(spark.createDataFrame(rows, "chunk_id int, available_at date, text string"))
    edges = {(x.edge_type, tuple(x.evidence), x.direction, x.first_seen) for x in out["edges"].collect()}
    assert edges == {("co_occurs_with", (1, 2), 0, day("2024-02-01")), ("exposed_to", (1, 2), -1, day("2024-02-01")), ("co_occurs_with", (3,), 0, None)}
    assert {x.name for x in out["entities"].collect()} == {"Cameco", "Uranium", "Canada"}
    assert "Text indicates Cameco is exposed to Uranium." in {x.explanation for x in out["edge_explanations"].collect()}
    empty = extraction.run_extraction(spark.createDataFrame([], "chunk_id int, available_at date, text string"))
    assert all(t.count() == 0 for t in empty.values())


def test_cleaning_keeps_structure_and_says_what_it_did(spark):
    plain = "Item 7. Results\r\n| Name | Value |\n|---|---|\n| A | 1 |\n| B | 2 |\n\n12\nPage 2 of 3\nfoot\nSales rose.  Costs fell.\nfoot\n\n\n\nfoot\n"
    html = "<html><h2>Risk</h2><p>Text one.</p><table><tr><td>x</td><td>y</td></tr></table><p>- 3 -</p></html>"
    rows = [(1, 1, "s", "1", day("2024-01-01"), "a.txt", plain), (2, 2, "s", "2", day("2024-01-01"), "b.htm", html), (3, 3, "s", "3", day("2024-01-01"), "c.txt", plain), (4, 4, "s", "4", day("2025-01-01"), "d", "x"), (5, 5, "", "5", day("2024-01-01"), "e", "x"), (6, 6, "s", "6", day("2024-01-01"), "f", None), (7, 7, "s", "7", None, "g", "y")]
    df = spark.createDataFrame(rows, "document_id long, row_number long, source string, source_id string, available_at date, raw_path string, raw_text string")
    out = {x.document_id: x for x in cleaning.clean_documents(df, "2024-06-30").collect()}
    assert {k: x.outcome for k, x in out.items()} == {1: "included", 2: "included", 3: "duplicate", 4: "future_document", 5: "missing_metadata", 6: "unreadable_file", 7: "missing_metadata"}
    assert out[1].clean_text == 'Item 7. Results\n\n[[[TABLE_DATA:{"rows": [["Name", "Value"], ["A", "1"], ["B", "2"]]}]]]\n\nSales rose. Costs fell.'
    assert out[2].clean_text == '[[[SECTION_TITLE:Risk]]]\n\nText one.\n[[[TABLE_DATA:{"rows": [["x", "y"]]}]]]'
    assert [s.cleaning_step for s in out[1].steps] == ["normalize_line_endings", "normalize_whitespace", "ascii_table_extract", "strip_page_numbers", "strip_repeated_headers"]
    assert [(s.cleaning_step, s.status) for s in out[2].steps][:2] == [("html_extract", "applied"), ("normalize_line_endings", "noop")]
    log = cleaning.cleaning_log(cleaning.clean_documents(df, "2024-06-30")).where("document_id = 1").orderBy("step_order").collect()
    assert all(a.after_hash == b.before_hash for a, b in zip(log[1:], log[2:])) or len(log) == 5
    docs = cleaning.clean_documents(df, "2024-06-30").withColumn("included_in_discovery", F.col("outcome") == "included")
    chunks = cleaning.chunk_rows(docs).orderBy("document_id", "chunk_index").collect()
    assert [(c.document_id, c.chunk_index, c.block_type, c.section_title) for c in chunks] == [("1", 0, "prose", "Item 7. Results"), ("1", 1, "table", "Item 7. Results"), ("1", 2, "prose", "Item 7. Results"), ("2", 0, "prose", "Risk"), ("2", 1, "table", "Risk")]
    assert chunks[1].text == "Name | Value\nA | 1\nB | 2" and chunks[1].start_char is None and chunks[0].chunk_id.startswith("chunk_") and chunks[0].token_count == 3


@pytest.mark.parametrize("line,want", [("Item 1A. Risk", "Item 1A. Risk"), ("MD&A overview", "MD&A overview"), ("PART II", "PART II"), ("RESULTS OF OPERATIONS", "RESULTS OF OPERATIONS"), ("OUTLOOK", None), ("EBIT", "EBIT"), ("Plain prose", None), ("", None)])
def test_headings(line, want):
    assert cleaning.heading_of(line) == want


def test_chunks_cover_the_text_in_order():
    r = random.Random(3)
    text = " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 60))) + r.choice([".", "", "!", ".\n\n"]) for _ in range(300))
    spans = textops.pack_chunks(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[0] < b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    assert all(b[0] == a[1] or a[1] - b[0] < 100 for a, b in zip(spans, spans[1:]))


def graph(spark):
    e = [("c1", "Company"), ("c2", "Company"), ("c3", "Company"), ("c4", "Company"), ("k1", "EconomicConcept"), ("k2", "EconomicConcept"), ("ev", "Event")]
    entities = spark.createDataFrame([(x, t, x.upper(), day("2024-01-01")) for x, t in e] + [("late", "Company", "L", day("2025-01-01")), ("undated", "Company", "U", None)], "entity_id string, entity_type string, name string, first_seen date")
    rows = [("g1", "c1", "k1", "exposed_to", 0.8, "2024-06-30"), ("g2", "k1", "k2", "causes", 0.5, "2024-06-30"), ("g3", "c2", "k2", "benefits", 0.6, "2023-07-01"), ("g4", "late", "k1", "benefits", 0.9, "2024-06-30"), ("g5", "c3", "k1", "co_occurs_with", 0.9, "2024-06-30"), ("g6", "ev", "k1", "causes", 0.005, "2024-06-30"), ("g7", "k1", "c1", "hurts", 0.5, "2024-06-30")]
    edges = spark.createDataFrame([(i, s, t, k, "document_stated", c, day(d), [f"x{i}", "x0"], "1") for i, s, t, k, c, d in rows], "edge_id string, src string, dst string, edge_type string, method string, confidence double, first_seen date, evidence array<string>, direction string")
    return entities, edges


def test_exposure_by_hand(spark):
    entities, edges = graph(spark)
    nodes, signed = exposure.build_graph(entities, edges, "2024-06-30")
    assert {(x.edge_id, x.polarity, x.weight) for x in signed.collect()} >= {("g1", 1, 0.8), ("g5", 0, 0.9), ("g6", 1, 0.01), ("g7", -1, 0.5)}
    members = spark.createDataFrame([("m", "k1"), ("m", "c1"), ("unnamed", "k2")], "community string, entity_id string")
    snapshots = spark.createDataFrame([("m", "t")], "community string, theme_snapshot_id string")
    got = {x.company_id: x for x in exposure.compute_exposure(entities, edges, nodes, members, snapshots, "2024-06-30").collect()}
    assert {k: x.graph_distance for k, x in got.items()} == {"c1": 0.0, "c2": 2.0}
    c1, c2 = got["c1"], got["c2"]
    assert c1.edge_confidence_sum == pytest.approx(1.3) and c1.evidence_count == 3 and c1.top_evidence_chunk_ids == ["x0", "xg1", "xg7"]
    assert c1.exposure_score == pytest.approx(0.30 + 0.25 + 0.20 + 0.15 * 1.0 + 0.10 * 1 / 6, abs=1e-6)
    assert c2.exposure_score == pytest.approx(0.30 / 3 + 0.15 * 0.5 + 0.10 * 1 / 6, abs=1e-6) and c2.evidence_count == 0


def test_impacts_by_hand(spark):
    entities, edges = graph(spark)
    nodes, signed = exposure.build_graph(entities, edges, "2024-06-30")
    rows = impacts.projected_impacts(nodes, signed, "2024-06-30").collect()
    assert [(x.trigger_id, x.company_id, x.direction, x.path, x.evidence_chunk_ids) for x in rows] == [("ev", "c1", -1, ["g6", "g7"], ["x0", "xg6", "xg7"])]
    assert rows[0].strength == pytest.approx(0.01 * 0.5 * 0.64) and rows[0].confidence == pytest.approx(0.255)
    assert impacts.projected_impacts(nodes.where("entity_type != 'Event'"), signed, "2024-06-30").count() == 0


def test_lineage_events(spark):
    rows = [(0, "a", "xyz"), (1, "a", "xyz"), (1, "b", "pq"), (2, "c", "xyzpq"), (3, "d", "xyz"), (3, "e", "rs"), (5, "f", "rs"), (5, "g", "new")]
    members = spark.createDataFrame([(i, t, c) for i, t, cs in rows for c in cs], "idx int, theme string, company string")
    nodes = spark.createDataFrame([(i, f"p{i}", t, f"s{i}{t}") for i, t, _ in rows], "idx int, as_of string, theme string, snapshot_id string")
    found, families = lineage.family_lineage(nodes, members, "run")
    events = {(x.idx, x.theme): x.lifecycle_event for x in found.collect()}
    assert events == {(0, "a"): "emerged", (1, "a"): "persisted", (1, "b"): "emerged", (2, "c"): "persisted", (3, "d"): "persisted", (3, "e"): "emerged", (5, "f"): "revived", (5, "g"): "emerged"}
    states = {(x.theme_family_id, x.idx): x.state for x in lineage.family_states(found, families, spark.range(6).select(F.col("id").cast("int").alias("idx"))).collect()}
    revived = found.where("theme = 'f'").first().theme_family_id
    assert [states[revived, i] for i in range(6)] == ["absent", "absent", "absent", "emerged", "dormant", "revived"]
    assert families.where(F.col("theme_family_id") == revived).first().n_companies == 2


def test_validation_without_sectors_and_random_baseline(spark):
    universe = spark.createDataFrame([(k, None) for k in range(200)], "company_id long, sector string")
    picks = [r.company_id for r in market.random_baseline(universe, 7).orderBy("rank").collect()]
    ids = list(range(200))
    random.Random(42).shuffle(ids)
    assert picks == ids[:7]
    returns = spark.createDataFrame([(day("2024-01-01"), 3, k, k / 100) for k in range(200)], "as_of date, months int, company_id long, ret double")
    got = {x.benchmark: x for x in validation.benchmark_returns(returns, universe, sample=7).collect()}
    assert got[validation.SECTOR].benchmark_caveat == validation.NO_SECTORS and got[validation.RANDOM].benchmark_ret == pytest.approx(sum(ids[:7]) / 700)


def test_runs_and_freeze(spark, tmp_path):
    runs = governance.Runs(spark, f"file://{tmp_path}")
    assert runs.listing().count() == 0
    run = runs.create("2024-01-31", ["b", "a"], "v1", dt.datetime(2024, 2, 1))
    runs.add_point(run, "2024-02-29")
    assert runs.resolve(run) == "2024-02-29" and runs.resolve(run, "2024-01-31") == "2024-01-31"
    with pytest.raises(KeyError):
        runs.resolve(run, "2020-01-01")
    t = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    artifacts = dict.fromkeys(governance.REQUIRED_ARTIFACTS, t)
    with pytest.raises(ValueError):
        runs.freeze(run, "2024-01-31", {"edges": t})
    runs.freeze(run, "2024-01-31", artifacts)
    assert runs.is_frozen(run, "2024-01-31") and not runs.is_frozen(run)
    assert runs.verify(run, "2024-01-31", artifacts) == [] and runs.verify(run, "2024-01-31", artifacts | {"edges": t.union(t)}) == ["edges"]
    assert [(r.n_points, r.n_frozen, r.latest, r.frozen) for r in runs.listing().collect()] == [(2, 1, "2024-02-29", False)]
    t.write.parquet(str(tmp_path / "d" / "edges.parquet"))
    assert governance.serve(spark, str(tmp_path / "d"), "edges.parquet").count() == 2
    for name in ("../x.parquet", "other.parquet", "edges.exe"):
        with pytest.raises(PermissionError):
            governance.serve(spark, str(tmp_path / "d"), name)


def test_configuration(spark, tmp_path):
    text = "# top\nvalidation:\n  basket_top_n: 5  # few\n  forward_windows: [1M, '3M']\n  rate: 0.5\n  on: true\n  none:\nitems:\n  - name: a\n    tags:\n      - x\n      - y\n  - name: b\n- no: 1\n".replace("- no: 1\n", "")
    (tmp_path / "c.yml").write_text(text)
    found = config.load(spark, str(tmp_path / "c.yml"))
    assert found == {"validation": {"basket_top_n": 5, "forward_windows": ["1M", "3M"], "rate": 0.5, "on": True, "none": None}, "items": [{"name": "a", "tags": ["x", "y"]}, {"name": "b"}]}
    s = config.validation_settings(found)
    assert s["basket_top_n"] == 5 and s["random_seed"] == 42 and config.load(spark, str(tmp_path / "no.yml")) == {}
    assert config.window_months("3M") == 3 and config.model_for("x", {"default": "m"}, {}) == "m" and config.model_for("x", {}, {}) is None
    with pytest.raises(ValueError):
        config.window_months("3Y")


def test_reads_and_plug_ins(spark):
    text = "Cameco met. Uranium rose as Cameco sold. Other words here. Cameco and uranium."
    row = spark.createDataFrame([(text, "Cameco", "Uranium"), ("", "a", "b"), ("No names at all.", "Cameco", "Uranium")], "t string, a string, b string").select(reads.evidence_snippet(F.col("t"), F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in row] == ["Cameco and uranium. … Uranium rose as Cameco sold.", "", "No names at all."]
    old, more = spark.createDataFrame([("a", "x")], "entity_id string, name string"), spark.createDataFrame([("a", "y"), ("b", "z")], "entity_id string, name string")
    assert {tuple(r) for r in reads.add_new_nodes(old, more).collect()} == {("a", "x"), ("b", "z")}
    assert narration.confidence_cap(0, "high") is None and narration.confidence_cap(1, "high") == "low" and narration.confidence_cap(5, "high") == "high"
    themes = spark.createDataFrame([("c", "A + B", 4, 0.5)], "community string, theme_name string, size int, strength double")
    assert narration.narrate(narration.PlainNarrator(), themes) == [("c", "A + B: 4 nodes, strength 0.50.")]
    vocabulary = [("revenue", ["Revenues", "SalesRevenueNet"]), ("sales", ["SalesRevenueNet"])]
    assert readers.concept_index(vocabulary)["SalesRevenueNet"] == ("revenue", 1)
    facts = spark.createDataFrame([(1, "SalesRevenueNet", 5.0), (1, "Revenues", 6.0), (2, "SalesRevenueNet", 7.0)], "company_id int, concept string, value double").withColumn("period_end", F.lit("2024-03-31")).withColumn("filing_date", F.lit("2024-04-30"))
    assert {(r.company_id, r.metric, r.value) for r in readers.by_priority(facts, vocabulary).collect()} == {(1, "revenue", 6.0), (2, "revenue", 7.0)}


def test_signals_fire_by_trend_and_regime(spark):
    series = spark.createDataFrame([(s, day("2024-01-01") + dt.timedelta(days=30 * k), float(v)) for s, vs in {"oil": [50, 50, 50, 80], "rate": [5, 5, 5, 5], "late": [1]}.items() for k, v in enumerate(vs)], "series_id string, obs_date date, value double")
    specs = spark.createDataFrame([("oil", 0, "zscore", None, None, 365), ("rate", 0, "threshold", [2.0, 4.0], ["low", "mid", "high"], None), ("late", 400, None, None, None, None)], "series_id string, lag_days int, mode string, thresholds array<double>, labels array<string>, window_days int")
    s = signals.pit_signals(series, specs, "2024-06-30")
    assert {(r.series_id, r.trend, r.regime, r.prior, round(r.pct_change, 6)) for r in s.collect()} == {("oil", "rising", "elevated", 50.0, 60.0), ("rate", "flat", "high", 5.0, 0.0)}
    sources = spark.createDataFrame([("oil", "Oil price", "Commodity", "USD", 0.7), ("rate", "Policy rate", "Nothing", "%", None), ("late", "Late", "Commodity", "", None)], "series_id string, label string, node_type string, unit string, confidence double")
    kinds = "series_id string, edge_type string, sector string, companies array<string>, when_trend string, when_regime string, rationale string"
    sens = spark.createDataFrame([("oil", "hurts", "Air", [" jet  CO "], "rising", None, "fuel"), ("oil", "benefits", "Energy", [], "falling", None, "no"), ("oil", "benefits", "Energy", [], None, "elevated", "sales")], kinds)
    companies = spark.createDataFrame([("c1", "Jet Co"), ("c2", "Wing"), ("c3", "Rig")], "entity_id string, name string")
    universe = spark.createDataFrame([("WING", "Air"), ("Rig", "Energy"), ("Unknown", "Energy")], "name string, sector string")
    out = signals.integrate(s, sources, sens, companies, universe, "2024-06-30")
    assert {(r.dst, r.edge_type, r.confidence, r.method) for r in out["edges"].collect()} == {("c1", "hurts", 0.7, "metadata_inferred"), ("c2", "hurts", 0.7, "metadata_inferred"), ("c3", "benefits", 0.7, "metadata_inferred")}
    assert [r.name for r in out["nodes"].collect()] == ["Oil price"]
    assert "Oil price = 80USD (rising vs ~3mo prior, regime=elevated, as of 2024-03-31); sales. Source: oil (point-in-time, vintage 2024-06-30)." in {r.explanation for r in out["explanations"].collect()}
    with pytest.raises(ValueError):
        signals.integrate(s, sources, spark.createDataFrame([("oil", "co_occurs_with", "Air", [], None, None, "x")], kinds), companies, universe, "2024-06-30")


def test_documents_as_json(spark, tmp_path):
    import json

    sinks.write_document({"nodes": spark.createDataFrame([("b",), ("a",)], "id string"), "edges": spark.createDataFrame([], "id string")}, str(tmp_path / "g"), run_id="r", n=2)
    assert json.loads(next((tmp_path / "g").glob("part-*")).read_text()) == {"run_id": "r", "n": 2, "nodes": [{"id": "a"}, {"id": "b"}], "edges": []}


def test_discovery_does_not_reach_for_views():
    """Operators know nothing of the analysts' views, of validation zones or of the engine above them."""
    import pathlib

    import narrascope

    for path in (pathlib.Path(narrascope.__file__).parent / "operators").glob("*.py"):
        assert not re.search(r"sources\.catalog|createOrReplaceTempView|narrascope\.engine|narrascope\.llm", path.read_text()), path
