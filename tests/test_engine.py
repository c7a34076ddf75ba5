"""A run from manifest files to exposure, frozen and validated, over two points."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from narrascope.engine import Engine
from narrascope.operators import extraction, reads
from narrascope.sources import catalog

HEAD = "source,source_id,title,document_type,company_id,raw_path,published_at,available_at,vintage,language,source_url,license,confidentiality,notes\n"
TEXTS = {
    "a.txt": ("2024-01-10", "Cameco is exposed to uranium with strong tailwinds. Revenue rose to $2.5 billion in Q4 2023.\nPage 1 of 2\n"),
    "b.txt": ("2024-01-20", "Beta Industries has exposure to electricity demand and the data center. Electricity demand causes a capex increase. Beta Industries benefits from a capex increase."),
    "c.htm": ("2024-02-10", "<html><h2>Outlook</h2><p>Cameco is sensitive to inflation, and a rate cut may help support it. Cameco is exposed to electricity demand.</p></html>"),
    "d.txt": ("2024-03-10", "Cameco and copper."),
    "e.txt": ("2024-01-25", "Analysts ask whether Cameco sees strong growth and strong demand, or a decline."),
}


def manifest(folder, names):
    path = folder / f"manifest-{len(names)}.csv"
    path.write_text(HEAD + "".join(f"news,{k},T{k},{'sell-side note' if n == 'e.txt' else '10-k'},co{k},{n},{TEXTS[n][0]},{TEXTS[n][0]},v1,en,u/{k},l,public,n\n" for k, n in enumerate(names)))
    return str(path)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    docs = tmp_path_factory.mktemp("docs")
    for name, (_, text) in TEXTS.items():
        (docs / name).write_text(text)
    flags = ("positive", "negative", "uncertainty", "litigious", "strong_modal", "weak_modal")
    lexicon = spark.createDataFrame([("strong", 1, 0, 0, 0, 0, 0), ("decline", 0, 1, 0, 0, 0, 0), ("may", 0, 0, 1, 0, 0, 1)], "word string, " + ", ".join(f"{c} int" for c in flags))
    e = Engine(spark, f"file://{root}", lexicon=lexicon)
    e.universe = spark.createDataFrame([("Beta Industries",)], "name string")
    run = e.runs.create("2024-01-31", list(TEXTS), "v1", dt.datetime(2024, 2, 1))
    real = e.extract
    e.extract = lambda r, p, x=None: real(r, p, extraction.RuleExtractor(universe=e.universe))
    names = list(TEXTS)
    e.build_panel(run, {"2024-01-31": (manifest(root, names), str(docs)), "2024-02-29": (manifest(root, names), str(docs))})
    return e, run, root, (manifest(root, names), str(docs))


def test_a_point_holds_only_what_was_known(engine):
    e, run, _, _ = engine
    early = {r.title for r in e.table(run, "documents", "2024-01-31").where("included_in_discovery").collect()}
    assert early == {"T0", "T1", "T4"} and e.table(run, "documents").where("included_in_discovery").count() == 4
    for p in ("2024-01-31", "2024-02-29"):
        assert e.integrity(run, p).count() == 0
        assert e.table(run, "entities", p).where(F.col("first_seen") > F.lit(p).cast("date")).count() == 0
    names = {r.name for r in e.table(run, "entities").collect()}
    assert {"Cameco", "Uranium", "Beta Industries", "Electricity Demand", "Inflation", "Rate Cut", "Capex Increase"} <= names and "Copper" not in names
    claims = {(r.company, r.metric, r.value, str(r.period_end)) for r in e.table(run, "financial_metrics").collect()}
    assert claims == {("co0", "revenue", 2.5, "2023-12-31")}
    assert e.table(run, "document_cleaning_log").where("cleaning_step = 'strip_page_numbers' AND status = 'applied'").count() == 1


def test_reads(engine, spark):
    e, run, _, _ = engine
    cameco = reads.find_anchor(e.table(run, "graph_nodes"), "cameco")
    nodes, edges = e.slice(run, "Cameco", depth=1, direction="out")
    assert {r.label for r in nodes.collect()} == {"Cameco", "Uranium", "Electricity Demand", "Inflation"} and edges.count() == 4
    assert {r.label for r in e.slice(run, "Cameco", depth=2, levels=["macro"])[0].collect()} == {"Cameco", "Uranium", "Inflation"}
    assert e.slice(run, "Cameco", depth=2, most_nodes=2)[0].count() == 2 and e.slice(run, "Cameco", depth=0)[0].count() == 1
    for bad in ({"direction": "up"}, {"depth": -1}, {"edge_types": ["x"]}, {"levels": ["x"]}, {"most_nodes": 0}):
        with pytest.raises(ValueError):
            e.slice(run, "Cameco", **bad)
    with pytest.raises(reads.AnchorError):
        e.slice(run, "nobody")
    profile = e.company(run, cameco)
    assert profile["themes"].count() >= 1 and profile["themes"].first().exposure_score > 0
    with pytest.raises(LookupError):
        e.company(run, "ent_none")
    assert any("Cameco" in r.snippet for r in e.company_evidence(run, cameco).collect())
    assert {r.direction for r in e.company_sentiment(run, "cameco").collect()} <= {"positive", "negative", "neutral", "mixed"}
    chunk = e.table(run, "chunks").where("section_title = 'Outlook'").first()
    source = e.chunk_source(run, chunk.chunk_id).first()
    assert source.title == "T2" and source.source_url == "u/2" and source.document_text == chunk.text
    assert e.levels(run).where("company > 0").count() >= 1 and e.relevance(run).count() >= 1 and e.node_profile(run, cameco).first().degree >= 3
    theme = e.table(run, "communities").where(F.col("entity_id") == cameco).first().community
    assert e.documents_of(run, theme).first().document_ids and e.subgraph(run, [theme])[0].count() >= 2
    assert e.triggers(run).count() == e.projections(run).select("trigger_id").distinct().count()
    tables = e.panel_tables(run)
    assert tables["points"].where("discovery_present").count() == 2 and tables["summary"].first().family_count >= 1
    with catalog.analyst_session(spark, {k: v for k, v in e.views(run).items() if k.startswith("v_disc_")}, frozen=False) as s:
        assert s.sql("SELECT count(*) FROM v_disc_company_theme_exposure").first()[0] >= 2


def test_only_management_is_read(engine):
    e, run, _, _ = engine
    said = {r.text[:8]: r.speaker_role for r in e.said_chunks(run, "2024-01-31").collect()}
    assert said["Analysts"] == "analyst" and {r for t, r in said.items() if t != "Analysts"} == {"management"}
    asked = e.said_chunks(run, "2024-01-31").where("speaker_role = 'analyst'").first().chunk_id
    assert asked not in {r.chunk_id for r in e.table(run, "management_sentiment", "2024-01-31").collect()}
    tone = {r.chunk_id: r for r in e.table(run, "chunk_tone", "2024-01-31").collect()}
    assert tone[asked].positive > 0 and tone[asked].negative > 0 and tone[asked].litigious == 0
    fused = e.table(run, "fused_sentiment", "2024-01-31").collect()
    assert {r.chunk_id for r in fused} == {r.chunk_id for r in e.table(run, "management_sentiment", "2024-01-31").collect()} and all(r.tone_day for r in fused)


def test_a_panel_in_one_plan_is_that_of_its_points(engine):
    e, run, _, (manifest_file, folder) = engine
    points = ["2024-02-29", "2024-01-31"]
    e.discover_panel(run, points, manifest_file, folder, extraction.RuleExtractor(universe=e.universe))
    plain = lambda rows: sorted((tuple(sorted(map(str, v)) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    for p in points:
        for name, columns in {
            "documents": "document_id content_hash clean_text", "chunks": "chunk_id document_id available_at text", "entities": "entity_id entity_type name first_seen source_chunk_ids",
            "edges": "edge_id src dst edge_type confidence direction first_seen evidence", "graph_nodes": "entity_id entity_type label first_seen", "graph_edges": "edge_id src dst polarity weight first_seen",
            "communities": "community entity_id", "theme_metrics": "community theme_snapshot_id theme_name size n_edges density strength saturation top_entities top_companies",
            "company_theme_exposure": "company_id theme_snapshot_id community exposure_score graph_distance edge_confidence_sum evidence_count top_evidence_chunk_ids",
        }.items():
            alone = e.table(run, name, p)
            alone = alone.where("included_in_discovery") if name == "documents" else alone
            assert plain(e.panel_table(run, name, p).select(*columns.split()).collect()) == plain(alone.select(*columns.split()).collect()), (p, name)


def test_damaged_points_are_told(engine, spark, tmp_path):
    e, _, _, source = engine
    run = e.runs.create("2024-01-31", list(TEXTS), "v1", dt.datetime(2024, 2, 2))
    assert e.build_panel(run, {"2024-01-31": ("nowhere.csv", "nothing/"), "2024-02-29": source}) == ["2024-02-29"]
    status = {r.as_of: (r.status, bool(r.reason)) for r in e.panel_status(run).collect()}
    assert status == {"2024-01-31": ("failed", True), "2024-02-29": ("done", False)}
    assert e.damage(run, "2024-01-31") == "communities is not there" and e.damage(run, "2024-02-29") is None
    assert {r.as_of: r.discovery_present for r in e.panel_tables(run)["points"].collect()} == {"2024-02-29": True}
    broken = e.path(run, "2024-02-29", "theme_metrics").removeprefix("file://")
    import os

    for name in os.listdir(broken):
        if name.endswith(".parquet"):
            with open(f"{broken}/{name}", "w") as f:
                f.write("not a table")
    assert "theme_metrics" in e.damage(run, "2024-02-29")
    with pytest.raises(LookupError):
        e.panel_tables(run)


def test_freeze_then_validate(engine, spark):
    e, run, root, source = engine
    with pytest.raises(catalog.LeakageError):
        e.validation_table(run, "market_prices")
    for p in ("2024-01-31", "2024-02-29"):
        e.freeze(run, p)
    with pytest.raises(catalog.LeakageError):
        e.write(run, "2024-02-29", "communities", e.table(run, "communities"))
    assert e.build_panel(run, {"2024-01-31": source, "2024-02-29": source}) == []
    companies = [r.company_id for r in e.table(run, "company_theme_exposure").select("company_id").distinct().collect()]
    days = [dt.date(2024, 3, 1) + dt.timedelta(days=k) for k in range(100)]
    prices = spark.createDataFrame([(c, d, d, 10.0 + i + k / 10) for i, c in enumerate(companies) for k, d in enumerate(days)], "company_id string, price_date date, available_at date, close double")
    prices.write.parquet(f"{root}/{run}/validation/market_prices.parquet")
    rows = e.validate(run, "2024-02-29", [1, 3, 12]).collect()
    assert {r.forward_window for r in rows} == {"1M", "3M"} and all(r.illustrative and "12M" in r.caveats for r in rows)
    assert any(r.basket_ret and r.basket_ret > 0 for r in rows)
    text = e.report(run, "2024-02-29", e.validate(run, "2024-02-29", [1]))
    assert run in text and "## Validation" in text and "single snapshot" in text and "Not validated." in e.report(run, "2024-02-29")
    assert [(r.n_points, r.frozen) for r in e.runs.listing().collect() if r.run_id == run] == [(2, True)]
