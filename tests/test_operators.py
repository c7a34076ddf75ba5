import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from narrascope.operators import claims, evidence, graph, market, panel, pit, textops
from narrascope.sources import catalog, readers, sinks


def day(text):
    return dt.date.fromisoformat(text)


def test_gates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02T10:00:00",), ("2025-01-01",), ("junk",), (None,)], "d string")
    row = df.select(*[F.sum(pit.known_at(pit.to_day(F.col("d")), "2024-06-01", p).cast("int")).alias(p) for p in ("closed", "open")]).first()
    assert tuple(row) == (2, 4)


def test_month_ends(spark):
    got = spark.range(1).select(pit.month_ends(F.lit("2024-01-15").cast("date"), F.lit("2024-03-10").cast("date")).alias("m")).first().m
    assert got == [day("2024-01-31"), day("2024-02-29"), day("2024-03-10")]


def prices(spark, more=()):
    rows = [("A", day("2024-01-01"), 10.0), ("A", day("2024-01-02"), 11.0), ("A", day("2024-03-30"), 22.0), ("A", day("2024-04-02"), 99.0), ("B", day("2024-02-01"), 5.0), *more]
    return spark.createDataFrame([(c, d, d, p) for c, d, p in rows], "company_id string, price_date date, available_at date, close double")


def test_forward_return_takes_first_and_last_of_the_window(spark):
    points = spark.createDataFrame([(day("2024-01-01"), 3)], "as_of date, months int")
    got = {r.company_id: r.ret for r in market.forward_returns(prices(spark), points, []).collect()}
    assert got == {"A": 1.0, "B": 0.0}
    late = prices(spark, [("A", day("2024-05-01"), 1.0)])  # rows past the window change nothing
    assert {r.company_id: r.ret for r in market.forward_returns(late, points, []).collect()} == got


@pytest.mark.parametrize("rows,rho", [([(1, 2), (2, 4), (3, 9)], 1.0), ([(1, 3), (2, 2), (3, 1)], -1.0), ([(1, 1)], None), ([(1, 5), (2, 5)], None)])
def test_spearman(spark, rows, rho):
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in rows], "k string, x double, y double")
    assert market.spearman(df, ["k"], "x", "y").first().rho == (None if rho is None else pytest.approx(rho))


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, polarity int, weight double")


def nodes(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "node string")


def test_propagation(spark):
    e = edges(spark, [("t", "a", 1, 0.5), ("a", "b", -1, 0.5), ("b", "t", 1, 1.0), ("t", "z", 0, 1.0), ("b", "c", 1, 1.0), ("c", "d", 1, 1.0)])
    got = {r.company: (r.impact, r.direction, r.n_paths) for r in graph.propagate(nodes(spark, "t"), e, nodes(spark, "a", "b", "c", "d", "z", "t")).collect()}
    assert got == {"a": (0.4, 1, 1), "b": (-0.16, -1, 1), "c": (-0.128, -1, 1)}
    cancel = edges(spark, [("t", "a", 1, 1.0), ("t", "b", -1, 1.0), ("a", "c", 1, 1.0), ("b", "c", 1, 1.0)])
    assert {r.company for r in graph.propagate(nodes(spark, "t"), cancel, nodes(spark, "c")).collect()} == set()


def test_components_and_bfs(spark):
    e = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "y")], "src string, dst string")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert set(got.values()) == {"n000", "x"} and got["n040"] == "n000"
    seeds = spark.createDataFrame([("s", "n005"), ("s", "n020")], "seed string, node string")
    dist = {r.node: r.dist for r in graph.bfs(seeds, e, 4).collect()}
    assert dist["n005"] == 0 and dist["n009"] == 4 and dist["n016"] == 4 and "n010" not in dist


def test_density(spark):
    m = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("z", 2)], "node string, community int")
    e = edges(spark, [("a", "b", 1, 0.5), ("b", "c", 1, 1.0), ("a", "z", 1, 9.0)])
    got = {r.community: (r.size, r.n_edges, r.density, r.strength) for r in graph.community_metrics(m, e).collect()}
    assert got == {1: (3, 2, round(2 / 3, 6), 0.75), 2: (1, 0, 0.0, 0.0)}


def test_lineage(spark):
    members = spark.createDataFrame([(i, t, x) for i, t, xs in ((0, "p", "abc"), (0, "q", "xyz"), (1, "r", "abc"), (1, "s", "mno"), (2, "u", "abcd")) for x in xs], "idx int, theme string, member string")
    links = panel.jaccard_links(members)
    assert {(r.theme, r.next_theme, r.jaccard) for r in links.collect()} == {("p", "r", 1.0), ("r", "u", 0.75)}
    events = {r.theme: r.event for r in panel.lifecycle(members.select("idx", "theme").distinct(), links).collect()}
    assert events == {"p": "emerged", "q": "emerged", "r": "persisted", "s": "emerged", "u": "persisted"}


def test_chunks_keep_sentences_whole():
    text = " ".join(f"Sentence number {i} has a few words in it." for i in range(60))
    spans = textops.pack_chunks(text)
    assert all(b - a <= 800 for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < p[1] - q[0] < 100 for p, q in zip(spans, spans[1:]))
    assert textops.pack_chunks("x" * 2000) == [(0, 2000)] and textops.pack_chunks("  ") == []


def test_pages():
    text = textops.page_text("<DOCUMENT>\n<TYPE>10-K\n<style>no</style><h2>Item &amp; 1</h2><p>One&nbsp;two<script>no</script></p><table><tr><td>a</td><td> b  c</td></tr></table>after")
    assert text.split("\n") == ["[[[SECTION_TITLE:Item & 1]]]", "", "One two", '[[[TABLE_DATA:{"rows": [["a", "b c"]]}]]]', "after"]


def test_claims(spark):
    text = "Revenue rose to $1.2 billion in Q2  2024. We now expect gross margin of 41.5% for FY 2025. EPS came in at $1.25 for Q3 2024. Net income fell to $30 million."
    df = spark.createDataFrame([(1, "c", text), (2, "c", text)], "chunk_id long, company string, text string")
    rows = claims.find_claims(df)
    got = {(r.metric, r.value, r.unit, r.period, r.direction, r.is_guidance, r.confidence) for r in rows.collect()}
    assert got == {("revenue", 1.2, "USD_billions", "Q2 2024", "rose", False, 0.75), ("gross_margin", 41.5, "percent", "FY 2025", "", True, 0.70), ("eps", 1.25, "USD_per_share", "Q3 2024", "", False, 0.75), ("net_income", 30.0, "USD_millions", "", "fell", False, 0.75)}
    assert {tuple(r.chunks) for r in claims.roll_up(rows).collect()} == {(1, 2)}


def test_readers(spark, tmp_path):
    (tmp_path / "fred.csv").write_text("DATE,GDP\n2024-01-01,1.5\n2024-02-01,.\n2024-03-01,\n")
    assert [tuple(r) for r in readers.read_series(spark, {"csv": str(tmp_path / "fred.csv"), "series_id": "gdp", "date_col": "DATE", "value_col": "GDP"}).collect()] == [("gdp", day("2024-01-01"), 1.5)]
    (tmp_path / "boc.csv").write_text('"TERMS"\n"x","y"\n\n"date","V1"\n"2024-01-05","2.5"\n"2024-01-06","n/a"\n')
    assert [tuple(r)[1:] for r in readers.read_series(spark, {"csv": str(tmp_path / "boc.csv"), "series_id": "v"}).collect()] == [(day("2024-01-05"), 2.5)]
    (tmp_path / "w.csv").write_text("d,a,b\n2024-01-01,1,2\n2024-01-02,.,3\n")
    assert [tuple(r) for r in readers.read_series(spark, {"csv": str(tmp_path / "w.csv"), "reader": "wide_table", "date_col": "d", "series_col": "a"}).collect()] == [("a", day("2024-01-01"), 1.0)]
    with pytest.raises(ValueError):
        readers.read_series(spark, {"reader": "other"})
    rest = ",t,10-k,c,{p},2024-01-01,{a},v1,en,u,l,public,n"
    lines = [rest.format(p="p", a="2024-01-01"), rest.format(p="p", a="2026-01-01"), rest.format(p="p", a=""), rest.format(p="q", a="2024-01-01"), rest.format(p="p", a="soon")]
    (tmp_path / "m.csv").write_text("source,source_id,title,document_type,company_id,raw_path,published_at,available_at,vintage,language,source_url,license,confidentiality,notes\n" + "".join(f"s,{k}{x}\n" for k, x in enumerate(lines)) + ",9" + lines[0] + "\n")
    manifest = readers.read_manifest(spark, str(tmp_path / "m.csv"))
    files = spark.createDataFrame([("p", "text", "hash")], "raw_path string, text string, content_hash string")
    got = [(r.source_vintage, r.reason) for r in readers.classify_manifest(manifest, "2024-12-31", files).orderBy("source_id").collect()]
    assert got == [("v1", x) for x in (None, "available_at is after run as_of_date", "no_determinable_publish_time", "raw_path missing", "invalid date format in available_at", "missing required field: source")]
    kept, aside = readers.import_manifest(manifest, "2024-12-31", files)
    assert [r.source_id for r in kept.collect()] == ["0"] and aside.count() == 5
    sinks.write_manifest(kept.coalesce(1), readers.MANIFEST, str(tmp_path / "out"))
    assert readers.read_manifest(spark, str(tmp_path / "out")).select("source_id", "notes").collect()[0] == ("0", "n")
    (tmp_path / "s.json").write_text('{"cik": "12", "name": "N", "tickers": ["T"], "filings": {"recent": {"accessionNumber": ["0-1"], "filingDate": ["2024-01-02"], "reportDate": ["2023-12-31"], "form": ["10-K"], "primaryDocument": ["d.htm"], "primaryDocDescription": ["10-K"]}}}')
    r = readers.read_submissions(spark, str(tmp_path / "s.json")).first()
    assert (r.company_id, r.title, r.available_at, r.source_url) == ("T", "N 10-K (2023-12-31)", "2024-01-02", "https://www.sec.gov/Archives/edgar/data/12/01/d.htm")


def test_zones_and_freeze(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, x string").write.parquet(str(tmp_path / "t.parquet"))
    with pytest.raises(catalog.LeakageError), catalog.analyst_session(spark, {"v_val_t": str(tmp_path / "t.parquet")}, frozen=False):
        pass
    with catalog.analyst_session(spark, {"v_disc_t": str(tmp_path / "t.parquet"), "v_disc_no": str(tmp_path / "no*")}, frozen=False) as s:
        assert s.sql("SELECT count(*) FROM v_disc_t").first()[0] == 1
        assert [t.name for t in s.catalog.listTables()] == ["v_disc_t"]
        with pytest.raises(Exception, match="(?i)unsupported|not allowed|insert"):
            s.sql("INSERT INTO v_disc_t VALUES (2, 'b')")
    df = spark.read.parquet(str(tmp_path / "t.parquet"))
    frozen = catalog.freeze({"t": df}, ["t"])
    assert catalog.verify(frozen, {"t": df.repartition(3)}) == [] and catalog.verify(frozen, {"t": df.union(df)}) == ["t"]
    with pytest.raises(ValueError):
        catalog.freeze({}, ["t"])


def test_sinks(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    sinks.write_table(spark.createDataFrame([], "a int"), schema, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).schema.names == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.conform(spark.createDataFrame([(1, 2)], "a int, zzz int"), schema)
    with pytest.raises(catalog.LeakageError):
        sinks.write_table(spark.createDataFrame([], "a int"), schema, str(tmp_path / "e"), frozen=True)
    sinks.write_validation_csv(spark.createDataFrame([("x", 0.5), ("y", None)], "k string, r double").coalesce(1), str(tmp_path / "v"), ["r"])
    assert next((tmp_path / "v").glob("*.csv")).read_text() == "k,r\nx,0.500000\ny,\n"


def test_only_later_rows_change_nothing(spark):
    docs = spark.createDataFrame([(1, "t", "s", day("2024-01-01")), (2, "u", "s", day("2024-02-01"))], "doc_id long, text string, source string, available_at date")
    later = docs.unionByName(spark.createDataFrame([(0, "t", "s", day("2030-01-01"))], docs.schema))
    keep = lambda d: sorted(tuple(r) for r in evidence.quarantine(d, "2024-12-31").where("outcome = 'included'").collect())
    assert keep(docs) == keep(later)


def test_recency(spark):
    row = spark.range(1).select(*[graph.recency(F.lit(d).cast("date"), F.lit("2024-12-31").cast("date")).alias(f"d{k}") for k, d in enumerate(("2024-12-31", "2020-01-01", "2025-01-01", None))]).first()
    assert [round(x, 6) for x in row] == [1.0, 0.0, 0.0, 0.0] and math.isclose(sum(graph.EXPOSURE_WEIGHTS), 1.0)
