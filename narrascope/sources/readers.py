"""Readers: document manifests, filings, company facts, time series and lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrascope.operators.pit import known_at, to_day

#: Columns of the manifest contract, in order.
MANIFEST = (
    "source source_id title document_type company_id raw_path published_at available_at source_vintage language source_url license confidentiality notes"
).split()
REQUIRED = ("source", "source_id", "available_at", "raw_path")
CURRENCIES = ("USD", "CAD", "EUR", "GBP", "JPY", "CHF", "AUD", "CNY")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest CSV with all contract columns as text; ``vintage`` is taken for ``source_vintage``."""
    df = spark.read.csv(path, header=True)
    if "source_vintage" not in df.columns and "vintage" in df.columns:
        df = df.withColumnRenamed("vintage", "source_vintage")
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"manifest lacks {', '.join(missing)}")
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in MANIFEST])


def read_raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, text and sha256 of every file of a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", F.decode("content", "utf-8").alias("text"), F.sha2("content", 256).alias("content_hash"))


TIMES = ("published_at", "available_at")


def classify_manifest(manifest: DataFrame, as_of: str, files: DataFrame | None = None) -> DataFrame:
    """Adds ``reason``: null for rows to import, else why a row is put aside, the first that holds.

    A row without both days has no determinable publish time; it is never dated by a guess. Then every contract column
    must be there, the file (of ``files``: raw_path, if given), valid days, and a day known at ``as_of``.
    """
    bare = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = F.when(bare("published_at") | bare("available_at"), "no_determinable_publish_time")
    for c in MANIFEST:
        if c not in TIMES and c in manifest.columns:
            reason = reason.when(bare(c), f"missing required field: {c}")
    if files is not None:
        manifest = manifest.join(files.select("raw_path", F.lit(True).alias("_file")).distinct(), "raw_path", "left")
        reason = reason.when(F.col("_file").isNull(), "raw_path missing")
    for c in TIMES:
        reason = reason.when(to_day(F.col(c)).isNull(), f"invalid date format in {c}")
    reason = reason.when(to_day(F.col("available_at")) > F.lit(as_of).cast("date"), "available_at is after run as_of_date")
    return manifest.withColumn("reason", reason).drop("_file")


def import_manifest(manifest: DataFrame, as_of: str, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw documents, quarantined rows with reasons). ``contents``: raw_path, text, content_hash of the files there are."""
    rows = classify_manifest(manifest, as_of, contents)
    kept = rows.where("reason IS NULL").join(contents, "raw_path")
    document = F.concat_ws("::", "source_id", "company_id", F.xxhash64("raw_path", "published_at").cast("string"))
    return kept.drop("reason").withColumn("document_id", document), rows.where("reason IS NOT NULL")


#: Titles without a story.
BOILERPLATE_TITLE = r"(?i)stock (rises|falls|gains|drops|climbs|declines|jumps|sinks).*(Monday|Tuesday|Wednesday|Thursday|Friday)|(under|out)performs market"


def select_news(articles: DataFrame, as_of: str, least_relevance: float = 0.3, done: DataFrame | None = None) -> DataFrame:
    """Articles to collect: known at ``as_of``, about the company, with a story; companies in ``done`` are skipped, an url is taken once.

    ``articles``: company_id, url, title, published_at, relevance.
    """
    live = articles.where((F.col("published_at") <= F.lit(as_of).cast("date")) & (F.coalesce("relevance", F.lit(0.0)) >= least_relevance) & ~F.coalesce("title", F.lit("")).rlike(BOILERPLATE_TITLE))
    if done is not None:
        live = live.join(done.select("company_id").distinct(), "company_id", "left_anti")
    first = Window.partitionBy("company_id", "url").orderBy("published_at", "title")
    return live.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("source_id", F.substring(F.sha2("url", 256), 1, 16))


SUBMISSIONS = "cik STRING, name STRING, tickers ARRAY<STRING>, filings STRUCT<recent: STRUCT<accessionNumber: ARRAY<STRING>, filingDate: ARRAY<STRING>, reportDate: ARRAY<STRING>, form: ARRAY<STRING>, primaryDocument: ARRAY<STRING>, primaryDocDescription: ARRAY<STRING>>>"


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Filings of an issuer: its parallel lists as rows of the manifest; the filing day is when a filing is known."""
    df = spark.read.schema(SUBMISSIONS).json(path, multiLine=True)
    r = "filings.recent."
    zipped = F.arrays_zip(*[F.col(r + c).alias(c) for c in ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument", "primaryDocDescription")])
    rows = df.select("cik", "name", "tickers", F.inline(zipped))
    cik = F.lpad(F.regexp_replace("cik", r"\D", ""), 10, "0")
    company = F.coalesce(F.get("tickers", F.lit(0)), F.concat(F.lit("CIK"), cik))
    bare = F.replace("accessionNumber", F.lit("-"), F.lit(""))
    url = F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), F.regexp_replace(cik, "^0+", ""), bare, "primaryDocument")
    label = F.trim("primaryDocDescription")
    part = lambda c: F.when(c != "", c)
    title = F.concat_ws(" ", part(F.col("name")), part(F.col("form")), F.when((label != "") & (F.upper(label) != F.upper("form")), label), F.when(F.col("reportDate") != "", F.concat(F.lit("("), "reportDate", F.lit(")"))))
    title = F.when(title != "", title).otherwise("filing")
    return rows.select(F.lit("edgar").alias("source"), F.col("accessionNumber").alias("source_id"), title.alias("title"), F.lower("form").alias("document_type"), company.alias("company_id"), F.col("primaryDocument").alias("raw_path"), F.col("filingDate").alias("published_at"), F.col("filingDate").alias("available_at"), url.alias("source_url"))


OBSERVATION = "STRUCT<`end`: STRING, val: DOUBLE, accn: STRING, fy: INT, fp: STRING, form: STRING, filed: STRING>"
FACTS = f"cik BIGINT, entityName STRING, facts MAP<STRING, MAP<STRING, STRUCT<label: STRING, units: MAP<STRING, ARRAY<{OBSERVATION}>>>>>"


def currency_of(unit: Column) -> Column:
    base = F.split_part(unit, F.lit("/"), F.lit(1))
    return F.when(base.isin(*CURRENCIES), base)


def flatten_facts(raw: DataFrame, concepts: dict[str, str], as_of: str) -> DataFrame:
    """Observations known at as_of, by metric. ``raw``: company_id and the facts column; ``concepts``: concept -> metric.

    Where two taxonomies have a concept the later in name order of (us-gaap, ifrs-full) counts; the earliest filing of a
    period stands, later restatements don't change it.
    """
    names = F.create_map(*[x for k, v in concepts.items() for x in (F.lit(k), F.lit(v))])
    rows = raw.select("company_id", F.explode("facts").alias("taxonomy", "c")).where(F.col("taxonomy").isin("us-gaap", "ifrs-full"))
    rows = rows.select("company_id", "taxonomy", F.explode("c").alias("concept", "x")).withColumn("metric", F.try_element_at(names, F.col("concept"))).where("metric IS NOT NULL")
    top = Window.partitionBy("company_id", "concept")
    rows = rows.withColumn("_top", F.max((F.col("taxonomy") == "ifrs-full").cast("int")).over(top)).where("(taxonomy = 'ifrs-full') = (_top = 1)")
    rows = rows.select("company_id", "concept", "metric", F.explode("x.units").alias("unit", "obs")).select("company_id", "concept", "metric", "unit", F.inline("obs"))
    filed, end = to_day(F.col("filed")), to_day(F.col("end"))
    rows = rows.withColumn("filing_date", filed).withColumn("period_end", end).where(F.col("val").isNotNull() & F.col("period_end").isNotNull() & (F.col("filing_date") <= F.lit(as_of).cast("date")))
    first = Window.partitionBy("company_id", "metric", "period_end").orderBy("filing_date", "concept", "accn", "unit")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("company_id", "metric", "period_end", "filing_date", F.col("val").alias("value"), currency_of(F.col("unit")).alias("currency"), F.col("filing_date").alias("available_at"))


def replace_companies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ingest that can be repeated: rows of the companies in ``new`` are replaced."""
    return old.join(new.select("company_id").distinct(), "company_id", "left_anti").unionByName(new, allowMissingColumns=True)


def ratio(facts: DataFrame, numerator: str, denominator: str, name: str) -> DataFrame:
    keys = ["company_id", "period_end", "filing_date"]
    side = lambda m, c: facts.where(F.col("metric") == m).select(*keys, F.col("value").alias(c))
    return side(numerator, "a").join(side(denominator, "b"), keys).where("b != 0").select(*keys, F.lit(name).alias("metric"), F.round(F.col("a") / F.col("b"), 6).alias("value"))


def read_fred(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """Two columns with a header; missing values are a dot or nothing."""
    df = spark.read.csv(path, header=True)
    day, value = (F.col(f"`{c}`") for c in df.columns[:2])
    return df.select(F.lit(series_id).alias("series_id"), to_day(day).alias("obs_date"), F.expr(f"try_cast(nullif(trim(`{df.columns[1]}`), '.') AS DOUBLE)").alias("value")).where("obs_date IS NOT NULL AND value IS NOT NULL")


def read_preamble_csv(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """Lines of a file that begin with a day and a number; all others are skipped."""
    cells = F.split(F.regexp_replace("value", '"', ""), ",")
    rows = spark.read.text(path).select(F.trim(F.get(cells, F.lit(0))).alias("d"), F.trim(F.get(cells, F.lit(1))).alias("v"))
    return rows.where(r"d RLIKE '^\\d{4}-\\d{2}-\\d{2}'").select(F.lit(series_id).alias("series_id"), to_day(F.col("d")).alias("obs_date"), F.expr("try_cast(v AS DOUBLE)").alias("value")).where("obs_date IS NOT NULL AND value IS NOT NULL")


def read_wide(spark: SparkSession, path: str, day: str, series: list[str]) -> DataFrame:
    """Columns of a wide table as rows."""
    df = spark.read.csv(path, header=True)
    long = df.unpivot([day], series, "series_id", "raw")
    return long.select("series_id", to_day(F.col(day)).alias("obs_date"), F.expr("try_cast(raw AS DOUBLE)").alias("value")).where("obs_date IS NOT NULL AND value IS NOT NULL")


def read_series(spark: SparkSession, spec: dict) -> DataFrame:
    """A series by its configuration: csv, series_id, and a reader (fred_csv, boc_csv, wide_table).

    Without a reader, one with both a day and a value column is fred_csv, any other boc_csv.
    """
    kind = spec.get("reader") or ("fred_csv" if spec.get("date_col") and spec.get("value_col") else "boc_csv")
    if kind == "wide_table":
        return read_wide(spark, spec["csv"], spec["date_col"], [spec["series_col"]])
    if kind not in ("fred_csv", "boc_csv"):
        raise ValueError(f"no reader for {kind}")
    return (read_fred if kind == "fred_csv" else read_preamble_csv)(spark, spec["csv"], spec["series_id"])


def company_fundamentals(facts: DataFrame, as_of: str, company: str | None = None) -> DataFrame:
    """Reported facts known at ``as_of``, of one company if asked for."""
    live = facts.where(known_at(F.col("available_at"), as_of))
    return live if company is None else live.where(F.col("company_id") == company)


def resolve_raw_path(filings: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each filing: its declared name, the same as .txt, its accession number, or that without dashes; the first that is there.

    ``filings``: source_id (the accession number), raw_path (the declared name); ``files``: raw_path. Without any, the
    declared name stays, so that the import puts the row aside.
    """
    stem = F.regexp_replace("raw_path", r"\.[^.]*$", "")
    txt = lambda c: F.concat(c, F.lit(".txt"))
    names = F.filter(F.array(F.col("raw_path"), txt(stem), txt(F.col("source_id")), txt(F.replace("source_id", F.lit("-"), F.lit("")))), lambda x: x.isNotNull() & (x != "") & (x != ".txt"))
    tried = filings.select("source_id", F.posexplode(names).alias("k", "_name")).join(files.select(F.col("raw_path").alias("_name")).distinct(), "_name")
    first = tried.groupBy("source_id").agg(F.min_by("_name", "k").alias("_found"))
    declared = F.coalesce(F.when(F.col("raw_path") != "", F.col("raw_path")), txt(F.col("source_id")))
    return filings.join(first, "source_id", "left").withColumn("raw_path", F.coalesce("_found", declared)).drop("_found")


def concept_index(vocabulary: list[tuple[str, list[str]]]) -> dict[str, tuple[str, int]]:
    """Concept -> (metric, priority): the first metric that lists a concept has it."""
    out: dict[str, tuple[str, int]] = {}
    for metric, concepts in vocabulary:
        for k, c in enumerate(concepts):
            out.setdefault(c, (metric, k))
    return out


def by_priority(facts: DataFrame, vocabulary: list[tuple[str, list[str]]]) -> DataFrame:
    """Facts under their metric; of several concepts of a metric the first that has data for a company and period counts."""
    index = concept_index(vocabulary)
    rows = facts.sparkSession.createDataFrame([(c, m, k) for c, (m, k) in index.items()], "concept string, metric string, priority int")  # the configuration
    named = facts.join(F.broadcast(rows), "concept")
    best = Window.partitionBy("company_id", "metric", "period_end", "filing_date").orderBy("priority", "concept")
    return named.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "priority")


LEXICON_FLAGS = ("positive", "negative", "uncertainty", "litigious", "strong_modal", "weak_modal")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("word", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in LEXICON_FLAGS]])
    return spark.read.csv(path, header=True, comment="#", schema=schema).withColumn("word", F.lower(F.trim("word"))).where("word IS NOT NULL").dropDuplicates(["word"])
