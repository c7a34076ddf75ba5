"""Integrity checks as tables of violations, runs and their points, freeze manifests, configuration."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.operators.evidence import table_digest

VIOLATION = ["check_name", "table_name", "key", "detail"]


def _violations(rows: DataFrame, check: str, table: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), key.cast("string").alias("key"), detail.alias("detail"))


def check_dates(tables: dict[str, DataFrame], days: dict[str, tuple[str, str]], as_of: str) -> DataFrame | None:
    """Rows dated after ``as_of``. ``days``: table -> (key, day column)."""
    found = [_violations(tables[t].where(F.col(day) > F.lit(as_of).cast("date")), "PIT_NO_LEAKAGE", t, F.col(key), F.concat(F.lit(f"{day} "), F.col(day).cast("string"))) for t, (key, day) in days.items() if t in tables]
    return _union(found)


def check_inheritance(child: DataFrame, parent: DataFrame, key: str, own: str, day: str = "available_at") -> DataFrame:
    """Children whose day is not that of their parent."""
    both = child.join(parent.select(key, F.col(day).alias("_day")), key)
    return _violations(both.where(~F.col(day).eqNullSafe(F.col("_day"))), "PIT_NO_LEAKAGE", "chunks", F.col(own), F.lit("day differs from that of its document"))


def check_references(links: list[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame | None:
    """Rows that refer to nothing: (table, rows, key, reference, target, target key). Null and empty references are none; an empty target is not held against."""
    found = []
    for table, rows, key, ref, target, to in links:
        if not target.limit(1).count():
            continue
        asked = rows.where(F.coalesce(F.col(ref).cast("string"), F.lit("")) != "")
        missing = asked.join(target.select(F.col(to).alias("_to")).distinct(), F.col(ref) == F.col("_to"), "left_anti")
        found.append(_violations(missing, "REFERENTIAL_INTEGRITY", table, F.col(key), F.concat(F.lit(f"{ref} "), F.col(ref).cast("string"))))
    return _union(found)


def check_evidence(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that stated edges name and that are not there."""
    named = edges.where("method = 'document_stated'").select("edge_id", F.explode("evidence").alias("chunk_id"))
    missing = named.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return _violations(missing, "REFERENTIAL_INTEGRITY", "edges", F.col("edge_id"), F.concat(F.lit("evidence "), F.col("chunk_id").cast("string")))


def check_schemas(spark: SparkSession, tables: dict[str, DataFrame], contracts: dict[str, list[str]]) -> DataFrame:
    """Columns that a table lacks or has beyond its contract; driver work on names."""
    rows = []
    for t, want in contracts.items():
        if t in tables:
            have = set(tables[t].columns)
            rows += [("SCHEMA_CONFORMANCE", t, c, "missing column") for c in sorted(set(want) - have)]
            rows += [("SCHEMA_CONFORMANCE", t, c, "unexpected column") for c in sorted(have - set(want))]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in VIOLATION))


def check_filled(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame | None:
    """Null or blank values of required columns; the first of them is the key."""
    found = []
    for t, columns in required.items():
        if t in tables:
            bare = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
            found += [_violations(tables[t].where(bare(c)), "NON_NULL", t, F.coalesce(F.col(columns[0]).cast("string"), F.lit("")), F.lit(f"{c} is empty")) for c in columns]
    return _union(found)


def check_reconciliation(raw: DataFrame, included: DataFrame, quarantined: DataFrame, key: str) -> DataFrame:
    """Raw documents that are neither included nor quarantined."""
    seen = included.select(key).unionByName(quarantined.select(key)).distinct()
    return _violations(raw.join(seen, key, "left_anti"), "RECONCILIATION", "raw_documents", F.col(key), F.lit("dropped without a reason"))


def _union(found: list[DataFrame]) -> DataFrame | None:
    out = None
    for x in found:
        out = x if out is None else out.unionByName(x)
    return out


def integrity_report(checks: list[DataFrame | None]) -> DataFrame:
    """All violations of a suite."""
    return _union([c for c in checks if c is not None])


#: Artifacts that a freeze needs, and those it takes along.
REQUIRED_ARTIFACTS = "raw_documents documents document_cleaning_log chunks entities edges entity_aliases graph communities theme_snapshots theme_metrics company_theme_exposure".split()
OPTIONAL_ARTIFACTS = "management_sentiment management_sentiment_fused financial_metrics projected_impacts theme_hierarchy theme_relevance".split()


def to_freeze(present: list[str]) -> list[str]:
    """Required artifacts, which must all be there, and optional ones that are, each once."""
    missing = [a for a in REQUIRED_ARTIFACTS if a not in present]
    if missing:
        raise ValueError(f"cannot freeze without {', '.join(missing)}")
    return list(dict.fromkeys([*REQUIRED_ARTIFACTS, *[a for a in OPTIONAL_ARTIFACTS if a in present]]))


class Runs:
    """Run manifests as one small JSON file a run, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _write(self, run_id: str, manifest: dict) -> None:
        files, path = self._path(f"{self.root}/{run_id}/run_manifest.json")
        out = files.create(path, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()

    def create(self, as_of: str, inputs: list[str], code_version: str, now: dt.datetime) -> str:
        """A run with its id, the hash of its inputs and an empty list of frozen points."""
        digest = hashlib.sha256("\n".join(sorted(inputs)).encode()).hexdigest()
        run_id = f"run_{now:%Y%m%d_%H%M%S}_{digest[:6]}"
        self._write(run_id, {"run_id": run_id, "as_of_date": as_of, "created_at": f"{now:%Y-%m-%dT%H:%M:%SZ}", "input_hash": digest, "code_version": code_version, "frozen_points": {}, "as_of_points": [as_of]})
        return run_id

    def load(self, run_id: str) -> dict:
        files, path = self._path(f"{self.root}/{run_id}/run_manifest.json")
        if not files.exists(path):
            raise KeyError(f"run not found: {run_id}")
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.root}/{run_id}/run_manifest.json").collect()[0][1])

    def add_point(self, run_id: str, as_of: str) -> None:
        manifest = self.load(run_id)
        manifest["as_of_points"] = sorted({*manifest["as_of_points"], as_of})
        self._write(run_id, manifest)

    def listing(self) -> DataFrame:
        """All runs, the newest first: run_id, as_of_date, created_at, n_points, n_frozen, latest, frozen."""
        schema = "run_id string, as_of_date string, created_at string, input_hash string, code_version string, as_of_points array<string>, frozen_points map<string, map<string, array<string>>>"
        files, path = self._path(f"{self.root}/*/run_manifest.json")
        if not files.globStatus(path):
            return self.spark.createDataFrame([], "run_id string, as_of_date string, created_at string, n_points int, n_frozen int, latest string, frozen boolean")
        m = self.spark.read.schema(schema).json(f"{self.root}/*/run_manifest.json", multiLine=True)
        n, k = F.size("as_of_points"), F.size(F.map_keys("frozen_points"))
        return m.select("run_id", "as_of_date", "created_at", n.alias("n_points"), k.alias("n_frozen"), F.array_max("as_of_points").alias("latest"), (n == k).alias("frozen")).orderBy(F.desc("created_at"), "run_id")

    def resolve(self, run_id: str, as_of: str | None = None) -> str:
        """The point asked for, which must be there, or the latest."""
        points = self.load(run_id)["as_of_points"]
        if as_of is not None and as_of not in points:
            raise KeyError(f"no point {as_of} in {run_id}")
        return as_of or max(points)

    def freeze(self, run_id: str, as_of: str, artifacts: dict[str, DataFrame]) -> dict[str, list[str]]:
        """Digests of a point's artifacts go into the manifest; a frozen point stays as it is."""
        manifest = self.load(run_id)
        if as_of not in manifest["frozen_points"]:
            names = to_freeze(list(artifacts))
            manifest["frozen_points"][as_of] = {a: [str(x) for x in table_digest(artifacts[a]).first()] for a in names}
            self._write(run_id, manifest)
        return manifest["frozen_points"][as_of]

    def is_frozen(self, run_id: str, as_of: str | None = None) -> bool:
        """A point, or all points of the run."""
        m = self.load(run_id)
        return as_of in m["frozen_points"] if as_of else set(m["as_of_points"]) == set(m["frozen_points"])

    def verify(self, run_id: str, as_of: str, artifacts: dict[str, DataFrame]) -> list[str]:
        """Artifacts that differ from what was frozen."""
        frozen = self.load(run_id)["frozen_points"][as_of]
        return [a for a, digest in frozen.items() if a not in artifacts or [str(x) for x in table_digest(artifacts[a]).first()] != digest]


#: Artifacts that may be served, by extension.
SERVED = {"csv": ("validation",), "json": ("graph", "communities", "theme_snapshots", "theme_hierarchy"), "md": ("report",), "parquet": tuple(a for a in (*REQUIRED_ARTIFACTS, *OPTIONAL_ARTIFACTS) if a != "graph")}


def serve(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An artifact by its name, if it is one that may be served; paths that lead elsewhere are refused."""
    stem, _, kind = name.rpartition(".")
    if "/" in name or ".." in name or stem not in SERVED.get(kind, ()):
        raise PermissionError(f"not served: {name}")
    path = f"{folder.rstrip('/')}/{name}"
    if kind == "parquet":
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True) if kind == "csv" else spark.read.json(path, multiLine=True) if kind == "json" else spark.read.text(path, wholetext=True)


def call_log(calls: DataFrame) -> DataFrame:
    """Model calls by task and model: number, failures, cache hits, mean latency."""
    return calls.groupBy("task", "model").agg(F.count("*").alias("n_calls"), F.sum((~F.col("success")).cast("long")).alias("n_failed"), F.sum(F.col("cache_hit").cast("long")).alias("n_cached"), F.round(F.avg("latency_ms"), 3).alias("mean_latency_ms"))
