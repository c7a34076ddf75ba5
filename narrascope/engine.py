"""Runs from manifest to exposure: the stages of a point, panels over points, the freeze, and reads over what is stored.

Tables of a point lie under ``root/run/discovery/as_of/``, those of validation beside them; discovery never reads the
latter before it is frozen, and a frozen point is not written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.operators import claims, cleaning, exposure, extraction, governance, graph, impacts, lineage, panel, panel_run, reads, sentiment, serving, textops, validation
from narrascope.operators.pit import to_day
from narrascope.sources import catalog, contracts, readers, sinks

#: Lowest weight for an edge to tie nodes in clustering is any; parallel edges add up.
STAGES = ("import_documents", "clean", "chunk", "extract", "aliases", "build_graph", "discover", "expose", "project", "read_sentiment", "read_tone", "read_claims", "evidence")


class Engine:
    """Everything that one installation keeps: ``root`` is a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, lexicon: DataFrame | None = None, facts: DataFrame | None = None, attribution=sentiment.ATTRIBUTION):
        """``lexicon``: words with flags, for the tone of chunks; ``facts``: company, period_end, metric that claims are reconciled with."""
        self.spark, self.root, self.runs = spark, root.rstrip("/"), governance.Runs(spark, root)
        self.lexicon, self.facts, self.attribution = lexicon, facts, attribution

    # ---- tables

    def path(self, run: str, as_of: str, table: str) -> str:
        return f"{self.root}/{run}/discovery/{as_of}/{table}.parquet"

    def has(self, run: str, as_of: str, table: str) -> bool:
        return catalog._exists(self.spark, self.path(run, as_of, table))

    def table(self, run: str, table: str, as_of: str | None = None) -> DataFrame:
        """A table of a point (the latest by default)."""
        point = self.runs.resolve(run, as_of)
        if not self.has(run, point, table):
            raise LookupError(f"{table} is not there for {run} at {point}; run its stage first")
        return self.spark.read.parquet(self.path(run, point, table))

    def optional(self, run: str, table: str, as_of: str) -> DataFrame:
        """A table, or an empty one of its contract."""
        return self.table(run, table, as_of) if self.has(run, as_of, table) else self.spark.createDataFrame([], contracts.schema_of(table))

    def write(self, run: str, as_of: str, table: str, df: DataFrame) -> None:
        kept = [c for c in contracts.schema_of(table).names if c in df.columns]
        sinks.write_table(df.select(*kept), contracts.schema_of(table), self.path(run, as_of, table), frozen=self.runs.is_frozen(run, as_of))

    def validation_table(self, run: str, table: str) -> DataFrame:
        catalog.guarded("validation", self.runs.is_frozen(run))
        return self.spark.read.parquet(f"{self.root}/{run}/validation/{table}.parquet")

    # ---- stages of a point

    def import_documents(self, run: str, as_of: str, manifest: str, folder: str) -> DataFrame:
        """Raw documents of a manifest, staged; returns the rows put aside, with reasons."""
        kept, aside = self._imported(as_of, manifest, folder)
        if self.runs.is_frozen(run, as_of):
            raise catalog.LeakageError("discovery is frozen")
        kept.write.mode("overwrite").parquet(self.path(run, as_of, "raw_documents"))
        return aside

    def _imported(self, as_of: str, manifest: str, folder: str) -> tuple[DataFrame, DataFrame]:
        files = readers.read_raw_files(self.spark, folder)
        contents = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("raw_path"), "text", "content_hash")
        return readers.import_manifest(readers.read_manifest(self.spark, manifest), as_of, contents)

    @staticmethod
    def _to_clean(raw: DataFrame) -> DataFrame:
        return raw.withColumnRenamed("text", "raw_text").withColumn("published_at", to_day(F.col("published_at"))).withColumn("available_at", to_day(F.col("available_at"))).withColumn("row_number", F.struct("source_id", "document_id")).drop("content_hash")

    def clean(self, run: str, as_of: str) -> None:
        rows = self._to_clean(self.table(run, "raw_documents", as_of))
        done = cleaning.clean_documents(rows, as_of).withColumn("included_in_discovery", F.col("outcome") == "included")
        self.write(run, as_of, "document_cleaning_log", cleaning.cleaning_log(done))
        self.write(run, as_of, "documents", done.drop("steps"))

    def discover_panel(self, run: str, points: list[str], manifest: str, folder: str, extractor: extraction.RuleExtractor | None = None) -> None:
        """Discovery of many points from one manifest in one plan; tables of all points lie under ``root/run/panel/``, in a folder for each day."""
        kept, _ = self._imported(max(points), manifest, folder)
        made = panel_run.discover_panel(run, self._to_clean(kept), points, extractor)
        for name, df in made.items():
            columns = [c for c in contracts.schema_of(name).names if c in df.columns]
            df.select("as_of", *columns).write.partitionBy("as_of").mode("overwrite").parquet(f"{self.root}/{run}/panel/{name}.parquet")

    def panel_table(self, run: str, table: str, as_of: str | None = None) -> DataFrame:
        """A table of ``discover_panel``: of all points with as_of, or of one."""
        df = self.spark.read.parquet(f"{self.root}/{run}/panel/{table}.parquet")
        return df if as_of is None else df.where(F.col("as_of") == F.lit(as_of).cast("date")).drop("as_of")

    def chunk(self, run: str, as_of: str) -> None:
        self.write(run, as_of, "chunks", cleaning.chunk_rows(self.table(run, "documents", as_of)))

    def extract(self, run: str, as_of: str, extractor: extraction.RuleExtractor | None = None) -> None:
        made = extraction.run_extraction(self.table(run, "chunks", as_of).select("chunk_id", "available_at", "text"), extractor)
        for name, df in made.items():
            self.write(run, as_of, name, df)

    def aliases(self, run: str, as_of: str) -> None:
        """Names of entities that have evidence known at the point."""
        known = self.table(run, "entity_chunk_provenance", as_of).where(F.col("available_at") <= F.lit(as_of).cast("date")).select("entity_id").distinct()
        entities = self.table(run, "entities", as_of).join(known, "entity_id", "left_semi").withColumn("ticker", F.lit(None).cast("string"))
        short = self.spark.createDataFrame([(long.lower(), name.upper()) for name, long in extraction.ALIASES.items()], "long_name string, short_name string")
        self.write(run, as_of, "entity_aliases", serving.alias_rows(entities, short))

    def build_graph(self, run: str, as_of: str) -> None:
        nodes, edges = exposure.build_graph(self.table(run, "entities", as_of), self.table(run, "edges", as_of), as_of)
        self.write(run, as_of, "graph_nodes", nodes)
        self.write(run, as_of, "graph_edges", edges)

    def discover(self, run: str, as_of: str) -> None:
        """Communities of companies and what they are tied to; nodes that nothing ties are communities of one."""
        nodes, edges = self.table(run, "graph_nodes", as_of), self.table(run, "graph_edges", as_of)
        typed = nodes.select(F.col("entity_id").alias("node_id"), F.col("entity_type").alias("node_type"), "first_seen")
        ties = graph.bipartite_edges(typed, edges, as_of).select(F.lit(as_of).alias("as_of"), "src", "dst", "weight")
        found = graph.communities(ties, ["as_of"]).select(F.col("node").alias("entity_id"), "community")
        top = found.agg(F.max("community")).first()[0]
        alone = typed.where(F.col("node_type").isin("Company", *graph.SPINE_TYPES)).select(F.col("node_id").alias("entity_id")).join(found, "entity_id", "left_anti")
        from narrascope import runtime

        rest = runtime.global_rank(alone, ["entity_id"], "place").select("entity_id", (F.col("place") + (-1 if top is None else top) + 1).alias("community"))
        members = runtime.staged(found.unionByName(rest).select(lineage.community_id(run, F.col("community")).alias("community"), "entity_id"), "members")
        self.write(run, as_of, "communities", members)
        inside = graph.community_metrics(members.select(F.col("entity_id").alias("node"), "community"), edges.select("src", "dst", "weight"))
        n = F.lit(max(1, nodes.count()))
        rows = inside.join(reads.theme_names(members, nodes), "community", "left").withColumn("saturation", F.round(F.col("size") / n, 6))
        self.write(run, as_of, "theme_metrics", rows.withColumn("theme_snapshot_id", lineage.snapshot_id(F.lit(as_of).cast("date"), F.col("community"))))

    def expose(self, run: str, as_of: str, weak: bool = False) -> None:
        t = lambda name: self.table(run, name, as_of)
        self.write(run, as_of, "company_theme_exposure", exposure.compute_exposure(t("entities"), t("edges"), t("graph_nodes"), t("communities"), t("theme_metrics").select("community", "theme_snapshot_id"), as_of, weak))

    def project(self, run: str, as_of: str, shock: float = impacts.SHOCK) -> None:
        self.write(run, as_of, "projected_impacts", impacts.projected_impacts(self.table(run, "graph_nodes", as_of), self.table(run, "graph_edges", as_of), as_of, shock))

    def said_chunks(self, run: str, as_of: str) -> DataFrame:
        """Chunks with the role of who speaks in them, by the type of their document and the title of their section."""
        kinds = self.table(run, "documents", as_of).select("document_id", "document_type")
        chunks = self.table(run, "chunks", as_of).join(kinds, "document_id", "left")
        return chunks.select("chunk_id", "available_at", "text", sentiment.speaker_role(F.col("document_type"), F.col("section_title"), self.attribution).alias("speaker_role"))

    def read_sentiment(self, run: str, as_of: str, extractor: sentiment.RuleSentimentExtractor | None = None) -> None:
        """What management says of companies: chunks of others are not read."""
        self.write(run, as_of, "management_sentiment", sentiment.run_sentiment(self.said_chunks(run, as_of), as_of, extractor))

    def read_tone(self, run: str, as_of: str) -> None:
        """Tone of all chunks by the lexicon, and management's readings fused with it; nothing without a lexicon."""
        if self.lexicon is None:
            return
        chunks = self.said_chunks(run, as_of)
        shares = textops.tone(chunks.select(F.col("chunk_id").alias("doc_id"), "text"), self.lexicon, list(readers.LEXICON_FLAGS)).withColumnRenamed("doc_id", "chunk_id")
        self.write(run, as_of, "chunk_tone", chunks.select("chunk_id", "available_at", "speaker_role").distinct().join(shares, "chunk_id"))
        self.write(run, as_of, "fused_sentiment", sentiment.fuse_with_tone(self.table(run, "management_sentiment", as_of), self.table(run, "chunk_tone", as_of), as_of))

    def read_claims(self, run: str, as_of: str, extractor: claims.RuleFactExtractor | None = None, facts: DataFrame | None = None) -> None:
        owner = self.table(run, "documents", as_of).select("document_id", F.col("company_id").alias("company"))
        chunks = self.table(run, "chunks", as_of).join(owner, "document_id", "left").select("chunk_id", "company", "available_at", "text")
        facts = facts if facts is not None else self.facts
        facts = facts if facts is not None else self.spark.createDataFrame([], "company string, period_end date, metric string")
        self.write(run, as_of, "financial_metrics", claims.run_facts(chunks, facts, as_of, extractor))

    def evidence(self, run: str, as_of: str) -> None:
        """Documents behind each community: those of the chunks of its members' edges known at the point."""
        members, edges = self.table(run, "communities", as_of), self.table(run, "edges", as_of)
        known = edges.where(F.col("first_seen").isNotNull() & (F.col("first_seen") <= F.lit(as_of).cast("date")))
        touching = known.select(F.explode(F.array("src", "dst")).alias("entity_id"), "evidence").join(members, "entity_id").select("community", F.explode("evidence").alias("chunk_id")).distinct()
        docs = touching.join(self.table(run, "chunks", as_of).select("chunk_id", "document_id"), "chunk_id").groupBy("community").agg(F.array_sort(F.collect_set("document_id")).alias("document_ids"))
        self.write(run, as_of, "theme_document_evidence", docs)

    def discover_point(self, run: str, as_of: str, manifest: str, folder: str) -> None:
        """All stages of a point, unless it is frozen: then it stays as it is."""
        if as_of not in self.runs.load(run)["as_of_points"]:
            self.runs.add_point(run, as_of)
        if self.runs.is_frozen(run, as_of):
            return
        self.import_documents(run, as_of, manifest, folder)
        for stage in STAGES[1:]:
            getattr(self, stage)(run, as_of)

    def build_panel(self, run: str, points: dict[str, tuple[str, str]]) -> list[str]:
        """Discovery of each point from its manifest and folder; returns the points that were worked on. Frozen ones are skipped.

        A point that fails is left where it failed, with the reason in ``panel_status``, and the others go on.
        """
        rows = []
        for as_of, (manifest, folder) in sorted(points.items()):
            if as_of in self.runs.load(run)["as_of_points"] and self.runs.is_frozen(run, as_of):
                rows.append((as_of, "skipped", "frozen"))
                continue
            try:
                self.discover_point(run, as_of, manifest, folder)
                rows.append((as_of, "done", None))
            except Exception as fault:  # noqa: BLE001 - whatever it is belongs to this point alone
                rows.append((as_of, "failed", f"{type(fault).__name__}: {str(fault).strip().splitlines()[0][:300]}" if str(fault).strip() else type(fault).__name__))
        self.spark.createDataFrame(rows, "as_of string, status string, reason string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{run}/panel_status.parquet")
        return [as_of for as_of, status, _ in rows if status == "done"]

    def panel_status(self, run: str) -> DataFrame:
        """as_of, status (done, skipped, failed) and reason of the points of the last ``build_panel``."""
        return self.spark.read.parquet(f"{self.root}/{run}/panel_status.parquet")

    def damage(self, run: str, as_of: str) -> str | None:
        """Why a point cannot take part in a panel; None if it can."""
        for name in ("communities", "theme_metrics", "graph_nodes", "company_theme_exposure"):
            if not self.has(run, as_of, name):
                return f"{name} is not there"
            try:
                lost = set(contracts.schema_of(name).names) - set(self.table(run, name, as_of).columns)
            except Exception as fault:  # noqa: BLE001 - files that Spark can't read
                return f"{name}: {str(fault).strip().splitlines()[0][:200]}"
            if lost:
                return f"{name} lacks {', '.join(sorted(lost))}"
        return None

    def freeze(self, run: str, as_of: str) -> dict:
        """Digests of a point's tables go into the manifest; all required ones must be there."""
        stored = {"graph": "graph_edges", "theme_snapshots": "theme_metrics"}
        names = [*governance.REQUIRED_ARTIFACTS, *governance.OPTIONAL_ARTIFACTS]
        return self.runs.freeze(run, as_of, {a: self.table(run, stored.get(a, a), as_of) for a in names if self.has(run, as_of, stored.get(a, a))})

    # ---- panel and validation

    def _points(self, run: str) -> list[str]:
        return [p for p in self.runs.load(run)["as_of_points"] if self.damage(run, p) is None]

    def panel_tables(self, run: str) -> dict[str, DataFrame]:
        """lineage, families, states, trajectories and the summary over the points that have themes."""
        nodes = members = exposed = None
        for i, p in enumerate(self._points(run)):
            m, metrics = self.table(run, "communities", p), self.table(run, "theme_metrics", p).where(F.col("size") >= lineage.LEAST_SIZE)
            companies = m.join(self.table(run, "graph_nodes", p).where("entity_type = 'Company'").select("entity_id"), "entity_id", "left_semi").join(metrics.select("community"), "community", "left_semi")
            rows = companies.select(F.lit(i).alias("idx"), F.col("community").alias("theme"), F.col("entity_id").alias("company"))
            themes = metrics.join(companies.select("community").distinct(), "community", "left_semi").select(F.lit(i).alias("idx"), F.lit(p).alias("as_of"), F.col("community").alias("theme"), F.col("theme_snapshot_id").alias("snapshot_id"))
            scores = self.table(run, "company_theme_exposure", p).select(F.lit(i).alias("idx"), F.col("community").alias("theme"), F.col("company_id").alias("company"), "exposure_score", "evidence_count")
            nodes, members, exposed = (x if old is None else old.unionByName(x) for old, x in ((nodes, themes), (members, rows), (exposed, scores)))
        if nodes is None:
            raise LookupError(f"no point of {run} has themes")
        found, families = lineage.family_lineage(nodes, members, run)
        points = self.spark.createDataFrame(list(enumerate(self._points(run))), "idx int, as_of string")
        states, paths = lineage.family_states(found, families, points), lineage.trajectories(exposed, found)
        return {"lineage": found, "families": families, "states": states, "trajectories": paths, "summary": lineage.panel_summary(found, families, states, paths), "points": lineage.points_summary(found, exposed, points)}

    def validate(self, run: str, as_of: str, months: list[int], top_n: int = 10) -> DataFrame:
        """Baskets of a frozen point beside the benchmarks."""
        prices = self.validation_table(run, "market_prices")
        if bad := self.runs.verify(run, as_of, {a: self.table(run, {"graph": "graph_edges", "theme_snapshots": "theme_metrics"}.get(a, a), as_of) for a in self.runs.load(run)["frozen_points"][as_of]}):
            raise catalog.LeakageError(f"changed after the freeze: {', '.join(bad)}")
        e = self.table(run, "company_theme_exposure", as_of).select(F.col("community").alias("theme"), "company_id", F.col("exposure_score").alias("exposure"))
        windows = self.spark.createDataFrame([(as_of, k) for k in months], "as_of string, months int").withColumn("as_of", F.to_date("as_of"))
        universe = e.select("company_id", F.lit(None).cast("string").alias("sector")).distinct()
        return validation.validate_snapshot(e, prices, windows, universe, [], top_n)

    def integrate_signals(self, run: str, as_of: str, series: DataFrame, specs: DataFrame, sources: DataFrame, sensitivities: DataFrame, universe: DataFrame) -> None:
        """Series nodes and their edges join the point's entities and edges; those that are there stay as they are."""
        from narrascope import runtime
        from narrascope.operators import signals

        entities, edges = (runtime.staged(self.table(run, t, as_of), t) for t in ("entities", "edges"))
        told = runtime.staged(self.table(run, "edge_explanations", as_of), "edge_explanations")
        found = signals.integrate(signals.pit_signals(series, specs, as_of), sources, sensitivities, entities.where("entity_type = 'Company'").select("entity_id", "name"), universe, as_of)
        self.write(run, as_of, "entities", reads.add_new_nodes(entities, found["nodes"]))
        self.write(run, as_of, "edges", edges.unionByName(found["edges"].join(edges.select("edge_id"), "edge_id", "left_anti"), allowMissingColumns=True))
        self.write(run, as_of, "edge_explanations", told.unionByName(found["explanations"].join(told.select("edge_id"), "edge_id", "left_anti"), allowMissingColumns=True))

    def report(self, run: str, as_of: str | None = None, validated: DataFrame | None = None, narrator=None) -> str:
        from narrascope.operators import narration

        return narration.report(self.runs.load(run), self.table(run, "theme_metrics", as_of), self.table(run, "company_theme_exposure", as_of), validated, narrator)

    # ---- reads

    def slice(self, run: str, anchor: str, as_of: str | None = None, **how) -> tuple[DataFrame, DataFrame]:
        return reads.extract_slice(self.table(run, "graph_nodes", as_of), self.table(run, "graph_edges", as_of), anchor, **how)

    def subgraph(self, run: str, communities: list[str], as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
        wanted = self.spark.createDataFrame([(c,) for c in communities], "community string")
        return reads.community_subgraph(self.table(run, "communities", as_of), wanted, self.table(run, "graph_nodes", as_of), self.table(run, "graph_edges", as_of))

    def levels(self, run: str, as_of: str | None = None) -> DataFrame:
        return reads.theme_levels(self.table(run, "communities", as_of), self.table(run, "graph_nodes", as_of), self.table(run, "theme_metrics", as_of).select("community", "strength"))

    def relevance(self, run: str, as_of: str | None = None, window_days: int = 90) -> DataFrame:
        point = self.runs.resolve(run, as_of)
        members, edges = self.table(run, "communities", point), self.table(run, "graph_edges", point)
        inside = edges.join(members.select(F.col("entity_id").alias("src"), F.col("community").alias("theme")), "src").join(members.select(F.col("entity_id").alias("dst"), F.col("community").alias("_c")), "dst").where("theme = _c").select("theme", "edge_id")
        return panel.relevance(reads.theme_evidence_days(inside, edges, self.table(run, "chunks", point)), point, window_days)

    def node_profile(self, run: str, entity: str, as_of: str | None = None) -> DataFrame:
        """Neighbours, evidence and first day of a node."""
        edges = self.table(run, "graph_edges", as_of).where((F.col("src") == entity) | (F.col("dst") == entity))
        other = F.when(F.col("src") == entity, F.col("dst")).otherwise(F.col("src"))
        return edges.select(other.alias("other"), F.explode("evidence").alias("chunk"), "first_seen").agg(F.countDistinct("other").alias("degree"), F.countDistinct("chunk").alias("n_evidence"), F.min("first_seen").alias("first_seen"))

    def company(self, run: str, company: str, as_of: str | None = None) -> dict[str, DataFrame]:
        point = self.runs.resolve(run, as_of)
        return reads.company_profile(company, self.table(run, "entities", point), self.table(run, "company_theme_exposure", point), self.table(run, "theme_metrics", point).select("community", "theme_name"), None, None, point)

    def company_evidence(self, run: str, company: str, as_of: str | None = None) -> DataFrame:
        """Best chunks of a company for each theme, with the sentence that names both."""
        rows = self.table(run, "company_theme_exposure", as_of).where(F.col("company_id") == company).select("community", "company_id", F.posexplode("top_evidence_chunk_ids").alias("place", "chunk_id"))
        names = self.table(run, "graph_nodes", as_of).select(F.col("entity_id").alias("company_id"), "label")
        themes = self.table(run, "theme_metrics", as_of).select("community", "theme_name")
        both = rows.join(self.table(run, "chunks", as_of).select("chunk_id", "document_id", "text"), "chunk_id").join(names, "company_id").join(themes, "community", "left")
        return both.select("community", "place", "chunk_id", "document_id", reads.evidence_snippet(F.col("text"), F.col("label"), F.coalesce("theme_name", F.lit(""))).alias("snippet"))

    def company_sentiment(self, run: str, company: str, as_of: str | None = None) -> DataFrame:
        return self.table(run, "management_sentiment", as_of).where(F.lower("company") == company.lower()).orderBy(F.desc("available_at"), "chunk_id")

    def documents_of(self, run: str, community: str, as_of: str | None = None) -> DataFrame:
        return reads.theme_documents(self.table(run, "theme_document_evidence", as_of), community=community)

    def chunk_source(self, run: str, chunk: str, as_of: str | None = None) -> DataFrame:
        point = self.runs.resolve(run, as_of)
        raw = self.table(run, "raw_documents", point).select("document_id", "title", "source", "source_url", "document_type", to_day(F.col("published_at")).alias("published_at"))
        documents = self.table(run, "documents", point).withColumn("raw_document_id", F.col("document_id"))
        return reads.chunk_source(self.spark.createDataFrame([(chunk,)], "chunk_id string"), self.table(run, "chunks", point), documents, raw)

    def projections(self, run: str, trigger: str | None = None, as_of: str | None = None) -> DataFrame:
        """Impacts by strength, of one trigger if asked for."""
        rows = impacts.ranked(self.table(run, "projected_impacts", as_of))
        return (rows if trigger is None else rows.where(F.col("trigger_id") == trigger)).orderBy("trigger_id", "position")

    def triggers(self, run: str, as_of: str | None = None) -> DataFrame:
        return impacts.trigger_list(self.table(run, "projected_impacts", as_of), self.table(run, "graph_nodes", as_of))

    def views(self, run: str) -> dict[str, str]:
        """Views of an analyst's session: one a table, over all points of the run."""
        out = {f"v_disc_{t}": f"{self.root}/{run}/discovery/*/{t}.parquet" for t in contracts.TABLES}
        return out | {f"{catalog.VALIDATION_PREFIX}market_prices": f"{self.root}/{run}/validation/market_prices.parquet"}

    def integrity(self, run: str, as_of: str | None = None) -> DataFrame:
        """Violations among the tables of a point."""
        point = self.runs.resolve(run, as_of)
        t = lambda name: self.table(run, name, point)
        # put-aside documents are there with their reason: only included ones are held against the day
        tables = {"documents": t("documents").where("included_in_discovery"), "chunks": t("chunks"), "entities": t("entities"), "edges": t("edges")}
        days = {"documents": ("document_id", "available_at"), "chunks": ("chunk_id", "available_at"), "entities": ("entity_id", "first_seen"), "edges": ("edge_id", "first_seen")}
        return governance.integrity_report([
            governance.check_dates(tables, days, point),
            governance.check_inheritance(tables["chunks"], tables["documents"], "document_id", "chunk_id"),
            governance.check_references([("chunks", tables["chunks"], "chunk_id", "document_id", t("documents"), "document_id"), ("edges", tables["edges"], "edge_id", "src", tables["entities"], "entity_id"), ("edges", tables["edges"], "edge_id", "dst", tables["entities"], "entity_id"), ("entity_aliases", t("entity_aliases"), "alias", "entity_id", tables["entities"], "entity_id")]),
            governance.check_evidence(tables["edges"], tables["chunks"]),
            governance.check_schemas(self.spark, {n: t(n) for n in ("chunks", "entities", "edges")}, {n: contracts.schema_of(n).names for n in ("chunks", "entities", "edges")}),
            governance.check_filled(tables, {"documents": ["document_id", "available_at"], "chunks": ["chunk_id", "available_at"], "entities": ["entity_id"], "edges": ["edge_id"]}),
            governance.check_reconciliation(t("raw_documents"), t("documents").where("included_in_discovery"), t("documents").where("NOT included_in_discovery"), "document_id"),
        ])
