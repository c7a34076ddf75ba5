"""Contract schemas of a run's tables, in column order; empty tables carry them too."""

from __future__ import annotations

from pyspark.sql import types as T

#: Tables of a point, their columns and types.
TABLES = {
    "documents": "document_id string, source string, source_id string, title string, document_type string, company_id string, raw_path string, published_at date, available_at date, clean_text string, content_hash string, outcome string, cleaning_version string, included_in_discovery boolean",
    "document_cleaning_log": "document_id string, step_order int, cleaning_step string, before_hash string, after_hash string, before_chars int, after_chars int, status string",
    "chunks": "chunk_id string, document_id string, content_hash string, available_at date, chunk_index int, text string, token_count int, start_char int, end_char int, section_title string, block_type string, table_data string",
    "entities": "entity_id string, entity_type string, name string, first_seen date, source_chunk_ids array<string>",
    "edges": "edge_id string, src string, dst string, edge_type string, confidence double, method string, direction int, first_seen date, evidence array<string>",
    "edge_explanations": "edge_id string, explanation string, chunk_id string",
    "entity_chunk_provenance": "entity_id string, chunk_id string, available_at date",
    "entity_aliases": "entity_id string, alias string, confidence double",
    "graph_nodes": "entity_id string, entity_type string, label string, first_seen date",
    "graph_edges": "edge_id string, src string, dst string, edge_type string, method string, polarity int, weight double, first_seen date, evidence array<string>",
    "communities": "community string, entity_id string",
    "theme_metrics": "community string, theme_snapshot_id string, theme_name string, size bigint, n_edges bigint, density double, strength double, saturation double, top_entities array<string>, top_companies array<string>",
    "company_theme_exposure": "as_of_date date, company_id string, theme_snapshot_id string, community string, exposure_score double, graph_distance double, edge_confidence_sum double, evidence_count bigint, top_evidence_chunk_ids array<string>, calculation_method string",
    "projected_impacts": "as_of_date date, trigger_id string, trigger_kind string, company_id string, direction int, strength double, path array<string>, n_paths bigint, contributing_edge_ids array<string>, evidence_chunk_ids array<string>, confidence double, method string",
    "management_sentiment": "chunk_id string, available_at date, company string, direction string, confidence_tone string, hedging boolean, forward_stance string, confidence double",
    "chunk_tone": "chunk_id string, available_at date, speaker_role string, token_count bigint, positive double, negative double, uncertainty double, litigious double, strong_modal double, weak_modal double",
    "fused_sentiment": "chunk_id string, company string, direction string, confidence_tone string, hedging boolean, forward_stance string, confidence double, tone_day date, positive double, negative double, uncertainty double, lm_direction string, agreement string, fused_tone string, fused_confidence double",
    "financial_metrics": "company string, metric string, period string, is_guidance boolean, value double, unit string, direction string, confidence double, chunks array<string>, period_end date",
    "theme_document_evidence": "community string, document_ids array<string>",
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
