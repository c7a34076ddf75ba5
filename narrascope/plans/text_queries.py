"""Queries on documents, pages, conversations and what rules find in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrascope.functions.ids import edge_id, entity_id
from narrascope.operators import cleaning, evidence, linking, sentiment, textops
from narrascope.plans import mapping as m

#: An invented lexicon of the contract's shape.
LEXICON = (("the", 1, 0, 0), ("and", 1, 0, 0), ("of", 0, 1, 0), ("in", 0, 1, 0), ("or", 0, 0, 1), ("un", 0, 0, 1), ("de", 1, 0, 0), ("der", 0, 1, 0))
CATEGORIES = ["positive", "negative", "uncertainty"]
RULES = [("Company", "Alpha", r"(^|[^\p{L}])(the|The)([^\p{L}]|$)"), ("EconomicConcept", "Beta", r"(^|[^\p{L}])(and|And)([^\p{L}]|$)"), ("Commodity", "Gamma", r"(^|[^\p{L}])(la|La)([^\p{L}]|$)"), ("MacroIndicator", "Delta", r"(^|[^\p{L}])(der|Der)([^\p{L}]|$)"), ("Company", "Epsilon", r"(^|[^\p{L}])(is|Is)([^\p{L}]|$)"), ("Event", "Zeta", r"\d{3}")]


def content_dedup_quarantine(spark, d):
    docs = m.documents(spark, d).withColumn("source", F.when(F.col("doc_id") % 97 != 0, F.col("source")))
    return evidence.quarantine(docs, "2024-10-31")


def whitespace_normalise(spark, d):
    return m.documents(spark, d).select("doc_id", F.sha2(textops.normal_whitespace(F.col("text")), 256).alias("text_sha256"))


def page_number_strip(spark, d):
    docs = m.documents(spark, d).withColumn("text", F.concat("text", F.lit("\n"), F.col("doc_id").cast("string"), F.lit("\n- "), F.col("doc_id") % 7, F.lit(" -\n3 / 10\n123456\nPage 2 of 3\npage 7\nend")))
    return docs.select("doc_id", F.sha2(cleaning.without_page_lines(F.col("text")), 256).alias("text_sha256"))


def repeated_lines(spark, d):
    return textops.repeated_line_counts(m.documents(spark, d))


def sentence_split(spark, d):
    s = textops.sentences(F.col("text"))
    return m.documents(spark, d).select("doc_id", F.size(s).alias("n_sentences"), F.sha2(F.array_join(s, "|"), 256).alias("sentences_sha256"))


def chunk_pack(spark, d):
    return textops.chunk_documents(m.documents(spark, d)).select("doc_id", "chunk_index", "start", "end", F.sha2("text", 256).alias("chunk_sha256"))


def html_text(spark, d):
    return textops.html_to_text(m.table(spark, d, "pages")).select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def token_counts(spark, d):
    return m.documents(spark, d).select("doc_id", F.size(textops.tokens(F.col("text"))).alias("n_tokens"))


KINDS_OF_DOCUMENTS = ("Form 10-K", "NEWS_article", "sell-side note", "Research", "transcript of a call", "", "Annual Report 2023")
SECTIONS = ("Item 7. MD&A", "Questions", "Outlook for 2024", "Risk factors", "The CEO's letter", "")


def tone_vector(spark, d):
    lexicon = spark.createDataFrame(LEXICON, "word string, positive int, negative int, uncertainty int")
    return textops.tone(m.documents(spark, d), lexicon, CATEGORIES)


def speaker_role(spark, d):
    t = m.table(spark, d, "conversations")
    role = F.when(F.col("role") == "assistant", "management").when(F.lower("text").contains("question") | (F.col("role") == "user"), "analyst").otherwise("operator")
    return t.select("conv_id", "turn", role.alias("speaker_role")).groupBy("conv_id", "speaker_role").agg(F.count("*").alias("n"))


def attributed_orders(spark, d):
    """Orders as chunks: types by priority, section titles by status."""
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS_OF_DOCUMENTS]), (F.col("o_orderkey") % len(KINDS_OF_DOCUMENTS) + 1).cast("int"))
    section = F.element_at(F.array(*[F.lit(x) for x in SECTIONS]), (F.col("o_custkey") % len(SECTIONS) + 1).cast("int"))
    o = m.table(spark, d, "orders").select("o_orderkey", sentiment.speaker_role(kind, section).alias("speaker_role"), "o_orderpriority")
    return o.groupBy("speaker_role", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def negation_sentiment(spark, d):
    rows = m.documents(spark, d).select("doc_id", "text")
    return sentiment.score_sentiment(rows).drop("text")


def fusion_matrix(spark, d):
    """Directions by id beside the tone of each text, so that every pair of the matrix occurs."""
    directions = F.array(*[F.lit(x) for x in ("positive", "negative", "neutral", "mixed")])
    rows = tone_vector(spark, d).withColumn("direction", F.element_at(directions, (F.col("doc_id") % 4 + 1).cast("int"))).withColumn("confidence", F.lit(0.6) + (F.col("doc_id") % 7) * 0.05)
    return textops.fuse(rows).select("doc_id", "lm_direction", "agreement", "fused_tone", "fused_confidence")


def _chunks(spark, d):
    return m.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "available_at", "text")


def rule_entities(spark, d):
    return evidence.match_rules(_chunks(spark, d), RULES).select("chunk_id", "entity_type", "name")


def cooccurrence_edges(spark, d):
    return evidence.cooccurrences(evidence.match_rules(_chunks(spark, d), RULES))


def entity_rollup(spark, d):
    return evidence.rollup_entities(evidence.match_rules(_chunks(spark, d), RULES))


def linked_names(spark, d):
    """Names of two to four words out of the benchmark's texts, and those of parts, in all documents."""
    b = m.table(spark, d, "benchmark").select("item_id", textops.tokens(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 4), F.lit(4))
    cut = F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i, 2 + F.pmod(i, F.lit(3))), " "))
    names = b.where("size(w) >= 5").select(F.explode(cut).alias("alias"), F.concat(F.lit("b"), F.lpad(F.col("item_id").cast("string"), 9, "0")).alias("entity_id"))
    parts = m.table(spark, d, "part").select(F.col("p_name").alias("alias"), F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("entity_id"))
    return linking.link_aliases(m.table(spark, d, "documents"), names.unionByName(parts)).select("doc_id", "place", "n_words", "alias", "entity_id")


def stable_ids(spark, d):
    s = m.table(spark, d, "supplier")
    a, b = entity_id(F.lit("Company"), F.col("s_name")), entity_id(F.lit("EconomicConcept"), F.concat(F.lit("nation "), F.col("s_nationkey")))
    return s.select("s_suppkey", a.alias("entity_id"), edge_id(a, b, F.lit("exposed_to")).alias("edge_id"))


def alias_groups(spark, d):
    names = m.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("name"))
    groups = m.table(spark, d, "nation").select(F.col("n_regionkey").alias("group_id"), F.col("n_name").alias("name"))
    return evidence.alias_groups(names, groups)


def _edges(spark, d):
    lines = m.table(spark, d, "lineitem")
    # chunks are the documents of the table, whatever their number
    n = F.broadcast(m.table(spark, d, "documents").agg(F.greatest(F.lit(1), F.count("*")).alias("_n")))
    return lines.join(n).groupBy(F.col("l_suppkey").alias("edge_id")).agg(F.collect_set((F.col("l_partkey") % F.col("_n")).alias("c")).alias("evidence"))


def evidence_join(spark, d):
    chunks = m.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "source", "available_at")
    rows = evidence.join_evidence(_edges(spark, d), chunks)
    return rows.groupBy("edge_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("source").alias("n_sources"), F.min("available_at").alias("first_seen"))


def evidence_sets(spark, d):
    """Distinct sorted chunks that touch any member of a community (supplier nation)."""
    member = m.table(spark, d, "supplier").select(F.col("s_suppkey").alias("edge_id"), F.col("s_nationkey").alias("community"))
    rows = _edges(spark, d).join(member, "edge_id").select("community", F.explode("evidence").alias("chunk_id"))
    return rows.groupBy("community").agg(F.array_sort(F.collect_set("chunk_id")).alias("ids")).select("community", F.size("ids").alias("n_chunks"), F.array_join(F.transform(F.slice("ids", 1, 10), lambda x: x.cast("string")), ",").alias("first_ids"))


def anti_reconcile(spark, d):
    o = m.table(spark, d, "orders")
    claims = o.select(F.col("o_custkey").alias("company"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderstatus").alias("metric"), (F.col("o_orderkey") % 11 == 0).alias("is_guidance"))
    facts = o.where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("company"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderstatus").alias("metric"))
    return evidence.reconcile_claims(claims, facts, ["company", "period", "metric"]).groupBy("metric", "is_guidance").agg(F.count("*").alias("n"))


def synonym_remap(spark, d):
    edges = m.links(spark, d).withColumn("weight", (F.length("src") + F.length("dst")) / 10.0)
    syn = m.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("member"), F.concat(F.lit("s"), F.col("s_suppkey") - 1).alias("representative"))
    return evidence.remap(edges, syn).select("src", "dst", F.round("weight", 6).alias("weight"))


def integrity_orphans(spark, d):
    lines = m.table(spark, d, "lineitem").select((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 100000000).otherwise(0)).alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    a = evidence.orphans(lines.select("o_orderkey"), m.table(spark, d, "orders"), "o_orderkey", "line_without_order")
    return a.unionByName(evidence.orphans(lines.select("s_suppkey"), m.table(spark, d, "supplier").where("s_suppkey % 10 != 0"), "s_suppkey", "line_without_supplier"))


def integrity_reconcile(spark, d):
    """raw = included + quarantined, by language."""
    raw = m.documents(spark, d).select("doc_id", "lang")
    out = content_dedup_quarantine(spark, d)
    rows = raw.join(out, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n_raw"), F.sum((F.col("outcome") == "included").cast("long")).alias("n_included"), F.sum((F.col("outcome") != "included").cast("long")).alias("n_quarantined"))
    return rows.withColumn("dropped", F.col("n_raw") - F.col("n_included") - F.col("n_quarantined"))


def sentiment_summary(spark, d):
    rows = fusion_matrix(spark, d).join(m.documents(spark, d).select("doc_id", "source"), "doc_id")
    s = rows.groupBy("source").agg(F.count("*").alias("n"), *[F.sum((F.col("lm_direction") == x).cast("long")).alias(x) for x in ("positive", "negative", "neutral", "uncertainty")], F.bool_or(F.col("agreement") == "conflict").alias("any_conflict"))
    order = F.array(*[F.struct(F.col(x).alias("n"), F.lit(-k).alias("k"), F.lit(x).alias("tone")) for k, x in enumerate(("positive", "negative", "neutral", "uncertainty"))])
    return s.withColumn("dominant", F.array_max(order)["tone"])


def json_props(spark, d):
    e = m.table(spark, d, "events").select("event_type", F.from_json("props", "MAP<STRING,BIGINT>").alias("p"))
    return e.select("event_type", F.explode("p").alias("key", "value")).groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def union_by_name(spark, d):
    a = m.table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = m.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind", "segment").agg(F.count("*").alias("n"), F.countDistinct("nation").alias("n_nations"))


_ENT = "(" + " UNION ALL ".join(f"SELECT doc_id AS chunk_id, available_at, '{t}' AS entity_type, '{n}' AS name FROM {m.DOCS_SQL} d WHERE regexp_matches(text, '{p}')" for t, n, p in RULES) + ")"
_TOK = "list_filter(string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}_\\-]', ' ', 'g')), ' '), lambda t: t <> '')"
_LEX = "(VALUES " + ", ".join(f"('{w}', {a}, {b}, {c})" for w, a, b, c in LEXICON) + ") l(word, positive, negative, uncertainty)"
_TONE = f"""(SELECT doc_id, count(*) AS token_count, {", ".join(f"round(sum(coalesce({c}, 0)) / count(*), 6) AS {c}" for c in CATEGORIES)} FROM (SELECT doc_id, unnest({_TOK}) AS word FROM documents) LEFT JOIN {_LEX} USING (word) GROUP BY doc_id)"""
_FUSE = f"""(SELECT doc_id, lm_direction, agreement, CASE agreement WHEN 'conflict' THEN 'negative' WHEN 'hedged' THEN 'hedged' ELSE direction END AS fused_tone, round(confidence * CASE agreement WHEN 'conflict' THEN 0.5 WHEN 'hedged' THEN 0.75 ELSE 1.0 END, 6) AS fused_confidence FROM (
 SELECT *, CASE direction WHEN 'positive' THEN CASE lm_direction WHEN 'negative' THEN 'conflict' WHEN 'positive' THEN 'agree' ELSE 'hedged' END WHEN 'negative' THEN CASE lm_direction WHEN 'positive' THEN 'conflict' WHEN 'neutral' THEN 'hedged' ELSE 'agree' END
   WHEN 'mixed' THEN 'hedged' ELSE CASE lm_direction WHEN 'neutral' THEN 'agree' ELSE 'hedged' END END AS agreement FROM (
  SELECT doc_id, CASE WHEN greatest(uncertainty, negative, positive) <= 0.005 THEN 'neutral' WHEN uncertainty = greatest(uncertainty, negative, positive) THEN 'uncertainty' WHEN negative = greatest(uncertainty, negative, positive) THEN 'negative' ELSE 'positive' END AS lm_direction,
   ['positive', 'negative', 'neutral', 'mixed'][doc_id % 4 + 1] AS direction, 0.6::DOUBLE + (doc_id % 7) * 0.05::DOUBLE AS confidence FROM {_TONE} t)))"""
_Q = """(SELECT doc_id, coalesce(gate, CASE WHEN n > 1 THEN 'duplicate' END, 'included') AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY gate IS NULL, text ORDER BY doc_id) AS n FROM (
 SELECT doc_id, text, CASE WHEN source IS NULL OR doc_id % 97 = 0 THEN 'missing_metadata' WHEN available_at > DATE '2024-10-31' THEN 'future_document' END AS gate FROM """ + m.DOCS_SQL + " d)))"
_WS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
_SENT = "list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(31), 'g'), '\\n{2,}', chr(31), 'g'), chr(31)), lambda s: length(trim(s)) > 0)"
_EV = "(SELECT DISTINCT l_suppkey AS edge_id, l_partkey % (SELECT greatest(1, count(*)) FROM documents) AS chunk_id FROM lineitem)"

SQL = {
    "content_dedup_quarantine": f"SELECT doc_id, outcome FROM {_Q} q",
    "whitespace_normalise": f"SELECT doc_id, sha256({_WS}) AS text_sha256 FROM documents",
    "page_number_strip": r"SELECT doc_id, sha256(array_to_string(list_filter(string_split(text || chr(10) || doc_id || chr(10) || '- ' || (doc_id % 7) || ' -' || chr(10) || '3 / 10' || chr(10) || '123456' || chr(10) || 'Page 2 of 3' || chr(10) || 'page 7' || chr(10) || 'end', chr(10)), lambda x: NOT (regexp_matches(x, '^\s*[-—]?\s*\d+\s*[-—]?\s*$') OR regexp_matches(x, '^\s*page\s+\d+(\s+of\s+\d+)?\s*$', 'i') OR regexp_matches(x, '^\s*\d+\s*/\s*\d+\s*$'))), chr(10))) AS text_sha256 FROM documents",
    "repeated_lines": "SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE length(line) > 0 AND length(line) <= 80 GROUP BY ALL HAVING count(*) >= 3",
    "sentence_split": f"SELECT doc_id, len({_SENT})::INT AS n_sentences, sha256(array_to_string({_SENT}, '|')) AS sentences_sha256 FROM documents",
    "token_counts": f"SELECT doc_id, len({_TOK})::INT AS n_tokens FROM documents",
    "tone_vector": f"SELECT * FROM {_TONE} t",
    "attributed_orders": f"""WITH t AS (SELECT o_orderkey, o_orderpriority, lower({list(KINDS_OF_DOCUMENTS)}[(o_orderkey % {len(KINDS_OF_DOCUMENTS)} + 1)::INT]) AS k, lower(['Item 7. MD&A', 'Questions', 'Outlook for 2024', 'Risk factors', 'The CEO''s letter', ''][(o_custkey % {len(SECTIONS)} + 1)::INT]) AS s FROM orders)
SELECT CASE WHEN regexp_matches(k, '10-k|10-q|40-f|20-f|annual report|annual_report|earnings_transcript|earnings transcript|mda') OR regexp_matches(s, 'management|md&a|discussion and analysis|ceo|chief executive|outlook|forward-looking') THEN 'management'
 WHEN regexp_matches(k, 'news|press_release|press release') THEN 'media' WHEN regexp_matches(k, 'analyst_report|analyst report|research|sell-side|sellside') THEN 'analyst' ELSE 'unknown' END AS speaker_role, o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM t GROUP BY ALL""",
    "speaker_role": "SELECT conv_id, CASE WHEN role = 'assistant' THEN 'management' WHEN contains(lower(text), 'question') OR role = 'user' THEN 'analyst' ELSE 'operator' END AS speaker_role, count(*) AS n FROM conversations GROUP BY ALL",
    "fusion_matrix": f"SELECT * FROM {_FUSE} f",
    "rule_entities": f"SELECT chunk_id, entity_type, name FROM {_ENT} e",
    "cooccurrence_edges": f"SELECT a.name AS name_a, b.name AS name_b, count(*) AS n_chunks FROM {_ENT} a JOIN {_ENT} b ON a.chunk_id = b.chunk_id AND a.name < b.name AND a.entity_type <> b.entity_type GROUP BY ALL",
    "entity_rollup": f"SELECT 'ent_' || substr(sha256('entity:' || entity_type || ':' || lower(name)), 1, 16) AS entity_id, entity_type, lower(name) AS name, min(available_at) AS first_seen, count(DISTINCT chunk_id) AS n_chunks FROM {_ENT} e GROUP BY entity_type, lower(name)",
    "linked_names": r"""WITH RECURSIVE b AS (SELECT item_id, list_filter(string_split(lower(regexp_replace(text, '[^\p{L}\p{N}_\-]', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark),
 a AS (SELECT alias, min(entity_id) AS entity_id, len(string_split(alias, ' ')) AS n FROM (SELECT array_to_string(w[i:i + 1 + i % 3], ' ') AS alias, 'b' || lpad(item_id::VARCHAR, 9, '0') AS entity_id FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1, 4)) AS i FROM b WHERE len(w) >= 5)
  UNION ALL SELECT lower(p_name), 'p' || lpad(p_partkey::VARCHAR, 9, '0') FROM part) GROUP BY alias),
 t AS (SELECT doc_id, list_filter(string_split(lower(regexp_replace(text, '[^\p{L}\p{N}_\-]', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
 l AS (SELECT DISTINCT n FROM a), x AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM t, l WHERE len(w) >= n),
 g AS (SELECT doc_id, i - 1 AS place, n, array_to_string(w[i:i + n - 1], ' ') AS alias FROM x),
 f AS (SELECT doc_id, place, max(g.n) AS n, arg_max(alias, g.n) AS alias, arg_max(entity_id, g.n) AS entity_id FROM g JOIN a USING (alias) GROUP BY doc_id, place),
 r AS (SELECT doc_id, min(place) AS place, arg_min(n, place) AS n FROM f GROUP BY doc_id UNION ALL SELECT r.doc_id, min(f.place), arg_min(f.n, f.place) FROM r JOIN f ON f.doc_id = r.doc_id AND f.place >= r.place + r.n GROUP BY r.doc_id)
SELECT doc_id, place::INT AS place, n::INT AS n_words, alias, entity_id FROM r JOIN f USING (doc_id, place, n)""",
    "stable_ids": "SELECT s_suppkey, a AS entity_id, 'edge_' || substr(sha256('edge:' || a || ':' || b || ':exposed_to'), 1, 16) AS edge_id FROM (SELECT s_suppkey, 'ent_' || substr(sha256('entity:Company:' || lower(s_name)), 1, 16) AS a, 'ent_' || substr(sha256('entity:EconomicConcept:nation ' || s_nationkey), 1, 16) AS b FROM supplier)",
    "alias_groups": "SELECT DISTINCT 'n' || a.n_nationkey AS entity_id, b.n_name AS alias FROM nation a JOIN nation b USING (n_regionkey) WHERE lower(a.n_name) <> lower(b.n_name)",
    "evidence_join": f"SELECT edge_id, count(*) AS n_chunks, count(DISTINCT source) AS n_sources, min(available_at) AS first_seen FROM {_EV} e JOIN {m.DOCS_SQL} d ON doc_id = chunk_id GROUP BY edge_id",
    "evidence_sets": f"SELECT s_nationkey AS community, len(ids)::INT AS n_chunks, array_to_string(ids[1:10], ',') AS first_ids FROM (SELECT s_nationkey, list_sort(list(DISTINCT chunk_id)) AS ids FROM {_EV} e JOIN supplier ON edge_id = s_suppkey GROUP BY 1)",
    "anti_reconcile": "WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS period FROM orders) SELECT o_orderstatus AS metric, o_orderkey % 11 = 0 AS is_guidance, count(*) AS n FROM o WHERE o_orderkey % 11 = 0 OR NOT EXISTS (SELECT 1 FROM o f WHERE f.o_orderpriority LIKE '1%' AND f.o_custkey = o.o_custkey AND f.period = o.period AND f.o_orderstatus = o.o_orderstatus) GROUP BY ALL",
    "synonym_remap": f"SELECT src, dst, round(max(w), 6) AS weight FROM (SELECT CASE WHEN k % 3 = 0 THEN 's' || (k - 1) ELSE src END AS src, dst, (length(src) + length(dst)) / 10.0 AS w FROM (SELECT *, substr(src, 2)::BIGINT AS k FROM {m.LINKS_SQL} x)) GROUP BY ALL",
    "integrity_orphans": "SELECT DISTINCT 'line_without_order' AS check_name, k::VARCHAR AS key FROM (SELECT l_orderkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END AS k FROM lineitem) WHERE k NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT DISTINCT 'line_without_supplier', l_suppkey::VARCHAR FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0)",
    "integrity_reconcile": f"SELECT lang, n_raw, n_included, n_quarantined, n_raw - n_included - n_quarantined AS dropped FROM (SELECT lang, count(*) AS n_raw, count(*) FILTER (outcome = 'included') AS n_included, count(*) FILTER (outcome <> 'included') AS n_quarantined FROM documents LEFT JOIN {_Q} q USING (doc_id) GROUP BY lang)",
    "sentiment_summary": f"SELECT source, n, positive, negative, neutral, uncertainty, any_conflict, CASE greatest(positive, negative, neutral, uncertainty) WHEN positive THEN 'positive' WHEN negative THEN 'negative' WHEN neutral THEN 'neutral' ELSE 'uncertainty' END AS dominant FROM (SELECT source, count(*) AS n, count(*) FILTER (lm_direction = 'positive') AS positive, count(*) FILTER (lm_direction = 'negative') AS negative, count(*) FILTER (lm_direction = 'neutral') AS neutral, count(*) FILTER (lm_direction = 'uncertainty') AS uncertainty, bool_or(agreement = 'conflict') AS any_conflict FROM {_FUSE} f JOIN documents USING (doc_id) GROUP BY source)",
    "json_props": "SELECT event_type, key, count(*) AS n, sum((props ->> key)::BIGINT)::BIGINT AS total FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL",
    "union_by_name": "SELECT kind, segment, count(*) AS n, count(DISTINCT nation) AS n_nations FROM (SELECT 'customer' AS kind, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_nationkey AS nation, 'supplier' AS kind FROM supplier) GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in [*SQL, "chunk_pack", "html_text", "negation_sentiment"]}
