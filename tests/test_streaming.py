"""Streams."""

from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.streaming import intake


def test_appended_rows_are_kept_in_files_not_on_the_driver(spark, tmp_path):
    texts = ["a", "b", "a", None, "c", None]
    spark.createDataFrame([(t, f"l{ord(t or '-')}") for t in texts], "text string, lang string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, lang string").parquet(str(tmp_path / "in")).withColumn("available_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    out = intake.drain(spark, intake.first_documents(stream).select("text", "lang"), "kept_first", runtime.fresh_path(spark, "stream"), "append")
    assert sorted((r["text"] or "", r["lang"]) for r in out.collect()) == [("", "l45"), ("a", "l97"), ("b", "l98"), ("c", "l99")]
    assert out.inputFiles()  # a table in memory is of rows that were sent to the driver


def test_a_text_in_several_languages_counts_for_the_least(spark, tmp_path):
    from narrascope.plans import source_queries

    rows = [("a", "fr"), ("a", "en"), ("b", "fr"), ("b", "fr"), ("c", None), ("c", "es"), ("d", None), (None, "fr"), (None, "de"), ("", "it")]
    for k in (1, -1):  # whichever row is read first
        d = tmp_path / f"in{k}"
        spark.createDataFrame([(i, *r) for i, r in enumerate(rows[::k])], "doc_id long, text string, lang string").coalesce(1).write.parquet(str(d / "documents.parquet"))
        got = {r["lang"]: r["n_texts"] for r in source_queries.stream_first_documents(spark, str(d)).collect()}
        assert got == {"en": 1, "fr": 1, "es": 1, "de": 1, "it": 1, None: 1}
