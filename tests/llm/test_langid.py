"""Language identification in small batches."""

from __future__ import annotations

from flowquarry.llm import langid


def test_texts_go_to_workers_in_small_batches(spark, monkeypatch):
    key, seen, written = "spark.sql.execution.arrow.maxRecordsPerBatch", [], langid.materialise
    monkeypatch.setattr(langid, "materialise", lambda df: seen.append((df.columns, spark.conf.get(key))) or written(df))
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(d, f"the cat sat {d}" if d % 2 else f"der hund lief {d}", "en" if d % 2 else "de") for d in range(60)] + [(90, None, None)], "doc_id long, text string, lang string")
    assert langid.identified(docs).columns == docs.columns
    assert (docs.columns, str(langid.BATCH)) in seen
    assert spark.conf.get(key) == before
