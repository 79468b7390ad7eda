"""Decontamination by document row and item text, whatever the ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.llm import decontaminate

ITEM = "one two three four five six seven eight nine ten"
OTHER = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def test_rows_and_texts_are_no_ids(spark):
    docs = spark.createDataFrame([(None, "one two three four five six seven"), (None, "clean text without a leak"), (None, "five six seven eight nine ten"), (1, "a " + ITEM + " b"), (1, "clean text under one"), (2, OTHER), (None, OTHER + " and more"), (3, "tiny")], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (7, OTHER), (None, ITEM), (None, "some other item without an id at all"), (7, "tiny")], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contained_items(docs, items).collect()), key=str)
    assert got == sorted([(1, 7, 6, 6, 1.0), (1, None, 6, 6, 1.0), (2, 7, 6, 6, 1.0), (None, 7, 6, 6, 1.0), (3, 7, 1, 1, 1.0)], key=str)
    kept = {tuple(r) for r in decontaminate.without_leaks(docs, items).collect()}
    assert kept == {(None, "one two three four five six seven"), (None, "clean text without a leak"), (None, "five six seven eight nine ten"), (1, "clean text under one")}


def _shuffled(spark):
    """Bytes that all stages of the session have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_clean_texts_are_not_shuffled(spark, tmp_path):
    """Tables of files are neither copied nor shuffled whole, also where no side of the join is broadcast."""
    noise = F.sha2(F.col("id").cast("string"), 512)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.lit("x " + ITEM)).otherwise(F.concat_ws(" ", *[F.sha2(F.concat(noise, F.lit(str(k))), 512) for k in range(8)])).alias("text"))
    docs.repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = _shuffled(spark)
        assert [tuple(r) for r in decontaminate.contained_items(docs, items).collect()] == [(7, 1, 6, 6, 1.0)]
        assert decontaminate.without_leaks(docs, items).count() == 3999
        assert _shuffled(spark) - began < 1_000_000  # the texts have 4 MB
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
