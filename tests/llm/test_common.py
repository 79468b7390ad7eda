"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.llm.common import maybe_in, one_array


def test_plans_do_not_hold_the_numbers(spark):
    """A bitmap of 2**20 bits is 2**14 numbers; the plan names the table that has them."""
    keys = spark.range(0, 120_000, 2)
    found = spark.range(120_000).filter(maybe_in(keys, ["id"], 60_000))
    assert len(found._jdf.queryExecution().toString()) < 20_000
    ids = {r["id"] for r in found.collect()}
    assert ids >= set(range(0, 120_000, 2)) and len(ids) < 70_000


def test_array_by_slots(spark):
    slots = spark.createDataFrame([(5, 1), (5, 4), (31, -1), (0, 7)], "slot int, v long")
    want = [0] * 32
    want[0], want[5], want[31] = 7, 5, -1
    assert spark.range(1).select(one_array(slots, 32).alias("v")).first()["v"] == want
    assert spark.range(1).select(F.size(one_array(slots.limit(0), 8)).alias("v")).first()["v"] == 8
