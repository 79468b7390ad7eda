"""Indicator texts, and a stream against the same rows as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.sources.indicators import indicators
from flowquarry.streaming.windows import beyond, counted


def test_indicators(spark):
    lines = ["hxxps://user@Evil[.]example:8443/path?q=1 # comment 9.9.9.9", "1.2.3[.]4, 1.2.3.4; 300.1.1.1", "2001:db8::1", "// 5.6.7.8", None, "", "d" * 32 + " " + "A" * 64 + " " + "e" * 40, "word 10.0.0.1:80"]
    got = {tuple(r) for r in indicators(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {("domain", "evil.example"), ("ipv4", "1.2.3.4"), ("ipv6", "2001:db8::1"), ("md5", "d" * 32), ("sha256", "a" * 64), ("sha1", "e" * 40), ("ipv4", "10.0.0.1")}


def test_stream_agrees_with_table(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 3).alias("user"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 7).alias("ts"))
    rows.unionByName(spark.createDataFrame([(1, None)], "user long, ts timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user long, ts timestamp").parquet(str(tmp_path / "in"))
    q = counted(stream, "user", 300).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    table = counted(spark.read.parquet(str(tmp_path / "in")), "user", 300)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, table.collect()))
    assert beyond(spark.read.parquet(str(tmp_path / "in")), "user", 300, 13).count() > 0


def test_flow_files_by_name(spark, tmp_path):
    from pyspark.sql import functions as F

    from flowquarry.schema import FLOW_COLUMNS
    from flowquarry.sources.flows import read_flows, write_flows

    path = str(tmp_path / "flow")
    whole = spark.range(6).select(F.col("id").alias("flow_id"), F.lit(1).cast("long").alias("capture_id"), F.lit("10.0.0.1").alias("src_ip"), F.lit("x").alias("sni"), F.lit(7).alias("beyond"))
    write_flows(whole, path)
    write_flows(whole.withColumn("capture_id", F.lit(2).cast("long")).drop("sni").limit(2), path)
    write_flows(whole.limit(3), path)
    got = read_flows(spark, path)
    assert got.columns == FLOW_COLUMNS
    rows = got.select("capture_id", "flow_id", "src_ip", "sni", "ja3").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, i, "10.0.0.1", "x", None) for i in range(3)] + [(2, i, "10.0.0.1", None, None) for i in range(2)]
