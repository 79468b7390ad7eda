"""Queries that once stopped at a report's default row count."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from flowquarry.plans import queries


def test_all_hosts_and_incidents(spark, monkeypatch):
    packets = spark.range(200).select(F.col("id").alias("idx"), F.format_string("10.0.0.%d", "id").alias("arp_ip"), F.format_string("m%d", "id").alias("arp_mac"), F.format_string("m%d", "id").alias("dhcp_mac"), F.lit("h").alias("dhcp_hostname"), F.lit("v").alias("dhcp_vendor"))
    monkeypatch.setattr(queries, "Capture", lambda spark, sf: SimpleNamespace(spark=spark, packets=packets))
    rows = queries.QUERIES["cor_local_hosts"](spark, "").collect()
    assert len(rows) == 200 and all(r["ip"] and r["hostname"] for r in rows)
    incidents = spark.range(6000).select(F.format_string("h%d", "id").alias("host"), F.lit("high").alias("severity"), F.lit(0).cast("timestamp").alias("created_at"))
    monkeypatch.setattr(queries, "_incident_view", lambda c: incidents)
    assert queries.QUERIES["q08"](spark, "").count() == 6000
