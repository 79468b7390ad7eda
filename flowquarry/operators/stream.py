"""Packets of single flows: extraction and the turns of a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.operators.flow import keyed

#: Packets shown of a flow, and nanoseconds of tolerance around its times.
SHOWN, SLACK_NS = 2000, 1_000_000


def extract(packets: DataFrame, src_ip: str, dst_ip: str, dst_port: int, first_ns: int, last_ns: int, shown: int = SHOWN) -> DataFrame:
    """(idx, ts_ns, direction, wire_len, total): packets between a client and a service, both ways; ``total`` counts those not shown too."""
    there = (F.col("src_ip") == src_ip) & (F.col("dst_ip") == dst_ip) & (F.col("dst_port") == dst_port)
    back = (F.col("src_ip") == dst_ip) & (F.col("dst_ip") == src_ip) & (F.col("src_port") == dst_port)
    hits = packets.filter((there | back) & F.col("ts_ns").between(first_ns - SLACK_NS, last_ns + SLACK_NS)).select("idx", "ts_ns", F.when(there, "c2s").otherwise("s2c").alias("direction"), "wire_len")
    text = f"SELECT *, (SELECT count(*) FROM {{hits}}) AS total FROM {{hits}} ORDER BY ts_ns, idx LIMIT {shown}"
    return packets.sparkSession.sql(text, hits=hits)


def turns(packets: DataFrame) -> DataFrame:
    """(key, turn, fwd, pkts, payload): runs of packets of one direction in each flow; packets without payload do not break a run."""
    key = ["lo_ip", "lo_port", "hi_ip", "hi_port", "transport"]
    full = keyed(packets).filter(F.col("ts_known") & (F.col("payload_len") > 0) & F.col("lo_ip").isNotNull())
    over = Window.partitionBy(*key).orderBy("ts_ns", "idx")
    changed = F.coalesce(F.col("fwd") != F.lag("fwd").over(over), F.lit(False)).cast("long")
    marked = full.withColumn("changed", changed).withColumn("turn", F.sum("changed").over(over))
    return marked.groupBy(*key, "turn", "fwd").agg(F.count(F.lit(1)).alias("pkts"), F.sum("payload_len").alias("payload"))
