"""Queries of capture files on disk and of carved captures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.order import shared_folder
from flowquarry.operators import carve
from flowquarry.operators import decode as D
from flowquarry.plans.capture_queries import frames
from flowquarry.plans.queries import Capture, query
from flowquarry.sources.capture import read_captures
from flowquarry.sources.capture_sink import write_captures

HOST, SPAN = "10.0.1.5", 64 << 10
_ENDS = f"(src_ip = '{HOST}' OR dst_ip = '{HOST}')"


def _read_back(c: Capture, made: DataFrame, files: int) -> DataFrame:
    """Frames written to files of a new folder and read from there in ranges, decoded."""
    folder = f"{shared_folder(c.spark)}/captures-{uuid.uuid4().hex}"
    write_captures(made, folder, files=files).count()
    return D.layers(read_captures(c.spark, folder, span=SPAN))


# Two files for each link type at most: long ones, so that they are read in ranges.
query("src_dir", "SELECT ts_ns, TRUE AS ts_known, wire_len, src_ip, dst_ip, dst_port FROM packet")(lambda c: _read_back(c, frames(c.packets), 2).select("ts_ns", "ts_known", "wire_len", "src_ip", "dst_ip", "dst_port"))


def _carved(c: Capture, most_packets: int, most_bytes: int) -> carve.Carved:
    made = frames(c.packets).withColumn("cap_len", F.col("wire_len"))
    return carve.carve(made, carve.of_host(HOST), D.ETHERNET, ["ts_ns", "idx"], most_packets=most_packets, most_bytes=most_bytes)


def _pk_carve(c: Capture) -> DataFrame:
    got = _carved(c, 1 << 40, 60_000)
    return got.frames.select("idx", "ts_ns", "wire_len", F.lit(got.packets).cast("long").alias("packets"), F.lit(got.truncated).alias("truncated"), F.lit(got.skipped).cast("long").alias("skipped"))


_HITS = f", hits AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ts_ns, idx) AS n, 24 + SUM(wire_len + 16) OVER (ORDER BY ts_ns, idx) AS held FROM packet WHERE {_ENDS} AND idx % 13 <> 0)"
query(
    "pk_carve",
    f"{_HITS} SELECT idx, ts_ns, wire_len, COUNT(*) OVER () AS packets, (SELECT MAX(held) FROM hits) > 60000 AS truncated, (SELECT COUNT(*) FROM packet WHERE {_ENDS} AND idx % 13 = 0) AS skipped FROM hits WHERE held <= 60000",
)(_pk_carve)
query("sink_carved_pcap", f"{_HITS} SELECT ts_ns, wire_len, src_ip, dst_ip, src_port, dst_port, transport FROM hits WHERE n <= 2000")(
    lambda c: _read_back(c, carve.carve(frames(c.packets).withColumn("cap_len", F.octet_length("frame")), carve.of_host(HOST), D.ETHERNET, ["ts_ns", "idx"]).frames, 1).select("ts_ns", "wire_len", "src_ip", "dst_ip", "src_port", "dst_port", "transport")
)
