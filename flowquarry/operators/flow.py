"""Packets to flows: a direction-free key, one aggregation, and the turn to initiator and responder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.net import ip_key
from flowquarry.schema import ACK, APP_RANK, PROTO, SYN

#: Columns that keep their first non-empty value in capture order.
STICKY = ["sni", "ja3", "ja4", "ja3s", "http_host", "http_ua", "tls_version", "tls_cipher", "hassh", "hassh_server"]
KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port", "proto"]


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def keyed(packets: DataFrame) -> DataFrame:
    """Adds the flow key (lo, hi, proto) and whether the packet goes from lo to hi.  Frames without an address go."""
    p = packets.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    a, b = F.struct(ip_key(F.col("src_ip")), F.coalesce("src_port", F.lit(0))), F.struct(ip_key(F.col("dst_ip")), F.coalesce("dst_port", F.lit(0)))
    p = p.withColumn("fwd", a <= b).withColumn("proto", F.coalesce(_lookup(PROTO, F.col("transport")), F.lit(0)).cast("short"))
    sp, dp = F.coalesce("src_port", F.lit(0)), F.coalesce("dst_port", F.lit(0))
    pick = lambda x, y: F.when(F.col("fwd"), x).otherwise(y)
    return p.withColumns({"lo_ip": pick(F.col("src_ip"), F.col("dst_ip")), "hi_ip": pick(F.col("dst_ip"), F.col("src_ip")), "lo_port": pick(sp, dp), "hi_port": pick(dp, sp)})


def split_idle(packets: DataFrame, idle_seconds: int = 120) -> DataFrame:
    """Adds ``episode``: the number of idle gaps of the flow before the packet."""
    order = Window.partitionBy(*KEY).orderBy("ts_ns", "idx")
    gap = F.col("ts_ns") - F.lag("ts_ns").over(order) > idle_seconds * 1_000_000_000
    return keyed(packets).withColumn("gap_", gap.cast("int")).withColumn("episode", F.coalesce(F.sum("gap_").over(order), F.lit(0))).drop("gap_")


def fold(packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a flow, in lo/hi form.  ``by``: further grouping columns, such as capture_id or episode."""
    p = packets if "fwd" in packets.columns else keyed(packets)
    fwd, flags, ttl = F.col("fwd"), F.coalesce(F.col("tcp_flags"), F.lit(0)), F.col("ttl")
    known = F.coalesce(F.col("ts_known"), F.lit(True))
    syn = (F.col("transport") == "tcp") & (flags.bitwiseAND(F.lit(SYN | ACK)) == SYN)
    rank = F.coalesce(_lookup(APP_RANK, F.col("app_proto")), F.lit(0))

    def sided(v: Column, on: bool) -> Column:
        return F.when(fwd if on else ~fwd, v)

    aggs = [
        F.coalesce(F.min(F.when(known, F.col("ts_ns"))), F.min("ts_ns")).alias("first_ns"),
        F.coalesce(F.max(F.when(known, F.col("ts_ns"))), F.max("ts_ns")).alias("last_ns"),
        *[F.count(sided(F.lit(1), s)).alias(f"pkts_{n}") for n, s in (("fwd", True), ("rev", False))],
        *[F.coalesce(F.sum(sided(F.col("wire_len"), s)), F.lit(0)).alias(f"bytes_{n}") for n, s in (("fwd", True), ("rev", False))],
        *[F.coalesce(F.bit_or(sided(flags, s)), F.lit(0)).cast("short").alias(f"flags_{n}") for n, s in (("fwd", True), ("rev", False))],
        *[F.coalesce(F.min(F.when(ttl > 0, sided(ttl, s))), F.lit(0)).cast("short").alias(f"ttl_{n}") for n, s in (("fwd", True), ("rev", False))],
        F.min_by(fwd, F.struct(~syn, "idx")).alias("init_fwd"),
        F.min_by("app_proto", F.struct(-rank, "idx")).alias("observed"),
        *[F.min_by(c, F.when(F.col(c) != "", F.col("idx"))).alias(c) for c in STICKY],
    ]
    return p.groupBy(*(by or []), *KEY).agg(*aggs)


def derived(flows: DataFrame) -> DataFrame:
    """Adds totals, duration and whether the handshake completed."""
    handshake = (F.col("proto") == PROTO["tcp"]) & (F.col("flags_fwd").bitwiseAND(F.lit(SYN)) != 0) & (F.col("flags_rev").bitwiseAND(F.lit(SYN | ACK)) == (SYN | ACK))
    return flows.withColumns({"pkts": F.col("pkts_fwd") + F.col("pkts_rev"), "bytes": F.col("bytes_fwd") + F.col("bytes_rev"), "duration_ns": F.greatest(F.lit(0), F.col("last_ns") - F.col("first_ns")), "established": handshake})


def oriented(flows: DataFrame) -> DataFrame:
    """Adds source, destination and both directions from the initiator's side."""
    on = F.col("init_fwd")
    pick = lambda a, b: F.when(on, F.col(a)).otherwise(F.col(b))
    return flows.withColumns({
        "src_ip": pick("lo_ip", "hi_ip"), "dst_ip": pick("hi_ip", "lo_ip"), "src_port": pick("lo_port", "hi_port"), "dst_port": pick("hi_port", "lo_port"),
        "bytes_c2s": pick("bytes_fwd", "bytes_rev"), "bytes_s2c": pick("bytes_rev", "bytes_fwd"), "tcp_flags_c2s": pick("flags_fwd", "flags_rev"), "tcp_flags_s2c": pick("flags_rev", "flags_fwd"), "ttl_min_c2s": pick("ttl_fwd", "ttl_rev"),
    })


def contacts(flows: DataFrame) -> DataFrame:
    """One row a flow with ports: client, server (the side with the smaller port; lo on a tie), port and bytes."""
    lo_serves = F.col("lo_port") <= F.col("hi_port")
    pick = lambda a, b: F.when(lo_serves, F.col(a)).otherwise(F.col(b))
    ported = flows.filter(F.col("proto").isin(PROTO["tcp"], PROTO["udp"], PROTO["sctp"]))
    return ported.withColumns({"client": pick("hi_ip", "lo_ip"), "server": pick("lo_ip", "hi_ip"), "port": pick("lo_port", "hi_port"), "bytes_out": pick("bytes_rev", "bytes_fwd"), "bytes_in": pick("bytes_fwd", "bytes_rev")})
