"""Behavioral folds over contacts and packets, from which detectors draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.net import entropy, is_generated_label, labels, longest_label, registered_domain
from flowquarry.schema import PROTO, TOOL_AGENTS

TWO_WAY = 512


def channels(contacts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(client, server, port): contacts, gap statistics in order of start, first and last, bytes, and flags."""
    key = [*(by or []), "client", "server", "port"]
    order = Window.partitionBy(*key).orderBy("first_ns", "last_ns", "lo_port", "hi_port")
    gap = F.greatest(F.lit(0), F.col("first_ns") - F.lag("first_ns").over(order))
    c2 = (F.col("category") == "c2") if "category" in contacts.columns else F.lit(False)
    named = F.col("app_proto").isNotNull() if "app_proto" in contacts.columns else F.lit(False)
    two_way = (F.col("bytes_out") >= TWO_WAY) & (F.col("bytes_in") >= TWO_WAY)
    g = contacts.withColumn("gap", gap).groupBy(*key).agg(
        F.count(F.lit(1)).alias("contacts"), F.count("gap").alias("gaps"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap"), F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("std_gap"),
        F.min("first_ns").alias("first_ns"), F.max("first_ns").alias("last_ns"), F.sum("bytes_out").alias("bytes_out"), F.sum("bytes_in").alias("bytes_in"),
        F.bool_or(c2).alias("c2_shape"), F.bool_or(named).alias("named"), F.bool_or(two_way).alias("two_way"),
    )
    cv = F.when((F.col("gaps") < 2) | (F.col("mean_gap") <= 0), F.lit(0.0)).otherwise(F.col("std_gap") / F.col("mean_gap"))
    return g.withColumn("cv", cv)


def fan_out(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("client", "port").agg(F.count_distinct("server").alias("servers"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))


def probed_ports(contacts: DataFrame) -> DataFrame:
    """(client, server): ports tried by flows that did not carry data both ways."""
    tried = contacts.filter(~((F.col("bytes_out") >= TWO_WAY) & (F.col("bytes_in") >= TWO_WAY)))
    return tried.groupBy("client", "server").agg(F.count_distinct("port").alias("ports"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))


def half_open(contacts: DataFrame, most: int = 256) -> DataFrame:
    """(server, port): TCP flows that hardly sent anything, and their sources."""
    t = contacts.filter((F.col("proto") == PROTO["tcp"]) & (F.col("bytes_out") < most))
    return t.groupBy("server", "port").agg(F.count(F.lit(1)).alias("attempts"), F.count_distinct("client").alias("sources"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))


def dns_queries(packets: DataFrame) -> DataFrame:
    return packets.filter(F.col("dns_qname").isNotNull() & (F.coalesce("dst_port", F.lit(0)) == 53))


def dns_volume(packets: DataFrame) -> DataFrame:
    """(src, resolver): queries, entropy and length of the longest labels."""
    q = dns_queries(packets).withColumn("label", longest_label(F.col("dns_qname")))
    return q.groupBy(F.col("src_ip").alias("src"), F.col("dst_ip").alias("resolver")).agg(F.count(F.lit(1)).alias("queries"), F.avg(entropy(F.col("label"))).alias("mean_entropy"), F.max(F.length("label")).alias("longest"), F.min_by("dns_qname", "idx").alias("sample"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def generated_names(packets: DataFrame) -> DataFrame:
    """src: queries, and distinct registered domains whose label looks generated."""
    domain = registered_domain(F.col("dns_qname"))
    q = dns_queries(packets).withColumn("domain", domain)
    odd = is_generated_label(F.try_element_at(labels(F.col("domain")), F.lit(1)))
    return q.groupBy(F.col("src_ip").alias("src")).agg(F.count(F.lit(1)).alias("queries"), F.count_distinct(F.when(odd, F.col("domain"))).alias("suspects"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def icmp_echoes(packets: DataFrame) -> DataFrame:
    e = packets.filter(F.col("icmp_type").isin(8, 128) & F.col("transport").isin("icmp", "icmpv6"))
    data = F.greatest(F.lit(0), F.col("payload_len") - 8)
    return e.groupBy(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst")).agg(F.count(F.lit(1)).alias("echoes"), F.sum(data).alias("data"), F.max(data).alias("largest"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def exposures(packets: DataFrame, column: str) -> DataFrame:
    """(src, dst, port): exposures of a kind of secret (``cleartext_cred`` or ``pii``) and the first kind seen."""
    return packets.filter(F.col(column).isNotNull()).groupBy(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), F.col("dst_port").alias("port")).agg(F.min_by(column, "idx").alias("kind"), F.count(F.lit(1)).alias("exposures"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def arp_claims(packets: DataFrame) -> DataFrame:
    return packets.filter("arp_ip is not null").groupBy(F.col("arp_ip").alias("ip")).agg(F.count_distinct("arp_mac").alias("macs"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def tool_of(agent: Column) -> Column:
    low = F.lower(agent)
    out = None
    for needle, name in TOOL_AGENTS:
        out = F.when(low.contains(needle), name) if out is None else out.when(low.contains(needle), name)
    return out


def tool_agents(packets: DataFrame) -> DataFrame:
    t = packets.withColumn("tool", tool_of(F.col("http_ua"))).filter("tool is not null")
    return t.groupBy(F.col("src_ip").alias("src")).agg(F.min_by("tool", "idx").alias("tool"), F.count(F.lit(1)).alias("hits"), F.substring(F.min_by("http_ua", "idx"), 1, 120).alias("sample"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def disguised(packets: DataFrame) -> DataFrame:
    return packets.filter("download_disguised").groupBy(F.col("dst_ip").alias("client"), F.col("src_ip").alias("server")).agg(F.count(F.lit(1)).alias("hits"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def mining(packets: DataFrame) -> DataFrame:
    """(miner, pool): messages of either role."""
    to_pool = F.col("stratum") == "miner"
    s = packets.filter("stratum is not null").select(F.when(to_pool, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("miner"), F.when(to_pool, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("pool"), to_pool.alias("mine"), "ts_ns")
    return s.groupBy("miner", "pool").agg(F.count_if("mine").alias("miner_msgs"), F.count_if(~F.col("mine")).alias("pool_msgs"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def ot_writes(packets: DataFrame) -> DataFrame:
    return packets.filter("ot_control is not null").groupBy(F.col("src_ip").alias("client"), F.col("dst_ip").alias("plc"), F.col("dst_port").alias("port")).agg(F.count(F.lit(1)).alias("commands"), F.concat_ws(",", F.array_sort(F.collect_set("ot_control"))).alias("functions"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def tls_weakness(version: Column, cipher: Column) -> Column:
    """3 for broken, 2 for weak, 1 for dated, null for sound parameters."""
    return (
        F.when((version == "SSL 3.0") | cipher.rlike("_NULL_|_anon_|EXPORT"), 3).when(cipher.rlike("RC4|_DES_(?!EDE)|_DES40_"), 2).when(cipher.contains("3DES") | version.isin("TLS 1.0", "TLS 1.1"), 1)
    )


def tls_sessions(flows: DataFrame) -> DataFrame:
    """First TLS parameters seen for each (client, server, port)."""
    t = flows.filter("tls_version is not null")
    return t.groupBy("client", "server", "port").agg(F.min_by(F.struct("tls_version", "tls_cipher"), F.struct("first_ns", "lo_port", "hi_port")).alias("s"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns")).select("client", "server", "port", "s.*", "first_ns", "last_ns")


def ja3_sets(contacts: DataFrame, k: int = 64) -> DataFrame:
    d = contacts.filter("ja3 is not null").select("client", "ja3").distinct()
    keep = d.withColumn("i", F.row_number().over(Window.partitionBy("client").orderBy("ja3"))).filter(F.col("i") <= k)
    return keep.groupBy("client").agg(F.concat_ws(",", F.array_sort(F.collect_set("ja3"))).alias("ja3s"), F.count(F.lit(1)).alias("n"))


def contact_hours(contacts: DataFrame) -> DataFrame:
    hour = F.expr("pmod(first_ns div 3600000000000, 24)").cast("int")
    return contacts.groupBy("client", hour.alias("hour")).agg(F.count(F.lit(1)).alias("contacts"))


def category_mix(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("client", "category").agg(F.count(F.lit(1)).alias("contacts"))
