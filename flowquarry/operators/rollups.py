"""Capture-wide rollups: each is one hash aggregation, and a total order with a limit where it is a top list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.net import cloud_provider, ip_class, is_external, name_suffixes, rank
from flowquarry.functions.tables import constant
from flowquarry.operators.flow import keyed
from flowquarry.schema import CATEGORIES, DOH_HOSTS, NICE_WIDTHS, SEVERITIES, SIZE_BUCKETS


def _top(df: DataFrame, k: int | None, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k) if k else df


def endpoints(df: DataFrame, *values: str) -> DataFrame:
    """A row for each end of a packet or flow.  A row whose ends are equal counts at both."""
    a, b = ("lo_ip", "hi_ip") if "lo_ip" in df.columns else ("src_ip", "dst_ip")
    return df.select(F.explode(F.array(a, b)).alias("ip"), *values).filter(F.col("ip").isNotNull())


def totals(packets: DataFrame, flows: DataFrame) -> DataFrame:
    known = F.when(F.col("ts_known"), F.col("ts_ns"))
    p = packets.agg(F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum("wire_len"), F.lit(0)).alias("wire_bytes"), F.coalesce(F.sum("cap_len"), F.lit(0)).alias("captured_bytes"), F.count_if(F.col("src_ip").isNull()).alias("non_ip"), F.min(known).alias("first_ns"), F.max(known).alias("last_ns"), F.count(known).alias("n_"))
    f = flows.agg(F.count(F.lit(1)).alias("flows"))
    return p.join(F.broadcast(f)).withColumn("duration_ns", F.when(F.col("n_") < 2, F.lit(0)).otherwise(F.col("last_ns") - F.col("first_ns"))).drop("n_")


def protocol_counts(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """TCP and UDP packets, and the packets of flows by protocol family."""
    p = packets.agg(F.count_if(F.col("transport") == "tcp").alias("tcp"), F.count_if(F.col("transport") == "udp").alias("udp"))
    family = path_bucket(F.col("app_proto"))
    f = flows.agg(*[F.coalesce(F.sum(F.when(family == x, F.col("pkts"))), F.lit(0)).alias(x) for x in ("http", "https", "quic", "dns", "ot", "other")])
    return p.join(F.broadcast(f))


def path_bucket(app: Column) -> Column:
    return (
        F.when(app.isin("http", "http-proxy"), "http").when(app.isin("https", "tls"), "https").when(app.isin("quic", "http3"), "quic").when(app.isin("dns", "mdns", "dot"), "dns")
        .when(app.isin("modbus", "dnp3", "s7comm", "bacnet", "ethernet-ip", "mqtt", "mqtts", "coap"), "ot").otherwise("other")
    )


def top_talkers(packets: DataFrame, flows: DataFrame, k: int | None = 50) -> DataFrame:
    p = endpoints(packets, "wire_len").groupBy("ip").agg(F.count(F.lit(1)).alias("pkts"), F.sum("wire_len").alias("bytes"))
    f = endpoints(flows).groupBy("ip").agg(F.count(F.lit(1)).alias("flows"))
    return _top(p.join(f, "ip", "left").withColumn("flows", F.coalesce("flows", F.lit(0))), k, F.desc("bytes"), F.desc("pkts"), F.asc("ip"))


def unique_hosts(packets: DataFrame) -> DataFrame:
    return endpoints(packets).agg(F.count_distinct("ip").alias("hosts"))


def _paths(flows: DataFrame) -> DataFrame:
    l4 = F.when(F.col("proto") == 6, "tcp").when(F.col("proto") == 17, "udp").when(F.col("proto") == 132, "sctp").when(F.col("proto") == 1, "icmp").when(F.col("proto") == 58, "icmpv6").otherwise("other")
    return flows.select(l4.alias("l4"), F.when(l4.isin("tcp", "udp"), path_bucket(F.col("app_proto"))).alias("l7"), "pkts", "bytes")


def protocol_hierarchy(flows: DataFrame, k: int | None = 30) -> DataFrame:
    path = F.concat_ws(".", F.lit("ip"), "l4", "l7")
    return _top(_paths(flows).groupBy(path.alias("path")).agg(F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes")), k, F.desc("bytes"), F.desc("pkts"), F.asc("path"))


def sunburst(flows: DataFrame) -> DataFrame:
    """Packets and bytes for every prefix of the protocol path."""
    r = _paths(flows).withColumn("l7", F.coalesce("l7", F.lit("none"))).rollup("l4", "l7").agg(F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes"), F.grouping_id().alias("g"))
    return r.filter(F.coalesce(F.col("l7"), F.lit("")) != "none").select(F.concat_ws(".", F.lit("ip"), "l4", "l7").alias("path"), (F.lit(3) - F.when(F.col("g") == 3, 2).otherwise(F.col("g"))).cast("int").alias("depth"), "pkts", "bytes")


def port_histogram(packets: DataFrame, k: int | None = 50) -> DataFrame:
    p = packets.filter(F.col("transport").isin("tcp", "udp", "sctp"))
    return _top(p.groupBy(F.least("src_port", "dst_port").alias("port"), "transport").agg(F.count(F.lit(1)).alias("pkts"), F.sum("wire_len").alias("bytes")), k, F.desc("pkts"), F.desc("bytes"), F.asc("port"), F.asc("transport"))


def nice_width(seconds: int, buckets: int = 1000) -> int:
    """The least width of the ladder, then of whole weeks, at which aligned buckets over a span number at most ``buckets``."""
    for w in NICE_WIDTHS:
        if seconds // w + 1 <= buckets:
            return w
    week = NICE_WIDTHS[-1]
    return week * -(-(seconds // week + 1) // buckets)


def time_histogram(packets: DataFrame, buckets: int = 1000) -> DataFrame:
    """Packets and bytes per aligned bucket; empty buckets are left out.  One row of bounds goes to the driver."""
    p = packets.filter("ts_known").select(F.expr("ts_ns div 1000000000").alias("sec"), "wire_len")
    lo, hi = p.agg(F.min("sec"), F.max("sec")).first()
    if lo is None:
        return p.select(F.col("sec").alias("bucket"), F.lit(1).alias("width"), F.lit(0).cast("long").alias("pkts"), F.lit(0).cast("long").alias("bytes")).limit(0)
    w = nice_width(hi - lo, buckets)
    while hi // w - lo // w + 1 > buckets:
        w = next((x for x in NICE_WIDTHS if x > w), w + NICE_WIDTHS[-1])
    return p.groupBy((F.expr(f"sec div {w}") * w).alias("bucket")).agg(F.count(F.lit(1)).alias("pkts"), F.sum("wire_len").alias("bytes")).withColumn("width", F.lit(w))


def downsampled(histogram: DataFrame, most: int = 1000) -> DataFrame:
    """At most ``most`` rows of an ordered histogram: of each window of neighbours the one with most packets."""
    h = histogram.withColumn("i", F.row_number().over(Window.orderBy("bucket")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    w = F.expr(f"(i * least(n, {most})) div n")
    return h.groupBy(w.alias("w")).agg(F.max_by(F.struct("bucket", "pkts", "bytes"), F.struct("pkts", -F.col("bucket"))).alias("r")).select("r.*")


def heat(histogram: DataFrame) -> DataFrame:
    """Bytes on a logarithmic scale of 0 to 1, and the peak bucket."""
    top = histogram.agg(F.max("bytes").alias("top"), F.max_by("bucket", F.struct("bytes", -F.col("bucket"))).alias("peak"))
    return histogram.join(F.broadcast(top)).select("bucket", F.round(F.log1p("bytes") / F.log1p("top"), 6).alias("heat"), (F.col("bucket") == F.col("peak")).alias("is_peak"))


def size_histogram(packets: DataFrame) -> DataFrame:
    """Packets per frame size bucket; empty buckets are kept."""
    slot = F.lit(len(SIZE_BUCKETS))
    for i, top in reversed(list(enumerate(SIZE_BUCKETS))):
        slot = F.when(F.col("wire_len") <= top, F.lit(i)).otherwise(slot)
    got = packets.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    base = packets.sparkSession.range(len(SIZE_BUCKETS) + 1).select(F.col("id").cast("int").alias("slot"))
    upper = F.get(F.array(*map(F.lit, SIZE_BUCKETS)), F.col("slot"))
    return base.join(F.broadcast(got), "slot", "left").select("slot", upper.alias("upper"), F.coalesce("n", F.lit(0)).alias("pkts"))


def ttl_histogram(packets: DataFrame, k: int | None = 16) -> DataFrame:
    return _top(packets.filter("ttl > 0").groupBy("ttl").agg(F.count(F.lit(1)).alias("pkts")), k, F.desc("pkts"), F.asc("ttl"))


def category_breakdown(flows: DataFrame) -> DataFrame:
    """One row for each category, in fixed order, empty ones too."""
    got = flows.groupBy("category").agg(F.count(F.lit(1)).alias("flows"), F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes"))
    base = constant(flows.sparkSession, list(enumerate(CATEGORIES)), "place int, category string")
    return base.join(F.broadcast(got), "category", "left").na.fill(0).select("place", "category", "flows", "pkts", "bytes")


def severity_counts(flows: DataFrame) -> DataFrame:
    return flows.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def ip_threat(flows: DataFrame, k: int | None = 50) -> DataFrame:
    """A card for each address: its worst flow, volumes, techniques, evidence and tags."""
    seen = flows.select(F.explode(F.array_distinct(F.array("lo_ip", "hi_ip"))).alias("ip"), "threat_score", "severity", "bytes", "ioc", "attack", "evidence", "first_ns", "lo_ip", "hi_ip", "lo_port", "hi_port", "proto")
    worst = F.struct("threat_score", rank(F.col("severity")), -F.col("first_ns"), "lo_ip", "lo_port", "hi_ip", "hi_port", "proto")
    g = seen.groupBy("ip").agg(
        F.max("threat_score").alias("score"), F.max_by("severity", worst).alias("severity"), F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes"), F.bool_or("ioc").alias("ioc"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("attack")))).alias("attack"), F.slice(F.max_by("evidence", worst), 1, 6).alias("evidence"),
    )
    cloud = cloud_provider(F.col("ip"))
    tags = F.filter(F.array(F.when(is_external(F.col("ip")), "public").otherwise("internal"), F.when(F.col("ioc"), F.lit("ioc")), F.concat(F.lit("cloud:"), cloud)), lambda t: t.isNotNull())
    out = g.select("ip", ip_class(F.col("ip")).alias("ip_class"), "severity", "score", "flows", "bytes", "ioc", F.concat_ws(",", "attack").alias("attack"), F.concat_ws(" | ", "evidence").alias("evidence"), F.concat_ws(",", tags).alias("tags"))
    return _top(out, k, F.desc("score"), F.desc(rank(F.col("severity"))), F.desc("flows"), F.asc("ip"))


def findings_uplift(cards: DataFrame, findings: DataFrame, k: int | None = None) -> DataFrame:
    """Raise-only merge of findings into cards; a finding's host without a card gets one."""
    ends = findings.select(F.explode(F.array_distinct(F.filter(F.array("src_ip", "dst_ip"), lambda x: x.isNotNull()))).alias("ip"), "score", "severity")
    up = ends.groupBy("ip").agg(F.max("score").alias("f_score"), F.max(rank(F.col("severity"))).alias("f_rank"), F.count(F.lit(1)).alias("findings"))
    both = cards.select("ip", "score", rank(F.col("severity")).alias("rank")).join(up, "ip", "full_outer")
    out = both.select("ip", F.greatest(F.coalesce("score", F.lit(0)), F.coalesce("f_score", F.lit(0))).alias("score"), F.greatest(F.coalesce("rank", F.lit(0)), F.coalesce("f_rank", F.lit(0))).alias("rank"), F.coalesce("findings", F.lit(0)).alias("findings"))
    return _top(out, k, F.desc("score"), F.desc("rank"), F.asc("ip"))


def domains(flows: DataFrame, k: int | None = 50) -> DataFrame:
    name = F.lower("sni")
    named = flows.filter(name.contains(".") & ~name.rlike(r"^[\d.]+$|:"))
    return _top(named.groupBy(name.alias("domain")).agg(F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes")), k, F.desc("flows"), F.desc("bytes"), F.asc("domain"))


def counted(flows: DataFrame, column: str, k: int | None = 15) -> DataFrame:
    return _top(flows.filter(F.col(column) != "").groupBy(column).agg(F.count(F.lit(1)).alias("flows")), k, F.desc("flows"), F.asc(column))


def passive_dns(packets: DataFrame, k: int | None = 50) -> DataFrame:
    """Resolved addresses with the first name seen for each.  A response names what the flow last asked."""
    p = keyed(packets).filter(F.col("app_proto") == "dns")
    asked = F.last("dns_qname", ignorenulls=True).over(Window.partitionBy("lo_ip", "lo_port", "hi_ip", "hi_port", "proto").orderBy("idx"))
    a = p.withColumn("name", asked).select("idx", "name", F.explode("dns_answers").alias("ip")).filter("name is not null")
    return _top(a.groupBy("ip").agg(F.min_by("name", "idx").alias("domain"), F.count(F.lit(1)).alias("resolutions")), k, F.desc("resolutions"), F.asc("ip"))


def arp_hosts(packets: DataFrame, k: int | None = 64) -> DataFrame:
    return _top(packets.filter("arp_ip is not null").groupBy(F.col("arp_ip").alias("ip")).agg(F.min_by("arp_mac", "idx").alias("mac")), k, F.asc("ip"))


def dhcp_hosts(packets: DataFrame, k: int | None = 64) -> DataFrame:
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("idx")))
    return _top(packets.filter("dhcp_mac is not null").groupBy(F.col("dhcp_mac").alias("mac")).agg(first("dhcp_hostname").alias("hostname"), first("dhcp_vendor").alias("vendor")), k, F.asc("mac"))


def downloads(packets: DataFrame, k: int | None = 64) -> DataFrame:
    d = packets.filter("download is not null").groupBy(F.col("dst_ip").alias("client"), F.col("src_ip").alias("server"), F.col("download").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return _top(d, k, F.desc("n"), F.asc("client"), F.asc("server"), F.asc("class"))


def encrypted_dns(flows: DataFrame, k: int | None = 64) -> DataFrame:
    """Hosts that use resolvers over HTTPS (by name, on port 443) or over TLS (port 853)."""
    port = F.when((F.col("lo_port") == 443) | (F.col("hi_port") == 443), 443).when((F.col("lo_port") == 853) | (F.col("hi_port") == 853), 853)
    f = flows.withColumn("service", port)
    client = F.when(F.col("lo_port") == F.col("service"), F.col("hi_ip")).otherwise(F.col("lo_ip"))
    server = F.when(F.col("lo_port") == F.col("service"), F.col("lo_ip")).otherwise(F.col("hi_ip"))
    over_https = f.filter("service = 443 and sni is not null").filter(F.exists(name_suffixes(F.col("sni")), lambda s: s.isin(*DOH_HOSTS))).select(client.alias("host"), F.lower("sni").alias("resolver"))
    over_tls = f.filter("service = 853").select(client.alias("host"), server.alias("resolver"))
    return _top(over_https.unionByName(over_tls).groupBy("host", "resolver").agg(F.count(F.lit(1)).alias("flows")), k, F.desc("flows"), F.asc("host"), F.asc("resolver"))


def flow_stats(flows: DataFrame) -> DataFrame:
    """Totals of a set of flows and its three most frequent categories."""
    cats = flows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.sum("pkts").alias("p"), F.count_if("ioc").alias("i"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "category")))
    return cats.agg(F.sum("n").alias("flows"), F.sum("b").alias("bytes"), F.sum("p").alias("pkts"), F.sum("i").alias("iocs"), F.concat_ws(",", F.slice(order["category"], 1, 3)).alias("top"))


def protocol_mix(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """Shares of all packets: named protocols, the rest of TCP and UDP, and others."""
    c = protocol_counts(packets, flows).join(F.broadcast(packets.agg(F.count(F.lit(1)).alias("all"))))
    named = F.col("http") + F.col("https") + F.col("quic") + F.col("dns")
    rest = F.greatest(F.lit(0), F.col("tcp") + F.col("udp") - named)
    rows = F.array(*[F.struct(F.lit(n).alias("leaf"), v.alias("pkts")) for n, v in (("http", F.col("http")), ("https", F.col("https")), ("quic", F.col("quic")), ("dns", F.col("dns")), ("other_transport", rest), ("rest", F.greatest(F.lit(0), F.col("all") - named - rest)))])
    return c.select(F.inline(rows))


def attack_coverage(findings: DataFrame) -> DataFrame:
    x = findings.select(F.explode("attack").alias("technique"), rank(F.col("severity")).alias("r"))
    return x.groupBy("technique").agg(F.count(F.lit(1)).alias("findings"), F.max("r").alias("worst"))


def threat_graph(findings: DataFrame, cards: DataFrame, k: int = 14) -> tuple[DataFrame, DataFrame]:
    """Nodes: the k hosts of findings with the highest scores; edges among them with their worst severity."""
    ends = findings.select(F.explode(F.array_distinct(F.filter(F.array("src_ip", "dst_ip"), lambda x: x.isNotNull()))).alias("ip"), "score", rank(F.col("severity")).alias("r"))
    nodes = ends.unionByName(cards.join(ends.select("ip").distinct(), "ip", "left_semi").select("ip", "score", rank(F.col("severity")).alias("r"))).groupBy("ip").agg(F.max("score").alias("score"), F.max("r").alias("worst"))
    nodes = _top(nodes, k, F.desc("score"), F.desc("worst"), F.asc("ip"))
    keep = F.broadcast(nodes.select("ip"))
    edges = findings.filter("dst_ip is not null").groupBy("src_ip", "dst_ip").agg(F.max(rank(F.col("severity"))).alias("worst"), F.count(F.lit(1)).alias("findings"))
    edges = edges.join(keep.withColumnRenamed("ip", "src_ip"), "src_ip", "left_semi").join(keep.withColumnRenamed("ip", "dst_ip"), "dst_ip", "left_semi")
    return nodes, edges


# The severity that a category stands for in a chart.
CATEGORY_SEVERITY = {"c2": "critical", "anomalous": "high", "scan": "high", "tunnel_vpn": "medium", "remote_access": "medium", "file_transfer": "low", "email": "low", "iot_ot": "low"}


def severity_by_category(flows: DataFrame) -> DataFrame:
    """Flows, packets and bytes per severity of the category, and in all (severity null)."""
    table = F.create_map(*[F.lit(x) for kv in CATEGORY_SEVERITY.items() for x in kv])
    return flows.withColumn("sev", F.coalesce(table[F.col("category")], F.lit("info"))).rollup("sev").agg(F.count(F.lit(1)).alias("flows"), F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes")).withColumnRenamed("sev", "severity")


def score_terms(evidence: DataFrame) -> DataFrame:
    """Terms (label, points) of evidence lines that end in a signed number; other lines are notes."""
    e = evidence.select("*", F.posexplode("evidence").alias("at", "line"))
    points = F.regexp_extract("line", r"\(([+-]\d+)\)$", 1)
    return e.select(*[c for c in evidence.columns if c != "evidence"], "at", F.when(points != "", F.regexp_replace("line", r" \([+-]\d+\)$", "")).otherwise(F.col("line")).alias("label"), F.when(points != "", points.cast("int")).alias("points"))


def flag_names(flags: Column) -> Column:
    names = [(1, "FIN"), (2, "SYN"), (4, "RST"), (8, "PSH"), (16, "ACK"), (32, "URG"), (64, "ECE"), (128, "CWR")]
    return F.concat_ws("|", *[F.when(flags.bitwiseAND(F.lit(b)) != 0, n) for b, n in names])
