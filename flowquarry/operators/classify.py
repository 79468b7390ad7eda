"""Flow classification, enrichment against feeds, and scoring, as column expressions and broadcast joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.net import ip_key, is_external, name_suffixes, rank, severity_of, v4_number
from flowquarry.functions.order import checkpointed
from flowquarry.functions.tables import constant
from flowquarry.operators.flow import derived
from flowquarry.schema import ACK, CATEGORY_ATTACK, CATEGORY_POINTS, PAYLOAD_OT, PAYLOAD_WEB, POINTS_BEHAVIOR, POINTS_EXTERNAL, POINTS_INTERNAL, POINTS_IOC, PROTO, RST, RTP_PORTS, SERVICES, SYN

PROBE_PKTS, TUNNEL_BYTES, TUNNEL_NS, BEACON_BYTES, SCANNER_PORTS = 4, 1 << 20, 60_000_000_000, 4096, 15


def with_service(flows: DataFrame) -> DataFrame:
    """Adds service_category and service: what the smaller port stands for.  Media streams come before listed UDP ports."""
    rows = [(number, port, row[1], row[0]) for number, which in ((PROTO["tcp"], 2), (PROTO["udp"], 3)) for row in SERVICES for port in row[which]]
    ports = constant(flows.sparkSession, rows, "proto short, port_ int, cat_ string, token_ string")
    f = flows.withColumn("port_", F.least("lo_port", "hi_port")).join(F.broadcast(ports), ["proto", "port_"], "left")
    rtp = (F.col("proto") == PROTO["udp"]) & F.col("port_").between(*RTP_PORTS)
    return f.withColumns({"service_category": F.when(rtp, "voip").otherwise(F.col("cat_")), "service": F.when(rtp, "rtp").otherwise(F.col("token_"))}).drop("port_", "cat_", "token_")


def classified(flows: DataFrame) -> DataFrame:
    """Adds category, app_proto and app_proto_src: what the payload shows, else the port, else the flow's shape."""
    f = with_service(flows if "established" in flows.columns else derived(flows))
    port_cat, port_token = F.col("service_category"), F.col("service")
    seen = F.col("observed")
    payload_cat = F.when(seen.isin(*PAYLOAD_WEB), "web").when(seen.isin(*PAYLOAD_OT), "iot_ot")
    syn = F.col("flags_fwd").bitwiseAND(F.lit(SYN)) != 0
    reset = (F.col("pkts_rev") > 0) & (F.col("flags_rev").bitwiseAND(F.lit(RST)) != 0) & (F.col("flags_rev").bitwiseAND(F.lit(SYN | ACK)) == 0)
    probe = (F.col("proto") == PROTO["tcp"]) & syn & ~F.col("established") & (F.col("pkts") <= PROBE_PKTS) & ((F.col("pkts_rev") == 0) | reset)
    tunnel = (F.col("bytes") >= TUNNEL_BYTES) & (F.col("duration_ns") >= TUNNEL_NS)
    beacon = (F.col("pkts_fwd") >= 2) & (F.col("pkts_rev") >= 2) & (F.col("bytes") <= BEACON_BYTES)
    shape = F.when(probe, "scan").when(tunnel, "tunnel_vpn").when(beacon, "c2").otherwise("unknown")
    return f.withColumns({
        "category": F.coalesce(payload_cat, port_cat, shape),
        "app_proto": F.when(payload_cat.isNotNull(), seen).otherwise(port_token),
        "app_proto_src": F.when(payload_cat.isNotNull(), "payload").when(port_token.isNotNull(), "port"),
    }).drop("service_category", "service")


#: Hit sets of more rows than this meet the flows by a shuffle instead of a broadcast.
BROADCAST_ROWS = 500_000


def flagged(flows: DataFrame, hits: dict[str, DataFrame]) -> DataFrame:
    """Adds a flag for each entry ``column>flag`` of ``hits``: whether the column's value is among those of its one-column table.

    Small tables, by a count of their written rows, are broadcast; beyond that only flows that have a value are shuffled.
    """
    out = flows
    for name, table in hits.items():
        column, flag = name.split(">")
        keyed = table.select(F.col(table.columns[0]).alias(column), F.lit(True).alias(flag))
        if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            out = out.join(F.broadcast(keyed), column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
        else:
            with_value = out.filter(F.col(column).isNotNull()).join(keyed, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
            out = with_value.unionByName(out.filter(F.col(column).isNull()).withColumn(flag, F.lit(False)))
    return out


def scanners(flows: DataFrame, least: int = SCANNER_PORTS) -> DataFrame:
    """(ip): sources that sent bare SYNs to at least ``least`` distinct ports."""
    bare = flows.filter((F.col("proto") == PROTO["tcp"]))
    sides = [bare.filter((F.col(f"flags_{s}").bitwiseAND(F.lit(SYN)) != 0) & (F.col(f"flags_{s}").bitwiseAND(F.lit(ACK)) == 0)).select(F.col(ip).alias("ip"), F.col(port).alias("port")) for s, ip, port in (("fwd", "lo_ip", "hi_port"), ("rev", "hi_ip", "lo_port"))]
    return sides[0].unionByName(sides[1]).groupBy("ip").agg(F.count_distinct("port").alias("n")).filter(F.col("n") >= least).select("ip")


def with_scanners(flows: DataFrame, least: int = SCANNER_PORTS) -> DataFrame:
    """Unknown flows of a scanner, at either end, become scans."""
    who = checkpointed(scanners(flows, least))
    out = flagged(flows, {"lo_ip>lo_scans": who, "hi_ip>hi_scans": who})
    hit = (F.col("category") == "unknown") & (F.col("lo_scans") | F.col("hi_scans"))
    return out.withColumn("category", F.when(hit, "scan").otherwise(F.col("category"))).drop("lo_scans", "hi_scans")


def enriched(flows: DataFrame, feed: DataFrame) -> DataFrame:
    """Adds ioc_ip, ioc_domain and ioc_fp.  ``feed``: (kind, value), kind one of ip, cidr, domain, suffix, ja3, ja4.

    Hits are found from distinct values only, so that a busy address is matched once.  Suffixes meet as
    equi-joins over a name's parents; address blocks as equi-joins over one masked number a prefix length.
    """
    ips = flows.select(F.explode(F.array("lo_ip", "hi_ip")).alias("ip")).distinct()
    of = lambda *k: feed.filter(F.col("kind").isin(*k))
    # A mapped IPv6 address counts as its IPv4 address.
    plain = F.when(F.lower("ip").startswith("::ffff:") & F.col("ip").contains("."), F.substring("ip", 8, 20)).otherwise(F.col("ip"))
    hit_exact = ips.withColumn("k", ip_key(plain)).join(of("ip").select(ip_key(F.col("value")).alias("k")).distinct(), "k", "left_semi").select("ip")
    blocks = of("cidr").select(F.split("value", "/").alias("p")).select(v4_number(F.get("p", F.lit(0))).alias("net"), F.get("p", F.lit(1)).cast("int").alias("bits")).filter("net is not null")
    masked = lambda n, bits: F.call_function("shiftright", n, (F.lit(32) - bits).cast("int"))
    lengths = blocks.select("bits").distinct()
    hit_block = ips.withColumn("n", v4_number(plain)).filter("n is not null").join(F.broadcast(lengths.filter("bits between 0 and 32")), F.lit(True)).withColumn("m", masked(F.col("n"), F.col("bits"))).join(blocks.select("bits", masked(F.col("net"), F.col("bits")).alias("m")).distinct(), ["bits", "m"], "left_semi").select("ip")
    bad_ip = hit_exact.union(hit_block).distinct()
    names = flows.select("sni").filter("sni is not null").distinct()
    full = names.join(of("domain").select(F.lower("value").alias("v")), F.lower("sni") == F.col("v"), "left_semi")
    parents = names.withColumn("v", F.explode(name_suffixes(F.col("sni")))).join(of("suffix").select(F.ltrim(F.lower("value"), F.lit(".")).alias("v")), "v", "left_semi").select("sni")
    bad_name = full.union(parents).distinct()
    bad_ip, bad_name = checkpointed(bad_ip), checkpointed(bad_name)
    prints = {k: of(k).select("value").distinct() for k in ("ja3", "ja4")}
    out = flagged(flows, {"lo_ip>lo_bad": bad_ip, "hi_ip>hi_bad": bad_ip, "sni>name_bad": bad_name, **{f"{k}>{k}_bad": t for k, t in prints.items()}})
    out = out.withColumns({"ioc_ip": F.col("lo_bad") | F.col("hi_bad"), "ioc_domain": F.col("name_bad"), "ioc_fp": F.col("ja3_bad") | F.col("ja4_bad")})
    return out.drop("lo_bad", "hi_bad", "name_bad", "ja3_bad", "ja4_bad")


def scored(flows: DataFrame) -> DataFrame:
    """Adds severity, threat_score, ioc, attack and evidence.  Every point has its term in the evidence."""
    cat = F.col("category")
    ioc = F.col("ioc_ip") | F.col("ioc_domain") | F.col("ioc_fp")
    external = is_external(F.col("lo_ip")) | is_external(F.col("hi_ip"))
    table = F.create_map(*[F.lit(x) for kv in CATEGORY_POINTS.items() for x in kv])
    none = F.struct(F.lit(None).cast("string").alias("label"), F.lit(0).alias("points"))

    def term(label: Column | str, points: Column | int, on: Column | None = None) -> Column:
        t = F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), (F.lit(points) if isinstance(points, int) else points).alias("points"))
        return t if on is None else F.when(on, t).otherwise(none)

    beacon = (cat == "c2") & (F.col("bytes") <= BEACON_BYTES) & (F.col("pkts_fwd") >= 2) & (F.col("pkts_rev") >= 2)
    terms = F.filter(
        F.array(
            term(F.concat(F.lit("category "), cat), table[cat]),
            term("ioc: endpoint ip on threat feed", POINTS_IOC, F.col("ioc_ip")),
            term("ioc: sni on threat feed", POINTS_IOC, F.col("ioc_domain")),
            term("ioc: tls fingerprint on threat feed", POINTS_IOC, F.col("ioc_fp")),
            F.when(external, term("external public peer", POINTS_EXTERNAL)).otherwise(term("all-internal peers", POINTS_INTERNAL)),
            term("behavior: scan-shaped probe", POINTS_BEHAVIOR, (cat == "scan") & (F.col("pkts_rev") == 0)),
            term("behavior: beacon-shaped", POINTS_BEHAVIOR, beacon),
        ),
        lambda t: t["label"].isNotNull(),
    )
    f = flows.withColumn("ioc", ioc).withColumn("terms", terms)
    f = f.withColumn("raw_", F.aggregate("terms", F.lit(0), lambda a, t: a + t["points"]))
    f = f.withColumn("base_", F.least(F.lit(100), F.greatest(F.lit(0), F.col("raw_"))))
    held = (cat == "c2") & F.col("app_proto_src").isNull() & ~F.col("ioc") & (rank(severity_of(F.col("base_"))) > 2)
    worst = F.col("ioc") & cat.isin("c2", "anomalous")
    floored = F.col("ioc") & (rank(severity_of(F.col("base_"))) < 3)
    score = F.when(worst, F.greatest(F.lit(90), F.col("base_"))).when(floored, F.lit(60)).when(held, F.lit(59)).otherwise(F.col("base_"))
    # The bands of 90, 60 and 59 are critical, high and medium, so one rule gives the severity.
    notes = F.filter(
        F.array(
            F.when(F.col("raw_") != F.col("base_"), F.concat(F.lit("clamp: raw "), F.col("raw_").cast("string"), F.lit(" -> "), F.col("base_").cast("string"))),
            F.when(held, F.lit("cap: heuristic c2 candidate held at Medium without corroboration")),
            F.when(floored, F.lit("floor: ioc match forces High (>= 60)")),
            F.when(worst, F.lit("floor: ioc + c2/anomalous forces Critical (>= 90)")),
        ),
        lambda x: x.isNotNull(),
    )
    shown = F.transform("terms", lambda t: F.concat(t["label"], F.lit(" ("), F.when(t["points"] >= 0, F.lit("+")).otherwise(F.lit("")), t["points"].cast("string"), F.lit(")")))
    attack = F.create_map(*[F.lit(x) for kv in CATEGORY_ATTACK.items() for x in kv])[cat]
    return f.withColumns({"threat_score": score.cast("int"), "severity": severity_of(score), "evidence": F.concat(shown, notes), "attack": F.filter(F.array(attack), lambda a: a.isNotNull())}).drop("raw_", "base_")
