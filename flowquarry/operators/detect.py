"""Detectors: thresholds over the behavioral folds, each giving findings of one kind.

A finding has kind, severity, score, title, src_ip, dst_ip, dst_port, attack, evidence, first_ns,
last_ns and victims.  Parameters are the defaults of each function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.net import cloud_provider, human_bytes, is_external
from flowquarry.functions.order import checkpointed
from flowquarry.operators import behavior as B
from flowquarry.schema import AUTH_PORTS, LATERAL_PORTS, SWEEP_EXEMPT_PORTS

COLUMNS = ["kind", "severity", "score", "title", "src_ip", "dst_ip", "dst_port", "attack", "evidence", "first_ns", "last_ns", "victims"]
SECOND = 1_000_000_000


def _c(x: Column | str | int | None, kind: str) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast(kind)


def _findings(df: DataFrame, kind: str, severity: Column | str, score: Column | int, title: Column | str, src: str, dst: str | None, port: str | None, attack: list[str], *evidence: Column, victims: Column | None = None) -> DataFrame:
    out = df.select(
        F.lit(kind).alias("kind"), _c(severity, "string").alias("severity"), _c(score, "int").alias("score"), _c(title, "string").alias("title"), F.col(src).alias("src_ip"), (F.col(dst) if dst else F.lit(None).cast("string")).alias("dst_ip"),
        (F.col(port) if port else F.lit(None)).cast("int").alias("dst_port"), F.array(*map(F.lit, attack)).cast("array<string>").alias("attack"), F.array(*evidence).cast("array<string>").alias("evidence"), F.col("first_ns").cast("long"), F.col("last_ns").cast("long"),
        (victims if victims is not None else F.array().cast("array<string>")).alias("victims"),
    )
    return out


def _n(column: str, text: str) -> Column:
    return F.concat(F.col(column).cast("string"), F.lit(" " + text))


def beacons(channels: DataFrame, contacts: int = 12, cv: float = 0.15, shortest: int = SECOND, longest: int = 86_400 * SECOND) -> DataFrame:
    """Regular contacts: strict by even gaps, else evasive by small exchanges with an outside host."""
    c = channels.withColumn("ext", is_external(F.col("server")))
    apart = ~F.col("port").isin(*AUTH_PORTS, *LATERAL_PORTS)
    strict = (F.col("contacts") >= contacts) & (F.col("cv") <= cv) & F.col("mean_gap").between(shortest, longest) & apart
    evasive = ~strict & apart & (F.col("contacts") >= 8) & (F.col("cv") <= 0.5) & F.col("mean_gap").between(shortest, longest) & F.col("ext") & (F.col("bytes_out") > 0) & (F.col("bytes_in") > 0) & (F.col("bytes_out") + F.col("bytes_in") <= 4096 * F.col("contacts"))
    sure = F.col("c2_shape") & ~F.col("named") & (F.col("contacts") >= 20) & cloud_provider(F.col("server")).isNull()
    high = F.when(strict, F.col("ext")).otherwise(sure)
    score = F.when(high, 70).when(strict, 45).otherwise(59)
    hits = c.filter(strict | evasive)
    return _findings(hits, "beacon", F.when(high, "high").otherwise("medium"), score, F.when(strict, "Regular beacon").otherwise("Irregular beacon"), "client", "server", "port", ["T1071"], _n("contacts", "contacts"), F.format_string("mean gap %.1f s", F.col("mean_gap") / SECOND), F.format_string("jitter %.3f", F.col("cv")))


def exfiltration(channels: DataFrame, least: int = 1_000_000, ratio: int = 4, large: int = 100_000_000) -> DataFrame:
    hits = channels.filter((F.col("bytes_out") >= least) & (F.col("bytes_out") >= ratio * (F.col("bytes_in") + 1)) & is_external(F.col("server")))
    big = F.col("bytes_out") >= large
    return _findings(hits, "data_exfil", F.when(big, "critical").otherwise("high"), F.when(big, 90).otherwise(72), "Large upload to an outside host", "client", "server", "port", ["T1048"], F.concat(human_bytes(F.col("bytes_out")), F.lit(" out")), F.concat(human_bytes(F.col("bytes_in")), F.lit(" in")))


def host_sweeps(contacts: DataFrame, least: int = 16) -> DataFrame:
    hits = B.fan_out(contacts).filter((F.col("servers") >= least) & ~F.col("port").isin(*SWEEP_EXEMPT_PORTS))
    return _findings(hits, "host_sweep", "high", 65, "One port on many hosts", "client", None, "port", ["T1046"], _n("servers", "hosts"))


def port_scans(contacts: DataFrame, least: int = 30) -> DataFrame:
    hits = B.probed_ports(contacts).filter(F.col("ports") >= least)
    return _findings(hits, "port_scan", "high", 64, "Many ports on one host", "client", "server", None, ["T1046"], _n("ports", "ports"))


def syn_floods(contacts: DataFrame, least: int = 200) -> DataFrame:
    """The flooded host is the finding's source."""
    hits = B.half_open(contacts).filter(F.col("attempts") >= least)
    return _findings(hits, "syn_flood", "high", 68, "Many half-open connections", "server", None, "port", ["T1499.001"], _n("attempts", "attempts"), _n("sources", "sources"))


def brute_force(channels: DataFrame, least: int = 20) -> DataFrame:
    hits = channels.filter((F.col("contacts") >= least) & F.col("port").isin(*AUTH_PORTS))
    return _findings(hits, "brute_force", "high", 68, "Repeated log-ins", "client", "server", "port", ["T1110"], _n("contacts", "contacts"))


def lateral_movement(channels: DataFrame, least: int = 4, victims: int = 16) -> DataFrame:
    inside = channels.filter((F.col("bytes_out") >= B.TWO_WAY) & (F.col("bytes_in") >= B.TWO_WAY) & F.col("port").isin(*LATERAL_PORTS) & ~is_external(F.col("client")) & ~is_external(F.col("server")))
    g = inside.groupBy("client", "port").agg(F.array_sort(F.collect_set("server")).alias("servers"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns")).filter(F.size("servers") >= least).withColumn("n", F.size("servers"))
    return _findings(g, "lateral_movement", "high", 70, "Sessions to several inside hosts", "client", None, "port", ["T1021"], _n("n", "hosts"), victims=F.slice("servers", 1, victims))


def exposed_access(channels: DataFrame) -> DataFrame:
    one_side = is_external(F.col("client")) != is_external(F.col("server"))
    hits = channels.filter((F.col("bytes_out") >= B.TWO_WAY) & (F.col("bytes_in") >= B.TWO_WAY) & F.col("port").isin(*LATERAL_PORTS) & one_side)
    return _findings(hits, "exposed_remote_access", "high", 66, F.when(is_external(F.col("client")), "Remote access from outside").otherwise("Remote access to outside"), "client", "server", "port", ["T1133"], _n("contacts", "contacts"))


def credentials(packets: DataFrame) -> DataFrame:
    return _findings(B.exposures(packets, "cleartext_cred"), "cleartext_creds", "high", 66, "Credentials in clear text", "src", "dst", "port", ["T1552"], F.col("kind"), _n("exposures", "exposures"))


def personal_data(packets: DataFrame) -> DataFrame:
    return _findings(B.exposures(packets, "pii"), "pii_exposure", "high", 64, "Personal data in clear text", "src", "dst", "port", ["T1040"], F.col("kind"), _n("exposures", "exposures"))


def arp_spoofing(packets: DataFrame, least: int = 2) -> DataFrame:
    hits = B.arp_claims(packets).filter(F.col("macs") >= max(2, least))
    return _findings(hits, "arp_spoof", "high", 70, "Several stations claim one address", "ip", None, None, ["T1557.002"], _n("macs", "stations"))


def tool_agents(packets: DataFrame) -> DataFrame:
    return _findings(B.tool_agents(packets), "suspicious_ua", "high", 66, F.concat(F.lit("Tool: "), F.col("tool")), "src", None, None, ["T1595"], _n("hits", "requests"), F.col("sample"))


def disguised_downloads(packets: DataFrame) -> DataFrame:
    return _findings(B.disguised(packets), "disguised_download", "high", 70, "Executable under a harmless type", "client", "server", None, ["T1036", "T1105"], _n("hits", "downloads"))


def cryptomining(packets: DataFrame) -> DataFrame:
    return _findings(B.mining(packets).filter("pool_msgs > 0"), "cryptomining", "high", 62, "Mining pool traffic", "miner", "pool", None, ["T1496"], _n("miner_msgs", "from miner"), _n("pool_msgs", "from pool"))


def dns_tunnels(packets: DataFrame, queries: int = 30, entropy: float = 3.5, label: int = 20) -> DataFrame:
    hits = B.dns_volume(packets).filter((F.col("queries") >= queries) & (F.col("mean_entropy") >= entropy) & (F.col("longest") >= label))
    return _findings(hits, "dns_tunnel", "high", 74, "Data in name queries", "src", "resolver", None, ["T1071.004"], _n("queries", "queries"), F.format_string("mean entropy %.2f", F.col("mean_entropy")), F.col("sample"))


def generated_domains(packets: DataFrame, least: int = 10, many: int = 25) -> DataFrame:
    hits = B.generated_names(packets).filter(F.col("suspects") >= least)
    high = F.col("suspects") >= many
    return _findings(hits, "dga", F.when(high, "high").otherwise("medium"), F.when(high, 76).otherwise(58), "Many generated names", "src", None, None, ["T1568.002"], _n("suspects", "domains"), _n("queries", "queries"))


def weak_tls(sessions: DataFrame) -> DataFrame:
    level = B.tls_weakness(F.col("tls_version"), F.col("tls_cipher"))
    hits = sessions.withColumn("level", level).filter("level is not null")
    pick = lambda a, b, c: F.when(F.col("level") == 3, a).when(F.col("level") == 2, b).otherwise(c)
    return _findings(hits, "weak_tls", pick("high", "medium", "low"), pick(64, 44, 28), "Weak TLS parameters", "client", "server", "port", ["T1040"], F.concat_ws(" ", "tls_version", "tls_cipher"))


# Rank of certificate issues; 3 is the worst.
CERT_ISSUES = {"expired": 3, "self_signed": 2, "name_mismatch": 2, "weak_key": 2, "weak_signature": 2, "not_yet_valid": 3, "long_validity": 1}


def certificate_health(observed: DataFrame) -> DataFrame:
    """``observed``: (client, server, port, issues array, first_ns, last_ns).  Two kinds of issues raise the severity, to high at most."""
    table = F.create_map(*[F.lit(x) for kv in CERT_ISSUES.items() for x in kv])
    o = observed.withColumn("kinds", F.array_distinct(F.filter("issues", lambda i: table[i].isNotNull()))).filter(F.size("kinds") > 0).withColumn("worst", F.array_max(F.transform("kinds", lambda i: table[i])))
    several = F.size("kinds") >= 2
    band = F.least(F.lit(3), F.col("worst") + F.when(several, 1).otherwise(0))
    severity = F.when(band == 3, "high").when(band == 2, "medium").otherwise("low")
    score = F.when(F.col("worst") == 3, 68).when(F.col("worst") == 2, 48).otherwise(30) + F.when(several, 6).otherwise(0)
    return _findings(o, "tls_cert_health", severity, score, "Certificate problems", "client", "server", "port", ["T1573"], F.concat_ws(",", "kinds"))


def icmp_tunnels(packets: DataFrame, echoes: int = 32, mean: int = 512) -> DataFrame:
    hits = B.icmp_echoes(packets).filter((F.col("echoes") >= echoes) & (F.expr("data div echoes") >= mean) & is_external(F.col("dst")))
    return _findings(hits, "icmp_tunnel", "high", 70, "Data in echo requests", "src", "dst", None, ["T1095", "T1048.003"], _n("echoes", "echoes"), F.concat(human_bytes(F.col("data")), F.lit(" carried")))


def industrial_writes(packets: DataFrame) -> DataFrame:
    return _findings(B.ot_writes(packets), "ics_control_command", "medium", 55, "Write commands to a controller", "client", "plc", "port", ["T0855", "T0831"], _n("commands", "commands"), F.col("functions"))


def known_malware(files: DataFrame, bad: DataFrame) -> DataFrame:
    """``files``: (client, server, port, sha256, first_ns, last_ns); ``bad``: (sha256)."""
    return _findings(files.join(F.broadcast(bad.select("sha256").distinct()), "sha256", "left_semi"), "malware_download", "critical", 95, "Known malware", "client", "server", "port", ["T1105"], F.col("sha256"))


def suspicious_content(files: DataFrame, signatures: DataFrame) -> DataFrame:
    """``files``: (client, server, port, sha256, body, executable, first_ns, last_ns); ``signatures``: (name, pattern, needs_executable, high).

    The signature list is short and fixed, so each body meets all of it in one pass.
    """
    hit = files.join(F.broadcast(signatures), F.expr("instr(body, pattern) > 0") & (~F.col("needs_executable") | F.col("executable")))
    g = hit.groupBy("client", "server", "port", "sha256", "first_ns", "last_ns").agg(F.bool_or("high").alias("high"), F.concat_ws(",", F.array_sort(F.collect_set("name"))).alias("names"))
    return _findings(g, "malware_signature", F.when(F.col("high"), "high").otherwise("medium"), F.when(F.col("high"), 80).otherwise(55), "Suspicious content", "client", "server", "port", ["T1027"], F.col("names"), F.col("sha256"))


def indicator_matches(inventory: DataFrame, indicators: DataFrame) -> DataFrame:
    """``inventory``: (kind, value, src_ip, dst_ip, first_ns, last_ns); ``indicators``: (kind, value), kinds ip, domain and hash."""
    hits = inventory.join(indicators.select("kind", "value").distinct(), ["kind", "value"])
    hashed = F.col("kind") == "hash"
    return _findings(hits.withColumn("what", F.concat_ws(":", "kind", "value")), "ioc_match", F.when(hashed, "critical").otherwise("high"), F.when(hashed, 100).otherwise(90), "Listed indicator", "src_ip", "dst_ip", None, [], F.col("what"))


def without_explained_sweeps(sweeps: DataFrame, lateral: DataFrame) -> DataFrame:
    """A sweep that a lateral movement of the same source and port explains is dropped."""
    return sweeps.join(lateral.select("src_ip", "dst_port"), ["src_ip", "dst_port"], "left_anti").select(*COLUMNS)


#: Packet columns of which at least one is there in each packet that a detector looks at, and the others that detectors read.
SIGNALS = ["dns_qname", "icmp_type", "cleartext_cred", "pii", "arp_ip", "http_ua", "stratum", "ot_control"]
BESIDE = ["idx", "ts_ns", "src_ip", "dst_ip", "dst_port", "transport", "payload_len", "arp_mac", "download_disguised"]


def signals(packets: DataFrame) -> DataFrame:
    """The packets, and of them the columns, that the detectors below read."""
    return packets.filter(reduce(Column.__or__, [F.col(c).isNotNull() for c in SIGNALS], F.coalesce("download_disguised", F.lit(False)))).select(*BESIDE, *SIGNALS)


def all_findings(packets: DataFrame, flows: DataFrame, contacts: DataFrame) -> DataFrame:
    """Every detector over one capture.

    The packets that some detector looks at and the channels are written once, so that packets and contacts are read once
    each for all detectors of them.
    """
    packets = checkpointed(signals(packets))
    ch = checkpointed(B.channels(contacts))
    lateral = lateral_movement(ch)
    parts = [
        beacons(ch), exfiltration(ch), without_explained_sweeps(host_sweeps(contacts), lateral), port_scans(contacts), arp_spoofing(packets), syn_floods(contacts), tool_agents(packets), disguised_downloads(packets), cryptomining(packets), brute_force(ch),
        lateral, exposed_access(ch), credentials(packets), personal_data(packets), dns_tunnels(packets), generated_domains(packets), weak_tls(B.tls_sessions(contacts)), icmp_tunnels(packets), industrial_writes(packets),
    ]
    return reduce(DataFrame.unionByName, parts)
