"""Queries over the test tables, one for each operator, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.order import checkpointed
from flowquarry.functions.tables import constant
from flowquarry.operators import behavior as B
from flowquarry.operators import classify, console, correlate, detect, flow, rollups
from flowquarry.plans import fixtures
from flowquarry.plans.oracle import external, num, sql
from flowquarry.schema import CATEGORIES, DOH_HOSTS, FLOW_COLUMNS, NICE_WIDTHS, SEVERITIES, STAGE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: Relations that later queries of the same application read again, by application, tables and name.
_KEPT: dict[tuple[str, str, str], DataFrame] = {}


class Capture:
    """The relations of one capture, each made when first asked for.

    Scored flows and findings are what a capture leaves behind; they are written once to the shared
    folder and read by every query after that.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def _get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def _keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _KEPT:
            _KEPT[key] = checkpointed(make())
        return _KEPT[key]

    @property
    def packets(self) -> DataFrame:
        return self._get("packets", lambda: fixtures.packets(self.spark, self.sf_dir))

    @property
    def raw(self) -> DataFrame:
        return self._get("raw", lambda: flow.derived(flow.fold(self.packets)))

    @property
    def flows(self) -> DataFrame:
        def make() -> DataFrame:
            # Distinct values and scanners are found from the classified flows, so these are written before.
            base = classify.with_scanners(checkpointed(classify.classified(self.raw)))
            return classify.scored(classify.enriched(base, fixtures.feed(self.spark)))

        return self._keep("flows", make)

    @property
    def table(self) -> DataFrame:
        """The flow table without its number."""
        f = flow.oriented(self.flows)
        return f.withColumns({"start_ts": F.timestamp_micros(F.expr("first_ns div 1000")), "end_ts": F.timestamp_micros(F.expr("last_ns div 1000")), "capture_id": F.lit(1).cast("long")})

    @property
    def contacts(self) -> DataFrame:
        return self._get("contacts", lambda: flow.contacts(self.flows))

    @property
    def channels(self) -> DataFrame:
        return B.channels(self.contacts)

    @property
    def findings(self) -> DataFrame:
        return self._keep("findings", lambda: detect.all_findings(self.packets, self.flows, self.contacts))


def query(name: str, tail: str | None = None):
    """Register a query; ``tail`` is the DuckDB SQL over the oracle's relations."""

    def register(f: Callable[[Capture], DataFrame]) -> Callable[[Capture], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Capture(spark, sf_dir))
        if tail is not None:
            ORACLE[name] = sql(tail)
        return f

    return register


def numbered(c: Capture) -> DataFrame:
    from flowquarry.functions.net import ip_key
    from flowquarry.functions.order import number_rows

    return number_rows(c.table, "flow_id", F.col("first_ns"), F.col("last_ns"), ip_key(F.col("lo_ip")), F.col("lo_port"), ip_key(F.col("hi_ip")), F.col("hi_port"), F.col("proto"))


I64 = lambda x: f"CAST({x} AS BIGINT)"

# --- flows -----------------------------------------------------------------------------------------------
_KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port"]
query("flow_key", "SELECT idx, CASE WHEN fwd THEN src_ip ELSE dst_ip END AS lo_ip, CASE WHEN fwd THEN dst_ip ELSE src_ip END AS hi_ip, fwd FROM keyed")(lambda c: flow.keyed(c.packets).select("idx", "lo_ip", "hi_ip", "fwd"))
query("flow_fold", f"SELECT {', '.join(_KEY)}, pkts_fwd, pkts_rev, bytes_fwd, bytes_rev, flags_fwd, flags_rev, ttl_fwd, ttl_rev FROM flow_raw")(lambda c: c.raw.select(*_KEY, "pkts_fwd", "pkts_rev", "bytes_fwd", "bytes_rev", F.col("flags_fwd").cast("int"), F.col("flags_rev").cast("int"), F.col("ttl_fwd").cast("int"), F.col("ttl_rev").cast("int")))
query("flow_initiator", f"SELECT {', '.join(_KEY)}, init_fwd FROM flow_raw")(lambda c: c.raw.select(*_KEY, "init_fwd"))
query("flow_sticky", f"SELECT {', '.join(_KEY)}, sni, ja3, ja4, ja3s, http_host, http_ua, tls_version, tls_cipher, hassh, hassh_server FROM flow_raw")(lambda c: c.raw.select(*_KEY, *flow.STICKY))
query("flow_l7", f"SELECT {', '.join(_KEY)}, observed FROM flow_raw")(lambda c: c.raw.select(*_KEY, "observed"))
query("flow_ts_known", f"SELECT {', '.join(_KEY)}, first_ns, last_ns FROM flow_raw")(lambda c: c.raw.select(*_KEY, "first_ns", "last_ns"))
query("flow_derived", f"SELECT {', '.join(_KEY)}, pkts, bytes, duration_ns, established FROM shaped")(lambda c: c.raw.select(*_KEY, "pkts", "bytes", "duration_ns", "established"))
query("flow_order", "SELECT flow_id, src_ip, dst_ip, src_port, dst_port FROM flow")(lambda c: numbered(c).select("flow_id", "src_ip", "dst_ip", "src_port", "dst_port"))
query("flow_orient", "SELECT src_ip, dst_ip, src_port, dst_port, bytes_c2s, bytes_s2c, tcp_flags_c2s, tcp_flags_s2c, ttl_min_c2s FROM flow")(lambda c: flow.oriented(c.raw).select("src_ip", "dst_ip", "src_port", "dst_port", "bytes_c2s", "bytes_s2c", F.col("tcp_flags_c2s").cast("int"), F.col("tcp_flags_s2c").cast("int"), F.col("ttl_min_c2s").cast("int")))
query(
    "flow_timeout",
    """, g AS (SELECT *, CASE WHEN ts_ns - LAG(ts_ns) OVER w > 120000000000 THEN 1 ELSE 0 END AS gap FROM (SELECT *, CASE WHEN fwd THEN sn ELSE dn END AS ln, CASE WHEN fwd THEN sp ELSE dp END AS lp, CASE WHEN fwd THEN dn ELSE sn END AS hn, CASE WHEN fwd THEN dp ELSE sp END AS hp FROM keyed) WINDOW w AS (PARTITION BY ln, lp, hn, hp, proto ORDER BY ts_ns, idx)),
    e AS (SELECT *, SUM(gap) OVER (PARTITION BY ln, lp, hn, hp, proto ORDER BY ts_ns, idx) AS episode FROM g)
    SELECT CASE WHEN MIN(CASE WHEN fwd THEN 1 ELSE 0 END) = 1 THEN MIN(src_ip) ELSE MIN(CASE WHEN fwd THEN src_ip ELSE dst_ip END) END AS lo_ip, lp AS lo_port, MIN(CASE WHEN fwd THEN dst_ip ELSE src_ip END) AS hi_ip, hp AS hi_port, CAST(episode AS BIGINT) AS episode, COUNT(*) AS pkts FROM e GROUP BY ln, lp, hn, hp, proto, episode""",
)(lambda c: flow.fold(flow.split_idle(c.packets), ["episode"]).select("lo_ip", F.col("lo_port").cast("long"), "hi_ip", F.col("hi_port").cast("long"), "episode", (F.col("pkts_fwd") + F.col("pkts_rev")).alias("pkts")))

# --- classification, enrichment, scores ------------------------------------------------------------------
query("cls_port", f"SELECT {', '.join(_KEY)}, scat AS category, token AS app FROM shaped")(lambda c: classify.with_service(c.raw).select(*_KEY, F.col("service_category").alias("category"), F.col("service").alias("app")))
query("cls_payload", f"SELECT {', '.join(_KEY)}, app_proto, app_proto_src FROM classed")(lambda c: classify.classified(c.raw).select(*_KEY, "app_proto", "app_proto_src"))
query("cls_uplift", f"SELECT {', '.join(_KEY)}, category0 AS category FROM classed")(lambda c: classify.classified(c.raw).select(*_KEY, "category"))
for _name, _cat in (("cls_probe", "scan"), ("cls_tunnel", "tunnel_vpn"), ("cls_beacon_shape", "c2")):
    query(_name, f"SELECT {', '.join(_KEY)} FROM classed WHERE category0 = '{_cat}'")(lambda c, k=_cat: classify.classified(c.raw).filter(F.col("category") == k).select(*_KEY))
query("cls_scanner", f"SELECT {', '.join(_KEY)}, category FROM typed")(lambda c: classify.with_scanners(classify.classified(c.raw)).select(*_KEY, "category"))


def _classes(c: Capture) -> DataFrame:
    from flowquarry.functions.net import cloud_provider, ip_class, is_external

    ips = c.raw.select(F.explode(F.array("lo_ip", "hi_ip")).alias("ip")).distinct()
    return ips.select("ip", ip_class(F.col("ip")).alias("ip_class"), is_external(F.col("ip")).alias("external"), cloud_provider(F.col("ip")).alias("cloud"))


_IPS = "(SELECT lo_ip AS ip FROM flow_raw UNION SELECT hi_ip FROM flow_raw)"
query("enr_ip_class", f"SELECT ip, {external(num('ip'))} AS external FROM {_IPS}")(lambda c: _classes(c).select("ip", "external"))
query("enr_cloud", f"SELECT ip, CASE WHEN ip LIKE '8.8.8.%' THEN 'Google' WHEN ip LIKE '52.1.%' THEN 'AWS' END AS cloud FROM {_IPS}")(lambda c: _classes(c).select("ip", "cloud"))
for _name, _col in (("enr_ioc_ip", "ioc_ip"), ("enr_ioc_domain", "ioc_domain"), ("enr_ioc_fp", "ioc_fp")):
    query(_name, f"SELECT {', '.join(_KEY)}, {_col} FROM flows")(lambda c, k=_col: c.flows.select(*_KEY, k))
query("enr_attack", "SELECT category, CASE category WHEN 'scan' THEN 'T1046' WHEN 'c2' THEN 'T1071' WHEN 'tunnel_vpn' THEN 'T1572' WHEN 'anomalous' THEN 'T1095' ELSE '' END AS attack, COUNT(*) AS flows FROM flows GROUP BY category")(lambda c: c.flows.groupBy("category", F.concat_ws(",", "attack").alias("attack")).agg(F.count(F.lit(1)).alias("flows")))
query("scr_flow", f"SELECT {', '.join(_KEY)}, CAST(threat_score AS INT) AS threat_score, severity, ioc FROM flows")(lambda c: c.flows.select(*_KEY, "threat_score", "severity", "ioc"))
query("scr_band", "SELECT severity, MIN(CAST(threat_score AS INT)) AS least, MAX(CAST(threat_score AS INT)) AS most FROM flows GROUP BY severity")(lambda c: c.flows.groupBy("severity").agg(F.min("threat_score").alias("least"), F.max("threat_score").alias("most")))

# --- rollups ---------------------------------------------------------------------------------------------
query("agg_totals", f"SELECT COUNT(*) AS packets, {I64('SUM(wire_len)')} AS wire_bytes, {I64('SUM(cap_len)')} AS captured_bytes, COUNT(*) FILTER (WHERE src_ip IS NULL) AS non_ip, MIN(ts_ns) FILTER (WHERE ts_known) AS first_ns, MAX(ts_ns) FILTER (WHERE ts_known) AS last_ns, (SELECT COUNT(*) FROM flow_raw) AS flows, MAX(ts_ns) FILTER (WHERE ts_known) - MIN(ts_ns) FILTER (WHERE ts_known) AS duration_ns FROM packet")(lambda c: rollups.totals(c.packets, c.raw))
_BUCKET = "CASE WHEN app_proto IN ('http', 'http-proxy') THEN 'http' WHEN app_proto IN ('https', 'tls') THEN 'https' WHEN app_proto IN ('quic', 'http3') THEN 'quic' WHEN app_proto IN ('dns', 'mdns', 'dot') THEN 'dns' WHEN app_proto IN ('modbus', 'dnp3', 's7comm', 'bacnet', 'ethernet-ip', 'mqtt', 'mqtts', 'coap') THEN 'ot' ELSE 'other' END"
_FAMILIES = ", ".join(f"(SELECT {I64('COALESCE(SUM(pkts), 0)')} FROM flows WHERE {_BUCKET} = '{x}') AS {x}" for x in ("http", "https", "quic", "dns", "ot", "other"))
query("agg_proto_counts", f"SELECT COUNT(*) FILTER (WHERE transport = 'tcp') AS tcp, COUNT(*) FILTER (WHERE transport = 'udp') AS udp, {_FAMILIES} FROM packet")(lambda c: rollups.protocol_counts(c.packets, c.flows))
query(
    "agg_top_talkers",
    f""", p AS (SELECT ip, COUNT(*) AS pkts, {I64('SUM(wire_len)')} AS bytes FROM (SELECT src_ip AS ip, wire_len FROM packet UNION ALL SELECT dst_ip, wire_len FROM packet) WHERE ip IS NOT NULL GROUP BY ip),
    f AS (SELECT ip, COUNT(*) AS flows FROM (SELECT lo_ip AS ip FROM flow_raw UNION ALL SELECT hi_ip FROM flow_raw) GROUP BY ip)
    SELECT p.ip, pkts, bytes, COALESCE(flows, 0) AS flows FROM p LEFT JOIN f USING (ip) ORDER BY bytes DESC, pkts DESC, ip LIMIT 50""",
)(lambda c: rollups.top_talkers(c.packets, c.raw))
query("agg_unique_hosts", "SELECT COUNT(DISTINCT ip) AS hosts FROM (SELECT src_ip AS ip FROM packet UNION ALL SELECT dst_ip FROM packet)")(lambda c: rollups.unique_hosts(c.packets))
_L4 = "CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 132 THEN 'sctp' WHEN 1 THEN 'icmp' ELSE 'other' END"
query("agg_proto_hierarchy", f"SELECT concat_ws('.', 'ip', {_L4}, CASE WHEN proto IN (6, 17) THEN {_BUCKET} END) AS path, {I64('SUM(pkts)')} AS pkts, {I64('SUM(bytes)')} AS bytes FROM flows GROUP BY 1 ORDER BY bytes DESC, pkts DESC, path LIMIT 30")(lambda c: rollups.protocol_hierarchy(c.flows))
query(
    "agg_sunburst",
    f""", x AS (SELECT {_L4} AS l4, CASE WHEN proto IN (6, 17) THEN {_BUCKET} END AS l7, pkts, bytes FROM flows), y AS (SELECT 'ip' AS path, 1 AS depth, pkts, bytes FROM x UNION ALL SELECT 'ip.' || l4, 2, pkts, bytes FROM x UNION ALL SELECT 'ip.' || l4 || '.' || l7, 3, pkts, bytes FROM x WHERE l7 IS NOT NULL)
    SELECT path, CAST(depth AS INT) AS depth, {I64('SUM(pkts)')} AS pkts, {I64('SUM(bytes)')} AS bytes FROM y GROUP BY path, depth""",
)(lambda c: rollups.sunburst(c.flows))
query("agg_port_hist", f"SELECT LEAST(src_port, dst_port) AS port, transport, COUNT(*) AS pkts, {I64('SUM(wire_len)')} AS bytes FROM packet WHERE transport IN ('tcp', 'udp', 'sctp') GROUP BY 1, 2 ORDER BY pkts DESC, bytes DESC, port, transport LIMIT 50")(lambda c: rollups.port_histogram(c.packets))
_SPAN = "(SELECT MIN(ts_ns // 1000000000) AS lo, MAX(ts_ns // 1000000000) AS hi FROM packet WHERE ts_known)"
_TIME = f"""w AS (SELECT MIN(w) AS w FROM (SELECT UNNEST({NICE_WIDTHS}) AS w) JOIN {_SPAN} ON hi // w - lo // w + 1 <= 1000),
    hist AS (SELECT (ts_ns // 1000000000) // w * w AS bucket, COUNT(*) AS pkts, CAST(SUM(wire_len) AS BIGINT) AS bytes, CAST(w AS INT) AS width FROM packet, w WHERE ts_known GROUP BY 1, w)"""
query("agg_time_hist", f", {_TIME} SELECT * FROM hist")(lambda c: rollups.time_histogram(c.packets))
query("agg_timeline_down", f", {_TIME}, n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY bucket) - 1 AS i, COUNT(*) OVER () AS n FROM hist) SELECT bucket, pkts, bytes FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY i * LEAST(n, 100) // n ORDER BY pkts DESC, bucket) AS r FROM n) WHERE r = 1")(lambda c: rollups.downsampled(rollups.time_histogram(c.packets), 100))
query("agg_heat", f", {_TIME} SELECT bucket, ROUND(LN(1 + bytes) / LN(1 + (SELECT MAX(bytes) FROM hist)), 6) AS heat, bucket = (SELECT bucket FROM hist ORDER BY bytes DESC, bucket LIMIT 1) AS is_peak FROM hist")(lambda c: rollups.heat(rollups.time_histogram(c.packets)))
_SLOT = "CASE WHEN wire_len <= 63 THEN 0 WHEN wire_len <= 127 THEN 1 WHEN wire_len <= 255 THEN 2 WHEN wire_len <= 511 THEN 3 WHEN wire_len <= 1023 THEN 4 WHEN wire_len <= 1517 THEN 5 ELSE 6 END"
query("agg_size_hist", f"SELECT CAST(s.slot AS INT) AS slot, s.upper, COUNT(p.idx) AS pkts FROM (VALUES (0, 63), (1, 127), (2, 255), (3, 511), (4, 1023), (5, 1517), (6, NULL)) s(slot, upper) LEFT JOIN packet p ON {_SLOT} = s.slot GROUP BY 1, 2")(lambda c: rollups.size_histogram(c.packets))
query("agg_ttl_hist", "SELECT ttl, COUNT(*) AS pkts FROM packet WHERE ttl > 0 GROUP BY ttl ORDER BY pkts DESC, ttl LIMIT 16")(lambda c: rollups.ttl_histogram(c.packets))
query("agg_category", f"SELECT CAST(g.place AS INT) AS place, g.category, COUNT(f.lo_ip) AS flows, {I64('COALESCE(SUM(pkts), 0)')} AS pkts, {I64('COALESCE(SUM(bytes), 0)')} AS bytes FROM (VALUES {', '.join(f'({i}, {c!r})' for i, c in enumerate(CATEGORIES))}) g(place, category) LEFT JOIN flows f ON f.category = g.category GROUP BY 1, 2")(lambda c: rollups.category_breakdown(c.flows))
query("agg_severity_counts", "SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE severity = '{s}') AS {s}" for s in SEVERITIES) + " FROM flows")(lambda c: rollups.severity_counts(c.flows))
query("agg_ip_threat", f"SELECT ip, MAX(CAST(threat_score AS INT)) AS score, COUNT(*) AS flows, {I64('SUM(bytes)')} AS bytes, BOOL_OR(ioc) AS ioc FROM (SELECT lo_ip AS ip, threat_score, bytes, ioc FROM flows UNION ALL SELECT hi_ip, threat_score, bytes, ioc FROM flows WHERE hi_ip <> lo_ip) GROUP BY ip")(lambda c: rollups.ip_threat(c.flows, None).select("ip", "score", "flows", "bytes", "ioc"))
query("agg_ip_threat_cards")(lambda c: rollups.ip_threat(c.flows))
query("agg_findings_uplift")(lambda c: rollups.findings_uplift(rollups.ip_threat(c.flows, None), c.findings))
query("agg_domains", f"SELECT lower(sni) AS domain, COUNT(*) AS flows, {I64('SUM(bytes)')} AS bytes FROM flows WHERE sni LIKE '%.%' AND NOT regexp_matches(sni, '^[0-9.]+$|:') GROUP BY 1 ORDER BY flows DESC, bytes DESC, domain LIMIT 50")(lambda c: rollups.domains(c.flows))
query("agg_http_hosts", "SELECT http_host, COUNT(*) AS flows FROM flows WHERE http_host <> '' GROUP BY 1 ORDER BY flows DESC, http_host LIMIT 15")(lambda c: rollups.counted(c.flows, "http_host"))
query("agg_user_agents", "SELECT http_ua, COUNT(*) AS flows FROM flows WHERE http_ua <> '' GROUP BY 1 ORDER BY flows DESC, http_ua LIMIT 15")(lambda c: rollups.counted(c.flows, "http_ua"))
query(
    "agg_passive_dns",
    """, q AS (SELECT *, LAST_VALUE(dns_qname IGNORE NULLS) OVER (PARTITION BY LEAST(sn, dn), GREATEST(sn, dn), LEAST(sp, dp), GREATEST(sp, dp), proto ORDER BY idx) AS name FROM keyed WHERE app_proto = 'dns')
    SELECT dns_answer AS ip, ARG_MIN(name, idx) AS domain, COUNT(*) AS resolutions FROM q WHERE dns_answer IS NOT NULL AND name IS NOT NULL GROUP BY 1 ORDER BY resolutions DESC, ip LIMIT 50""",
)(lambda c: rollups.passive_dns(c.packets))
query("agg_arp_hosts", "SELECT arp_ip AS ip, ARG_MIN(arp_mac, idx) AS mac FROM packet WHERE arp_ip IS NOT NULL GROUP BY 1 ORDER BY ip LIMIT 64")(lambda c: rollups.arp_hosts(c.packets))
query("agg_dhcp_hosts", "SELECT dhcp_mac AS mac, ARG_MIN(dhcp_hostname, idx) FILTER (WHERE dhcp_hostname IS NOT NULL) AS hostname, ARG_MIN(dhcp_vendor, idx) FILTER (WHERE dhcp_vendor IS NOT NULL) AS vendor FROM packet WHERE dhcp_mac IS NOT NULL GROUP BY 1 ORDER BY mac LIMIT 64")(lambda c: rollups.dhcp_hosts(c.packets))
query("agg_downloads", "SELECT dst_ip AS client, src_ip AS server, download AS class, COUNT(*) AS n FROM packet WHERE download IS NOT NULL GROUP BY 1, 2, 3 ORDER BY n DESC, client, server, class LIMIT 64")(lambda c: rollups.downloads(c.packets))
_DOH = "(" + " OR ".join(f"lower(sni) = '{h}' OR lower(sni) LIKE '%.{h}'" for h in DOH_HOSTS) + ")"
query("agg_encrypted_dns", f"SELECT CASE WHEN lo_port = 443 THEN hi_ip ELSE lo_ip END AS host, lower(sni) AS resolver, COUNT(*) AS flows FROM flows WHERE (lo_port = 443 OR hi_port = 443) AND {_DOH} GROUP BY 1, 2 ORDER BY flows DESC, host, resolver LIMIT 64")(lambda c: rollups.encrypted_dns(c.flows))
query("agg_flow_stats", f"SELECT COUNT(*) AS flows, {I64('SUM(bytes)')} AS bytes, {I64('SUM(pkts)')} AS pkts, COUNT(*) FILTER (WHERE ioc) AS iocs, (SELECT string_agg(category, ',' ORDER BY n DESC, category) FROM (SELECT category, COUNT(*) AS n FROM flows GROUP BY 1 ORDER BY n DESC, category LIMIT 3)) AS top FROM flows")(lambda c: rollups.flow_stats(c.flows))
query("agg_proto_mix")(lambda c: rollups.protocol_mix(c.packets, c.flows))
query("agg_attack_coverage")(lambda c: rollups.attack_coverage(c.findings))
query("agg_threat_graph")(lambda c: rollups.threat_graph(c.findings, rollups.ip_threat(c.flows, None))[1])
query("agg_criticals")(lambda c: correlate.incidents(c.findings).agg(F.count_if(F.col("severity") == "critical").alias("criticals")))
_SEVCAT = "CASE WHEN category = 'c2' THEN 'critical' WHEN category IN ('anomalous', 'scan') THEN 'high' WHEN category IN ('tunnel_vpn', 'remote_access') THEN 'medium' WHEN category IN ('file_transfer', 'email', 'iot_ot') THEN 'low' ELSE 'info' END"
query("agg_sev_by_category", f"SELECT {_SEVCAT} AS severity, COUNT(*) AS flows, {I64('SUM(pkts)')} AS pkts, {I64('SUM(bytes)')} AS bytes FROM flows GROUP BY ROLLUP ({_SEVCAT})")(lambda c: rollups.severity_by_category(c.flows))
query("agg_score_terms")(lambda c: rollups.score_terms(c.flows.select("lo_ip", "lo_port", "hi_ip", "hi_port", "evidence")).groupBy("label", "points").agg(F.count(F.lit(1)).alias("n")))
query("agg_tcp_flags", "SELECT COALESCE(tcp_flags, 0) AS flags, concat_ws('|', CASE WHEN tcp_flags & 1 <> 0 THEN 'FIN' END, CASE WHEN tcp_flags & 2 <> 0 THEN 'SYN' END, CASE WHEN tcp_flags & 4 <> 0 THEN 'RST' END, CASE WHEN tcp_flags & 8 <> 0 THEN 'PSH' END, CASE WHEN tcp_flags & 16 <> 0 THEN 'ACK' END) AS label, COUNT(*) AS pkts FROM packet GROUP BY 1, 2")(lambda c: c.packets.groupBy(F.coalesce("tcp_flags", F.lit(0)).alias("flags"), rollups.flag_names(F.coalesce("tcp_flags", F.lit(0))).alias("label")).agg(F.count(F.lit(1)).alias("pkts")))

# --- behavior --------------------------------------------------------------------------------------------
query("beh_contact", "SELECT client, server, port, first_ns, bytes_out, bytes_in FROM contact")(lambda c: c.contacts.select("client", "server", "port", "first_ns", "bytes_out", "bytes_in"))
query("beh_channel", "SELECT client, server, port, contacts, gaps, ROUND(mean_gap / 1e9, 3) AS mean_gap, ROUND(cv, 4) AS cv, first_ns, last_ns, bytes_out, bytes_in, c2_shape, named, two_way FROM channel")(lambda c: c.channels.select("client", "server", "port", "contacts", "gaps", F.round(F.col("mean_gap") / 1e9, 3).alias("mean_gap"), F.round("cv", 4).alias("cv"), "first_ns", "last_ns", "bytes_out", "bytes_in", "c2_shape", "named", "two_way"))
query("beh_fanout", "SELECT client, port, COUNT(DISTINCT server) AS servers, MIN(first_ns) AS first_ns, MAX(last_ns) AS last_ns FROM contact GROUP BY 1, 2")(lambda c: B.fan_out(c.contacts))
query("beh_portscan", "SELECT client, server, COUNT(DISTINCT port) AS ports, MIN(first_ns) AS first_ns, MAX(last_ns) AS last_ns FROM contact WHERE NOT (bytes_out >= 512 AND bytes_in >= 512) GROUP BY 1, 2")(lambda c: B.probed_ports(c.contacts))
query("beh_synflood", "SELECT server, port, COUNT(*) AS attempts, COUNT(DISTINCT client) AS sources, MIN(first_ns) AS first_ns, MAX(last_ns) AS last_ns FROM contact WHERE proto = 6 AND bytes_out < 256 GROUP BY 1, 2")(lambda c: B.half_open(c.contacts))
query("beh_dns", "SELECT src_ip AS src, dst_ip AS resolver, COUNT(*) AS queries, ARG_MIN(dns_qname, idx) AS sample FROM packet WHERE dns_qname IS NOT NULL AND dst_port = 53 GROUP BY 1, 2")(lambda c: B.dns_volume(c.packets).select("src", "resolver", "queries", "sample"))
query("beh_dns_entropy")(lambda c: B.dns_volume(c.packets))
query("beh_dga")(lambda c: B.generated_names(c.packets))
query("beh_icmp", f"SELECT src_ip AS src, dst_ip AS dst, COUNT(*) AS echoes, {I64('SUM(payload_len - 8)')} AS data, MAX(payload_len - 8) AS largest, MIN(ts_ns) AS first_ns, MAX(ts_ns) AS last_ns FROM packet WHERE icmp_type = 8 GROUP BY 1, 2")(lambda c: B.icmp_echoes(c.packets))
for _name, _col in (("beh_creds", "cleartext_cred"), ("beh_pii", "pii")):
    query(_name, f"SELECT src_ip AS src, dst_ip AS dst, dst_port AS port, ARG_MIN({_col}, idx) AS kind, COUNT(*) AS exposures, MIN(ts_ns) AS first_ns, MAX(ts_ns) AS last_ns FROM packet WHERE {_col} IS NOT NULL GROUP BY 1, 2, 3")(lambda c, k=_col: B.exposures(c.packets, k))
query("beh_arp", "SELECT arp_ip AS ip, COUNT(DISTINCT arp_mac) AS macs, MIN(ts_ns) AS first_ns, MAX(ts_ns) AS last_ns FROM packet WHERE arp_ip IS NOT NULL GROUP BY 1")(lambda c: B.arp_claims(c.packets))
query("beh_ua", "SELECT src_ip AS src, ARG_MIN(CASE WHEN http_ua LIKE 'sqlmap%' THEN 'sqlmap' ELSE 'Nikto' END, idx) AS tool, COUNT(*) AS hits, ARG_MIN(http_ua, idx)[:120] AS sample, MIN(ts_ns) AS first_ns, MAX(ts_ns) AS last_ns FROM packet WHERE http_ua LIKE 'sqlmap%' OR http_ua LIKE 'Nikto%' GROUP BY 1")(lambda c: B.tool_agents(c.packets))
query("beh_disguised", "SELECT dst_ip AS client, src_ip AS server, COUNT(*) AS hits, MIN(ts_ns) AS first_ns, MAX(ts_ns) AS last_ns FROM packet WHERE download_disguised GROUP BY 1, 2")(lambda c: B.disguised(c.packets))
query("beh_stratum", "SELECT CASE WHEN stratum = 'miner' THEN src_ip ELSE dst_ip END AS miner, CASE WHEN stratum = 'miner' THEN dst_ip ELSE src_ip END AS pool, COUNT(*) FILTER (WHERE stratum = 'miner') AS miner_msgs, COUNT(*) FILTER (WHERE stratum <> 'miner') AS pool_msgs, MIN(ts_ns) AS first_ns, MAX(ts_ns) AS last_ns FROM packet WHERE stratum IS NOT NULL GROUP BY 1, 2")(lambda c: B.mining(c.packets))
query("beh_ot", "SELECT src_ip AS client, dst_ip AS plc, dst_port AS port, COUNT(*) AS commands, string_agg(DISTINCT ot_control, ',' ORDER BY ot_control) AS functions, MIN(ts_ns) AS first_ns, MAX(ts_ns) AS last_ns FROM packet WHERE ot_control IS NOT NULL GROUP BY 1, 2, 3")(lambda c: B.ot_writes(c.packets))
query("beh_weak_tls", "SELECT client, server, port, ARG_MIN(tls_version, (first_ns, lo_port, hi_port)) AS tls_version, ARG_MIN(tls_cipher, (first_ns, lo_port, hi_port)) AS tls_cipher, MIN(first_ns) AS first_ns, MAX(last_ns) AS last_ns FROM contact WHERE tls_version IS NOT NULL GROUP BY 1, 2, 3")(lambda c: B.tls_sessions(c.contacts))
query("beh_ja3", "SELECT client, string_agg(DISTINCT ja3, ',' ORDER BY ja3) AS ja3s, COUNT(DISTINCT ja3) AS n FROM contact WHERE ja3 IS NOT NULL GROUP BY 1")(lambda c: B.ja3_sets(c.contacts))
query("beh_hours", "SELECT client, CAST((first_ns // 3600000000000) % 24 AS INT) AS hour, COUNT(*) AS contacts FROM contact GROUP BY 1, 2")(lambda c: B.contact_hours(c.contacts))
query("beh_catmix", "SELECT client, category, COUNT(*) AS contacts FROM contact GROUP BY 1, 2")(lambda c: B.category_mix(c.contacts))

# --- detectors -------------------------------------------------------------------------------------------
_SHOW = ["kind", "severity", "score", "src_ip", "dst_ip", "dst_port"]


def _det(name: str, make: Callable[[Capture], DataFrame], tail: str | None = None) -> None:
    query(name, tail)(lambda c: make(c).select(*_SHOW))


def _f(kind: str, severity: str, score: str, src: str, dst: str, port: str, frm: str) -> str:
    return f"SELECT '{kind}' AS kind, {severity} AS severity, CAST({score} AS INT) AS score, {src} AS src_ip, {dst} AS dst_ip, CAST({port} AS INT) AS dst_port FROM {frm}"


_LAT = "(22, 23, 135, 445, 3389, 5900, 5985, 5986)"
_EXT_C, _EXT_S = external(num("client")), external(num("server"))
_SWEEP = "(SELECT client, port, COUNT(DISTINCT server) AS n FROM contact GROUP BY 1, 2) WHERE n >= 16 AND port NOT IN (80, 443, 8080, 8443, 53, 123)"
_LATERAL = f"(SELECT client, port, COUNT(DISTINCT server) AS n FROM channel WHERE bytes_out >= 512 AND bytes_in >= 512 AND port IN {_LAT} AND NOT {_EXT_C} AND NOT {_EXT_S} GROUP BY 1, 2) WHERE n >= 4"
_BEACON = f"""(SELECT *, {_EXT_S} AS ext, contacts >= 12 AND cv <= 0.15 AND mean_gap BETWEEN 1e9 AND 86400e9 AS strict FROM channel WHERE port NOT IN (21, 22, 23, 135, 445, 3389, 5900, 5985, 5986))
    WHERE strict OR (contacts >= 8 AND cv <= 0.5 AND mean_gap BETWEEN 1e9 AND 86400e9 AND ext AND bytes_out > 0 AND bytes_in > 0 AND bytes_out + bytes_in <= 4096 * contacts)"""
_SURE = "c2_shape AND NOT named AND contacts >= 20 AND server NOT LIKE '8.8.8.%' AND server NOT LIKE '52.1.%'"
_det("det_beacon", lambda c: detect.beacons(c.channels), _f("beacon", f"CASE WHEN (strict AND ext) OR (NOT strict AND {_SURE}) THEN 'high' ELSE 'medium' END", f"CASE WHEN (strict AND ext) OR (NOT strict AND {_SURE}) THEN 70 WHEN strict THEN 45 ELSE 59 END", "client", "server", "port", _BEACON))
_det("det_exfil", lambda c: detect.exfiltration(c.channels), _f("data_exfil", "CASE WHEN bytes_out >= 100000000 THEN 'critical' ELSE 'high' END", "CASE WHEN bytes_out >= 100000000 THEN 90 ELSE 72 END", "client", "server", "port", f"channel WHERE bytes_out >= 1000000 AND bytes_out >= 4 * (bytes_in + 1) AND {_EXT_S}"))
_det("det_sweep", lambda c: detect.host_sweeps(c.contacts), _f("host_sweep", "'high'", "65", "client", "CAST(NULL AS VARCHAR)", "port", _SWEEP))
_det("det_sweep_suppress", lambda c: detect.without_explained_sweeps(detect.host_sweeps(c.contacts), detect.lateral_movement(c.channels)), _f("host_sweep", "'high'", "65", "client", "CAST(NULL AS VARCHAR)", "port", f"{_SWEEP} AND (client, port) NOT IN (SELECT (client, port) FROM {_LATERAL})"))
_det("det_port_scan", lambda c: detect.port_scans(c.contacts), _f("port_scan", "'high'", "64", "client", "server", "NULL", "(SELECT client, server, COUNT(DISTINCT port) AS n FROM contact WHERE NOT (bytes_out >= 512 AND bytes_in >= 512) GROUP BY 1, 2) WHERE n >= 30"))
_det("det_syn_flood", lambda c: detect.syn_floods(c.contacts), _f("syn_flood", "'high'", "68", "server", "CAST(NULL AS VARCHAR)", "port", "(SELECT server, port, COUNT(*) AS n FROM contact WHERE proto = 6 AND bytes_out < 256 GROUP BY 1, 2) WHERE n >= 200"))
_det("det_brute_force", lambda c: detect.brute_force(c.channels), _f("brute_force", "'high'", "68", "client", "server", "port", "channel WHERE contacts >= 20 AND port IN (21, 22, 23, 3389, 5900)"))
_det("det_lateral", lambda c: detect.lateral_movement(c.channels), _f("lateral_movement", "'high'", "70", "client", "CAST(NULL AS VARCHAR)", "port", _LATERAL))
_det("det_exposed", lambda c: detect.exposed_access(c.channels), _f("exposed_remote_access", "'high'", "66", "client", "server", "port", f"channel WHERE bytes_out >= 512 AND bytes_in >= 512 AND port IN {_LAT} AND {_EXT_C} <> {_EXT_S}"))
_det("det_creds", lambda c: detect.credentials(c.packets), _f("cleartext_creds", "'high'", "66", "src_ip", "dst_ip", "dst_port", "(SELECT DISTINCT src_ip, dst_ip, dst_port FROM packet WHERE cleartext_cred IS NOT NULL)"))
_det("det_pii", lambda c: detect.personal_data(c.packets), _f("pii_exposure", "'high'", "64", "src_ip", "dst_ip", "dst_port", "(SELECT DISTINCT src_ip, dst_ip, dst_port FROM packet WHERE pii IS NOT NULL)"))
_det("det_arp_spoof", lambda c: detect.arp_spoofing(c.packets), _f("arp_spoof", "'high'", "70", "arp_ip", "CAST(NULL AS VARCHAR)", "NULL", "(SELECT arp_ip, COUNT(DISTINCT arp_mac) AS n FROM packet WHERE arp_ip IS NOT NULL GROUP BY 1) WHERE n >= 2"))
_det("det_suspicious_ua", lambda c: detect.tool_agents(c.packets), _f("suspicious_ua", "'high'", "66", "src_ip", "CAST(NULL AS VARCHAR)", "NULL", "(SELECT DISTINCT src_ip FROM packet WHERE lower(http_ua) LIKE '%sqlmap%' OR lower(http_ua) LIKE '%nikto%')"))
_det("det_disguised", lambda c: detect.disguised_downloads(c.packets), _f("disguised_download", "'high'", "70", "dst_ip", "src_ip", "NULL", "(SELECT DISTINCT dst_ip, src_ip FROM packet WHERE download_disguised)"))
_det("det_mining", lambda c: detect.cryptomining(c.packets), _f("cryptomining", "'high'", "62", "dst_ip", "src_ip", "NULL", "(SELECT DISTINCT dst_ip, src_ip FROM packet WHERE stratum = 'pool')"))
_det("det_dns_tunnel", lambda c: detect.dns_tunnels(c.packets))
_det("det_dga", lambda c: detect.generated_domains(c.packets))
_det("det_weak_tls", lambda c: detect.weak_tls(B.tls_sessions(c.contacts)))
_det("det_icmp_tunnel", lambda c: detect.icmp_tunnels(c.packets), _f("icmp_tunnel", "'high'", "70", "src_ip", "dst_ip", "NULL", f"(SELECT src_ip, dst_ip, COUNT(*) AS n, SUM(payload_len - 8) AS d FROM packet WHERE icmp_type = 8 GROUP BY 1, 2) WHERE n >= 32 AND d // n >= 512 AND {external(num('dst_ip'))}"))
_det("det_ics", lambda c: detect.industrial_writes(c.packets), _f("ics_control_command", "'medium'", "55", "src_ip", "dst_ip", "dst_port", "(SELECT DISTINCT src_ip, dst_ip, dst_port FROM packet WHERE ot_control IS NOT NULL)"))

# --- correlation -----------------------------------------------------------------------------------------
query("det_all")(lambda c: c.findings.select(*_SHOW))
query("cor_incident")(lambda c: correlate.incidents(c.findings).withColumns({"stages": F.concat_ws(",", "stages"), "attack": F.concat_ws(",", "attack")}))
query("cor_progress")(lambda c: correlate.progressions(c.findings).select("src_ip", "step", "kind", "stage", "score"))
query("cor_pivot_edges")(lambda c: correlate.pivot_edges(c.findings))
query("cor_parent")(lambda c: correlate.parents(correlate.pivot_edges(c.findings)))
query("cor_chain")(lambda c: correlate.chains(c.findings))
query("cor_chain_score")(lambda c: correlate.chains(c.findings).select("chain_id", "score", "confidence", "severity"))
query("cor_campaign")(lambda c: correlate.campaigns(c.findings, correlate.chains(c.findings)))
query("cor_local_hosts", "SELECT COALESCE(a.mac, d.mac) AS mac, ip, hostname, vendor FROM (SELECT arp_ip AS ip, ARG_MIN(arp_mac, idx) AS mac FROM packet WHERE arp_ip IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT dhcp_mac AS mac, ARG_MIN(dhcp_hostname, idx) FILTER (WHERE dhcp_hostname IS NOT NULL) AS hostname, ARG_MIN(dhcp_vendor, idx) AS vendor FROM packet WHERE dhcp_mac IS NOT NULL GROUP BY 1) d ON a.mac = d.mac")(lambda c: correlate.local_hosts(rollups.arp_hosts(c.packets, None), rollups.dhcp_hosts(c.packets, None)))
_INDEX = "(SELECT kind, value, BOOL_OR(ioc) AS flagged FROM (SELECT 'ip' AS kind, lo_ip AS value, ioc FROM flows UNION ALL SELECT 'ip', hi_ip, ioc FROM flows UNION ALL SELECT 'domain', sni, ioc FROM flows UNION ALL SELECT 'ja3', ja3, ioc FROM flows UNION ALL SELECT 'ja4', ja4, ioc FROM flows) WHERE value IS NOT NULL GROUP BY 1, 2)"
query("cor_index", f"SELECT * FROM {_INDEX}")(lambda c: correlate.capture_index(c.flows))
query("cor_rescan", f"SELECT kind, value, CASE WHEN flagged THEN 'still' ELSE 'newly' END AS state FROM {_INDEX} WHERE (kind = 'ip' AND (value = '45.77.1.9' OR value LIKE '10.0.9.%')) OR (kind = 'domain' AND value LIKE '%.example.org') OR (kind = 'ja3' AND value = 'ja3-2')")(
    lambda c: correlate.rescan(correlate.capture_index(c.flows), constant(c.spark, [("ip", "45.77.1.9"), ("cidr", "10.0.9.0/24"), ("suffix", "example.org"), ("ja3", "ja3-2")], "kind string, value string"))
)


def _by_day(c: Capture) -> DataFrame:
    """Flows of two captures: the packets of odd and of even days."""
    p = c.packets.withColumn("capture_id", F.expr("(ts_ns div 86400000000000) % 2"))
    return flow.derived(flow.fold(p, ["capture_id"]))


_DAYS = "(SELECT DISTINCT (ts_ns // 86400000000000) % 2 AS capture_id, ip FROM (SELECT ts_ns, src_ip AS ip FROM keyed UNION ALL SELECT ts_ns, dst_ip FROM keyed))"
query("cor_shared", f"SELECT 'ip' AS kind, ip AS value, CAST(COUNT(*) AS INT) AS n, string_agg(CAST(capture_id AS VARCHAR), ',' ORDER BY capture_id) AS captures, 'info' AS severity FROM {_DAYS} GROUP BY ip HAVING COUNT(*) >= 2")(
    lambda c: correlate.shared_indicators(_by_day(c).select("capture_id", F.explode(F.array("lo_ip", "hi_ip")).alias("value")).distinct().select("capture_id", F.lit("ip").alias("kind"), "value", F.lit("info").alias("severity")))
)
query("cor_diff", f"SELECT ip, CASE WHEN COUNT(*) = 2 THEN 'same' WHEN MIN(capture_id) = 1 THEN 'added' ELSE 'removed' END AS change FROM {_DAYS} GROUP BY ip")(
    lambda c: correlate.diff(*[_by_day(c).filter(F.col("capture_id") == k).select(F.explode(F.array("lo_ip", "hi_ip")).alias("ip")).distinct() for k in (0, 1)], "ip").select("ip", "change")
)
query("cor_verdict")(lambda c: correlate.capture_verdict(correlate.incidents(c.findings).withColumn("capture_id", F.lit(1)), c.findings.withColumn("capture_id", F.lit(1))))

# --- SQL console -----------------------------------------------------------------------------------------
_Q = console.QUERIES


def _console(name: str, c: Capture) -> DataFrame:
    views = {"flow": (numbered(c) if name == "q09" else c.table.withColumn("flow_id", F.lit(0))).select(*FLOW_COLUMNS)}
    return console.run(c.spark, _Q[name], None, **views)


for _name in ("q01", "q03", "q04", "q05", "q06", "q07", "q09"):
    query(_name, "SELECT * FROM (" + _Q[_name] + ")")(lambda c, k=_name: _console(k, c))


def _finding_view(c: Capture) -> DataFrame:
    return c.findings.select("severity", (F.col("score") / 100).alias("confidence"))


def _incident_view(c: Capture) -> DataFrame:
    return correlate.incidents(c.findings).select("host", "severity", F.timestamp_micros(F.expr("last_ns div 1000")).alias("created_at"))


query("q02")(lambda c: console.run(c.spark, _Q["q02"], None, finding=_finding_view(c)))
query("q08")(lambda c: console.run(c.spark, _Q["q08"], None, incident=_incident_view(c)))
query("sql_flow_filter", "SELECT src_ip, dst_ip, dst_port, category FROM flow WHERE category = 'web' AND sni LIKE '%host3%'")(lambda c: console.flow_filter(c.table, "HOST3", category="web").select("src_ip", "dst_ip", "dst_port", "category"))
query("sql_flow_xfilter", "SELECT src_ip, dst_ip, dst_port FROM flow WHERE flow_id % 3 = 0")(lambda c: (lambda t: console.restrict(t, t.filter("flow_id % 3 = 0").select("flow_id")).select("src_ip", "dst_ip", "dst_port"))(numbered(c)))
query("sql_finding_filter")(lambda c: console.finding_filter(c.findings, "10.0.2", severity="high").select(*_SHOW))
query("sql_threat_watch")(lambda c: rollups.ip_threat(c.flows, None).orderBy(*console.worst_first(F.col("severity"), F.col("score")), "ip").select("ip", "severity", "score"))
_EV = lambda c: c.spark.read.parquet(f"{c.sf_dir}/events.parquet")
query("sql_admin_daily", "SELECT CAST(d AS DATE) AS day, COUNT(event_id) AS n FROM generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY) s(d) LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY 1")(lambda c: console.daily_counts(_EV(c), ("2023-12-30", "2024-02-02")))
query("sql_admin_traffic", "SELECT COUNT(*) AS views, COUNT(DISTINCT user_id) AS sessions, COUNT(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buyers FROM events")(lambda c: console.traffic_figures(_EV(c)))
query("sql_admin_stats", "SELECT (SELECT COUNT(*) FROM customer) AS customers, (SELECT COUNT(*) FROM orders) AS orders, (SELECT COUNT(DISTINCT o_custkey) FROM orders) AS buyers, (SELECT ROUND(SUM(o_totalprice), 2) FROM orders) AS revenue")(
    lambda c: c.spark.read.parquet(f"{c.sf_dir}/orders.parquet").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("buyers"), F.round(F.sum("o_totalprice"), 2).alias("revenue")).join(F.broadcast(c.spark.read.parquet(f"{c.sf_dir}/customer.parquet").agg(F.count(F.lit(1)).alias("customers"))))
)
query("sql_top_paths", "SELECT event_type AS path, COUNT(*) AS views, COUNT(DISTINCT user_id) AS sessions FROM events GROUP BY 1 ORDER BY views DESC, path LIMIT 20")(lambda c: console.top_paths(_EV(c)))
query("sql_rate_limit", "SELECT user_id, to_timestamp(epoch_us(ts) // 3600000000 * 3600)::TIMESTAMP AS window_start, COUNT(*) AS n, COUNT(*) > 2 AS blocked FROM events GROUP BY 1, 2")(lambda c: console.rate_limit(_EV(c), "user_id", 3600, 2))

from flowquarry.plans import anonymize_queries, baseline_queries, capture_queries, carve_queries, handshake_queries, more_queries, output_queries, rule_queries  # noqa: E402,F401  register the rest
