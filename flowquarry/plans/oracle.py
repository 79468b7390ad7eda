"""DuckDB SQL of the relations under test, written apart from the DataFrame operators."""

from __future__ import annotations

import ipaddress

from flowquarry.plans.fixtures import FEED, packet_sql
from flowquarry.schema import BANDS, CATEGORY_POINTS, PAYLOAD_OT, PAYLOAD_WEB, SERVICES

STICKY = ["sni", "ja3", "ja4", "ja3s", "http_host", "http_ua", "tls_version", "tls_cipher", "hassh", "hassh_server"]


def num(ip: str) -> str:
    return "(" + " + ".join(f"TRY_CAST(split_part({ip}, '.', {i + 1}) AS BIGINT) * {1 << (24 - 8 * i)}" for i in range(4)) + ")"


def within(n: str, cidr: str) -> str:
    net = ipaddress.ip_network(cidr)
    return f"({n} BETWEEN {int(net.network_address)} AND {int(net.broadcast_address)})"


def external(n: str) -> str:
    inside = ["127.0.0.0/8", "169.254.0.0/16", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "0.0.0.0/8", "240.0.0.0/4", "192.0.0.0/24"]
    return "(NOT (" + " OR ".join(within(n, c) for c in inside) + "))"


def _values(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


KEYED = f"""keyed AS (
  SELECT *, (sn < dn OR (sn = dn AND sp <= dp)) AS fwd, CASE transport WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 WHEN 'icmp' THEN 1 ELSE 0 END AS proto
  FROM (SELECT *, {num("src_ip")} AS sn, {num("dst_ip")} AS dn, COALESCE(src_port, 0) AS sp, COALESCE(dst_port, 0) AS dp FROM packet WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL))"""

FLOW_RAW = f"""flow_raw AS (
  SELECT CASE WHEN fwd THEN src_ip ELSE dst_ip END AS lo_ip, CASE WHEN fwd THEN sp ELSE dp END AS lo_port, CASE WHEN fwd THEN dst_ip ELSE src_ip END AS hi_ip, CASE WHEN fwd THEN dp ELSE sp END AS hi_port, proto,
    COALESCE(MIN(ts_ns) FILTER (WHERE ts_known), MIN(ts_ns)) AS first_ns, COALESCE(MAX(ts_ns) FILTER (WHERE ts_known), MAX(ts_ns)) AS last_ns,
    COUNT(*) FILTER (WHERE fwd) AS pkts_fwd, COUNT(*) FILTER (WHERE NOT fwd) AS pkts_rev,
    CAST(COALESCE(SUM(wire_len) FILTER (WHERE fwd), 0) AS BIGINT) AS bytes_fwd, CAST(COALESCE(SUM(wire_len) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS bytes_rev,
    COALESCE(BIT_OR(COALESCE(tcp_flags, 0)) FILTER (WHERE fwd), 0) AS flags_fwd, COALESCE(BIT_OR(COALESCE(tcp_flags, 0)) FILTER (WHERE NOT fwd), 0) AS flags_rev,
    COALESCE(MIN(ttl) FILTER (WHERE fwd AND ttl > 0), 0) AS ttl_fwd, COALESCE(MIN(ttl) FILTER (WHERE NOT fwd AND ttl > 0), 0) AS ttl_rev,
    ARG_MIN(fwd, CASE WHEN proto = 6 AND (COALESCE(tcp_flags, 0) & 18) = 2 THEN 0 ELSE 1000000000 END + idx) AS init_fwd,
    ARG_MIN(app_proto, idx - 1000000000000 * CASE WHEN app_proto IN ({_values(PAYLOAD_OT)}) THEN 6 WHEN app_proto = 'http3' THEN 5 WHEN app_proto = 'quic' THEN 4 WHEN app_proto = 'http' THEN 3 WHEN app_proto = 'tls' THEN 2 WHEN app_proto = 'dns' THEN 1 ELSE 0 END) FILTER (WHERE app_proto IS NOT NULL) AS observed,
    {", ".join(f"ARG_MIN({c}, idx) FILTER (WHERE {c} <> '') AS {c}" for c in STICKY)}
  FROM keyed GROUP BY ALL)"""

_PORT = "LEAST(lo_port, hi_port)"
_cases = [(r[1], r[0], n, p) for n, w in ((6, 2), (17, 3)) for r in SERVICES for p in [r[w]] if p]
_CAT = f"CASE WHEN proto = 17 AND {_PORT} BETWEEN 16384 AND 32767 THEN 'voip' " + " ".join(f"WHEN proto = {n} AND {_PORT} IN ({', '.join(map(str, p))}) THEN '{c}'" for c, _, n, p in _cases) + " END"
_TOKEN = f"CASE WHEN proto = 17 AND {_PORT} BETWEEN 16384 AND 32767 THEN 'rtp' " + " ".join(f"WHEN proto = {n} AND {_PORT} IN ({', '.join(map(str, p))}) THEN '{t}'" for _, t, n, p in _cases) + " END"

CLASSED = f"""shaped AS (
  SELECT *, pkts_fwd + pkts_rev AS pkts, bytes_fwd + bytes_rev AS bytes, GREATEST(0, last_ns - first_ns) AS duration_ns,
    (proto = 6 AND (flags_fwd & 2) <> 0 AND (flags_rev & 18) = 18) AS established,
    CASE WHEN observed IN ({_values(PAYLOAD_WEB)}) THEN 'web' WHEN observed IN ({_values(PAYLOAD_OT)}) THEN 'iot_ot' END AS pcat, {_CAT} AS scat, {_TOKEN} AS token
  FROM flow_raw),
classed AS (
  SELECT *, COALESCE(pcat, scat, CASE
      WHEN proto = 6 AND (flags_fwd & 2) <> 0 AND NOT established AND pkts <= 4 AND (pkts_rev = 0 OR ((flags_rev & 4) <> 0 AND (flags_rev & 18) = 0)) THEN 'scan'
      WHEN bytes >= 1048576 AND duration_ns >= 60000000000 THEN 'tunnel_vpn' WHEN pkts_fwd >= 2 AND pkts_rev >= 2 AND bytes <= 4096 THEN 'c2' ELSE 'unknown' END) AS category0,
    CASE WHEN pcat IS NOT NULL THEN observed ELSE token END AS app_proto, CASE WHEN pcat IS NOT NULL THEN 'payload' WHEN token IS NOT NULL THEN 'port' END AS app_proto_src
  FROM shaped),
scanner AS (
  SELECT ip FROM (
    SELECT lo_ip AS ip, hi_port AS port FROM classed WHERE proto = 6 AND (flags_fwd & 2) <> 0 AND (flags_fwd & 16) = 0
    UNION ALL SELECT hi_ip, lo_port FROM classed WHERE proto = 6 AND (flags_rev & 2) <> 0 AND (flags_rev & 16) = 0)
  GROUP BY ip HAVING COUNT(DISTINCT port) >= 15)"""

_ips = [v for k, v in FEED if k == "ip"]
_cidrs = [v for k, v in FEED if k == "cidr"]
_bad = lambda ip: f"({ip} IN ({_values(_ips)}) OR " + " OR ".join(within(num(ip), c) for c in _cidrs) + ")"
_names = [v for k, v in FEED if k == "domain"]
_suffix = [v for k, v in FEED if k == "suffix"]

SCORED = f"""typed AS (
  SELECT *, CASE WHEN category0 = 'unknown' AND (lo_ip IN (SELECT ip FROM scanner) OR hi_ip IN (SELECT ip FROM scanner)) THEN 'scan' ELSE category0 END AS category,
    ({_bad("lo_ip")} OR {_bad("hi_ip")}) AS ioc_ip,
    COALESCE(lower(sni) IN ({_values(_names)}) OR {" OR ".join(f"lower(sni) = '{s}' OR lower(sni) LIKE '%.{s}'" for s in _suffix)}, false) AS ioc_domain,
    COALESCE(ja3 IN ({_values(v for k, v in FEED if k == "ja3")}), false) OR COALESCE(ja4 IN ({_values(v for k, v in FEED if k == "ja4")}), false) AS ioc_fp
  FROM classed),
raw AS (
  SELECT *, (ioc_ip OR ioc_domain OR ioc_fp) AS ioc,
    CASE category {" ".join(f"WHEN '{c}' THEN {p}" for c, p in CATEGORY_POINTS.items())} END + 35 * (CAST(ioc_ip AS INT) + CAST(ioc_domain AS INT) + CAST(ioc_fp AS INT))
    + CASE WHEN {external(num("lo_ip"))} OR {external(num("hi_ip"))} THEN 15 ELSE -10 END
    + CASE WHEN category = 'scan' AND pkts_rev = 0 THEN 10 ELSE 0 END + CASE WHEN category = 'c2' AND bytes <= 4096 AND pkts_fwd >= 2 AND pkts_rev >= 2 THEN 10 ELSE 0 END AS points
  FROM typed),
flows AS (
  SELECT *, CASE WHEN threat_score >= 85 THEN 'critical' WHEN threat_score >= 60 THEN 'high' WHEN threat_score >= 35 THEN 'medium' WHEN threat_score >= 15 THEN 'low' ELSE 'info' END AS severity
  FROM (SELECT *, CASE WHEN ioc AND category IN ('c2', 'anomalous') THEN GREATEST(90, base) WHEN ioc AND base < 60 THEN 60 WHEN category = 'c2' AND app_proto_src IS NULL AND NOT ioc AND base >= 60 THEN 59 ELSE base END AS threat_score
    FROM (SELECT *, LEAST(100, GREATEST(0, points)) AS base FROM raw)))"""

FLOW = """flow AS (
  SELECT CASE WHEN init_fwd THEN lo_ip ELSE hi_ip END AS src_ip, CASE WHEN init_fwd THEN hi_ip ELSE lo_ip END AS dst_ip, CASE WHEN init_fwd THEN lo_port ELSE hi_port END AS src_port, CASE WHEN init_fwd THEN hi_port ELSE lo_port END AS dst_port,
    proto, app_proto, CASE WHEN init_fwd THEN bytes_fwd ELSE bytes_rev END AS bytes_c2s, CASE WHEN init_fwd THEN bytes_rev ELSE bytes_fwd END AS bytes_s2c, pkts, first_ns, last_ns, make_timestamp(first_ns // 1000) AS start_ts, make_timestamp(last_ns // 1000) AS end_ts,
    CASE WHEN init_fwd THEN flags_fwd ELSE flags_rev END AS tcp_flags_c2s, CASE WHEN init_fwd THEN flags_rev ELSE flags_fwd END AS tcp_flags_s2c, CASE WHEN init_fwd THEN ttl_fwd ELSE ttl_rev END AS ttl_min_c2s,
    category, app_proto_src, sni, ja3, ja4, tls_version, tls_cipher, hassh, hassh_server, ja3s, http_host, http_ua, severity, threat_score, ioc,
    ROW_NUMBER() OVER (ORDER BY first_ns, last_ns, """ + num("lo_ip") + ", lo_port, " + num("hi_ip") + """, hi_port, proto) - 1 AS flow_id
  FROM flows)"""

CONTACT = """contact AS (
  SELECT *, CASE WHEN lo_port <= hi_port THEN hi_ip ELSE lo_ip END AS client, CASE WHEN lo_port <= hi_port THEN lo_ip ELSE hi_ip END AS server, LEAST(lo_port, hi_port) AS port,
    CASE WHEN lo_port <= hi_port THEN bytes_rev ELSE bytes_fwd END AS bytes_out, CASE WHEN lo_port <= hi_port THEN bytes_fwd ELSE bytes_rev END AS bytes_in
  FROM flows WHERE proto IN (6, 17, 132)),
gapped AS (SELECT *, GREATEST(0, first_ns - LAG(first_ns) OVER (PARTITION BY client, server, port ORDER BY first_ns, last_ns, lo_port, hi_port)) AS gap FROM contact),
channel AS (
  SELECT *, CASE WHEN gaps < 2 OR mean_gap <= 0 THEN 0 ELSE std_gap / mean_gap END AS cv FROM (
    SELECT client, server, port, COUNT(*) AS contacts, COUNT(gap) AS gaps, COALESCE(AVG(gap), 0) AS mean_gap, COALESCE(STDDEV_POP(gap), 0) AS std_gap, MIN(first_ns) AS first_ns, MAX(first_ns) AS last_ns,
      CAST(SUM(bytes_out) AS BIGINT) AS bytes_out, CAST(SUM(bytes_in) AS BIGINT) AS bytes_in, BOOL_OR(category = 'c2') AS c2_shape, BOOL_OR(app_proto IS NOT NULL) AS named, BOOL_OR(bytes_out >= 512 AND bytes_in >= 512) AS two_way
    FROM gapped GROUP BY client, server, port))"""

BANDS_SQL = BANDS


def sql(tail: str) -> str:
    """``tail`` over the relations packet, keyed, flow_raw, classed, flows, flow, contact and channel."""
    needed = {"flow_raw": KEYED + ",\n" + FLOW_RAW, "flows": CLASSED + ",\n" + SCORED}
    parts = [f"packet AS ({packet_sql('duckdb')})", needed["flow_raw"], needed["flows"], FLOW, CONTACT]
    return "WITH " + ",\n".join(parts) + "\n" + tail
