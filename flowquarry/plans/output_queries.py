"""Queries of exports, forecasts, reputation folding and case functions over relations derived from the packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.tables import constant
from flowquarry.operators import console, correlate, detect, export, forecast, reputation
from flowquarry.plans.more_queries import _daily
from flowquarry.plans.queries import _SHOW, Capture, query

# --- findings in the same words of Spark and DuckDB ---------------------------------------------------------
_SEV = "CASE idx % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END"
_KIND = "CASE idx % 3 WHEN 0 THEN 'dns_tunnel' WHEN 1 THEN 'cleartext_creds' ELSE 'beacon' END"
_PORT = "CASE WHEN idx % 4 > 0 THEN dst_port END"
_DST = "CASE WHEN idx % 7 > 0 THEN dst_ip END"
_TITLE = "CASE idx % 4 WHEN 0 THEN 'Odd, \"quoted\" title' WHEN 1 THEN 'a=b|c' ELSE 'Plain title' END"
_WHERE = "src_ip IS NOT NULL AND idx % 9 < 4"


def _findings(c: Capture) -> DataFrame:
    p = c.packets.filter(_WHERE)
    attack = F.expr("CASE WHEN idx % 6 = 0 THEN array('T1071', 'T1048.003') WHEN idx % 6 < 4 THEN array('T1040') ELSE CAST(array() AS array<string>) END")
    evidence = F.expr("CASE WHEN idx % 8 = 0 THEN CAST(array() AS array<string>) ELSE array(concat('n=', CAST(idx AS string)), 'two; parts') END")
    return p.select("idx", F.expr(_KIND).alias("kind"), F.expr(_SEV).alias("severity"), F.expr("CAST(idx % 101 AS INT)").alias("score"), F.expr(_TITLE).alias("title"), "src_ip", F.expr(_DST).alias("dst_ip"), F.expr(_PORT).alias("dst_port"), attack.alias("attack"), evidence.alias("evidence"))


_F = f"""(SELECT idx, {_KIND} AS kind, {_SEV} AS severity, CAST(idx % 101 AS INT) AS score, {_TITLE} AS title, src_ip, {_DST} AS dst_ip, {_PORT} AS dst_port,
    CASE WHEN idx % 6 = 0 THEN ['T1071', 'T1048.003'] WHEN idx % 6 < 4 THEN ['T1040'] ELSE CAST([] AS VARCHAR[]) END AS attack,
    CASE WHEN idx % 8 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['n=' || idx, 'two; parts'] END AS evidence FROM packet WHERE {_WHERE})"""


def _quoted(x: str) -> str:
    return f"(CASE WHEN regexp_matches(COALESCE({x}, ''), '[,\"\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE COALESCE({x}, '') END)"


_CSV = " || ',' || ".join(_quoted(x) for x in ("kind", "severity", "CAST(score AS VARCHAR)", "src_ip", "dst_ip", "CAST(dst_port AS VARCHAR)", "array_to_string(attack, ';')", "title", "array_to_string(evidence, '; ')"))
query("exp_findings_csv", f"SELECT {_CSV} AS line FROM {_F}")(lambda c: export.findings_csv(_findings(c)))
_FLOW = ["CAST(flow_id AS VARCHAR)", "src_ip", "CAST(src_port AS VARCHAR)", "dst_ip", "CAST(dst_port AS VARCHAR)", "CAST(proto AS VARCHAR)", "app_proto", "category", "severity", "CAST(threat_score AS VARCHAR)", "CAST(ioc AS VARCHAR)"]
_FLOW += ["CAST(bytes_c2s AS VARCHAR)", "CAST(bytes_s2c AS VARCHAR)", "CAST(bytes_c2s + bytes_s2c AS VARCHAR)", "CAST(pkts AS VARCHAR)", "strftime(start_ts, '%Y-%m-%dT%H:%M:%S.%gZ')", "strftime(end_ts, '%Y-%m-%dT%H:%M:%S.%gZ')"]
_FLOW += ["CAST(epoch_us(end_ts) // 1000 - epoch_us(start_ts) // 1000 AS VARCHAR)", "sni", "http_host", "http_ua", "ja3", "ja4", "ja3s", "tls_version", "tls_cipher", "hassh", "hassh_server"]
query("exp_flows_csv", f"SELECT {' || chr(44) || '.join(map(_quoted, _FLOW))} AS line FROM (SELECT * REPLACE (0 AS flow_id) FROM flow)")(lambda c: export.flows_csv(c.table.withColumn("flow_id", F.lit(0))))
query("exp_result_csv", f"SELECT {_quoted('severity')} || ',' || CAST(COUNT(*) AS VARCHAR) || ',' || {_quoted('MAX(title)')} AS line FROM {_F} GROUP BY severity")(
    lambda c: export.csv_lines(_findings(c).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.max("title").alias("title")))
)


def _cef(x: str) -> str:
    return f"replace(replace(replace({x}, chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), '=', chr(92) || '=')"


query(
    "exp_cef",
    f"""SELECT 'CEF:0|flowquarry|flowquarry|1|' || kind || '|' || {_cef('title')} || '|' || (CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 8 WHEN 'medium' THEN 5 WHEN 'low' THEN 3 ELSE 1 END)
    || '|src=' || src_ip || COALESCE(' dst=' || dst_ip, '') || COALESCE(' dpt=' || dst_port, '') || CASE WHEN len(attack) > 0 THEN ' cs1Label=ATT&CK cs1=' || array_to_string(attack, ',') ELSE '' END
    || ' cn1Label=score cn1=' || score || CASE WHEN len(evidence) > 0 THEN ' msg=' || {_cef("array_to_string(evidence, '; ')")} ELSE '' END AS line FROM {_F}""",
)(lambda c: export.cef_lines(_findings(c)))
_SHA = "sha256(concat_ws('|', 'sigma', kind, src_ip, COALESCE(dst_ip, ''), COALESCE(CAST(dst_port AS VARCHAR), '')))"
_YAML = lambda x: f"chr(34) || replace({x}, chr(34), chr(92) || chr(34)) || chr(34)"
query(
    "exp_sigma",
    f"""SELECT 'title: ' || {_YAML("'flowquarry: ' || title")} || chr(10) || 'id: ' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) || chr(10) || 'status: experimental' || chr(10)
    || CASE WHEN len(evidence) > 0 THEN 'description: ' || {_YAML("array_to_string(evidence, '; ')")} || chr(10) ELSE '' END || 'author: flowquarry' || chr(10)
    || CASE WHEN len(attack) > 0 THEN 'references:' || chr(10) || array_to_string(list_transform(attack, lambda a: '  - "https://attack.mitre.org/techniques/' || replace(a, '.', '/') || '/"' || chr(10)), '') ELSE '' END
    || 'logsource:' || chr(10) || '  category: ' || CASE kind WHEN 'dns_tunnel' THEN 'dns' WHEN 'cleartext_creds' THEN 'proxy' ELSE 'firewall' END || chr(10) || 'detection:' || chr(10) || '  selection:' || chr(10)
    || CASE WHEN dst_ip IS NULL THEN '    src_ip: "' || src_ip || '"' || chr(10) ELSE '    dst_ip: "' || dst_ip || '"' || chr(10) || COALESCE('    dst_port: ' || dst_port || chr(10), '') END
    || '  condition: selection' || chr(10) || 'fields:' || chr(10) || '  - src_ip' || chr(10) || '  - dst_ip' || chr(10) || '  - dst_port' || chr(10) || 'falsepositives:' || chr(10) || '  - Legitimate administrative or monitoring traffic' || chr(10)
    || 'level: ' || CASE severity WHEN 'info' THEN 'informational' ELSE severity END || chr(10)
    || CASE WHEN len(attack) > 0 THEN 'tags:' || chr(10) || array_to_string(list_transform(attack, lambda a: '  - attack.' || lower(a) || chr(10)), '') ELSE '' END AS rule FROM (SELECT *, {_SHA} AS h FROM {_F})""",
)(lambda c: export.sigma_rules(_findings(c)))

_ATTRIBUTE = """'{"uuid":"' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) || '","type":"' || type || '","category":"Network activity","value":"' || value
    || '","to_ids":' || CASE WHEN to_ids THEN 'true' ELSE 'false' END || ',"comment":"' || replace(comment, '"', chr(92) || '"') || '"}'"""
query(
    "exp_misp",
    f"""SELECT type, value, {_ATTRIBUTE} AS attribute FROM (SELECT *, sha256('misp|attribute|' || type || '|' || value) AS h FROM (
      SELECT 'ip-dst' AS type, dst_ip AS value, TRUE AS to_ids, FIRST(title ORDER BY score DESC, title) AS comment FROM {_F} WHERE dst_ip IS NOT NULL GROUP BY dst_ip
      UNION ALL SELECT DISTINCT 'domain', http_host, http_host LIKE 'a%', '' FROM packet WHERE http_host IS NOT NULL UNION ALL SELECT DISTINCT 'ja3-fingerprint-md5', ja3, TRUE, 'seen' FROM packet WHERE ja3 IS NOT NULL
      UNION ALL SELECT DISTINCT 'ja4', ja4, TRUE, 'seen' FROM packet WHERE ja4 IS NOT NULL))""",
)(lambda c: export.misp_attributes(_findings(c), c.packets.select(F.col("http_host").alias("host"), F.startswith("http_host", F.lit("a")).alias("malicious")), c.packets.select("ja3", "ja4", F.lit("seen").alias("label"))))
query(
    "exp_misp_event",
    f"""SELECT '{{"uuid":"' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) || '","info":"flowquarry analysis of day.pcap: ' || n || ' findings","date":"2024-01-02","threat_level_id":"' || level
    || '","analysis":"2","published":false,"timestamp":"1704153600","Tag":[{{"name":"mitre-attack:T1040"}},{{"name":"mitre-attack:T1048.003"}},{{"name":"mitre-attack:T1071"}}]}}' AS event
    FROM (SELECT COUNT(*) AS n, CASE WHEN bool_or(severity IN ('critical', 'high')) THEN 1 ELSE 2 END AS level, sha256('misp|event|day.pcap|1704153600') AS h FROM {_F})""",
)(lambda c: export.misp_event(_findings(c), "day.pcap", 1_704_153_600))

# --- forecasts ----------------------------------------------------------------------------------------------
# The folds are recursive; tests/test_forecast.py holds them against a plain loop.
_IDS = ["src_ip"]


def _steps(c: Capture) -> DataFrame:
    """Forecasts of the bytes that each source sends on each day."""
    return forecast.steps(_daily(c), _IDS, "day")


query("fc_holt")(lambda c: _steps(c).select(*_IDS, "bin", F.round("forecast", 2).alias("forecast"), F.round("sigma", 2).alias("sigma")))
query("fc_hits")(lambda c: forecast.hits(_steps(c), _IDS))
query("fc_band")(lambda c: forecast.band(_steps(c), _IDS).select(*_IDS, "bin", "actual", *[F.round(k, 2).alias(k) for k in ("forecast", "lower", "upper")]))

# --- reputation ---------------------------------------------------------------------------------------------
_CARD = "SELECT DISTINCT idx % 400 AS k, concat('ip', CAST(idx % 400 AS {t})) AS ip FROM {p}"


def _cards(c: Capture) -> DataFrame:
    k = c.packets.select((F.col("idx") % 400).alias("k")).distinct()
    severity = F.expr("CASE WHEN k % 97 >= 90 THEN 'critical' WHEN k % 97 >= 60 THEN 'high' WHEN k % 97 >= 35 THEN 'medium' WHEN k % 97 >= 15 THEN 'low' ELSE 'info' END")
    return k.select("k", F.concat(F.lit("ip"), F.col("k").cast("string")).alias("ip"), (F.col("k") % 5 > 0).alias("external"), (F.col("k") % 11 == 0).alias("ioc"), (F.col("k") % 97).cast("int").alias("score"), severity.alias("severity"))


def _verdicts(c: Capture) -> DataFrame:
    each = F.explode(F.expr("filter(array(named_struct('source', 'a', 'status', CASE WHEN k % 4 = 0 THEN 'malicious' WHEN k % 4 = 1 THEN 'benign' ELSE 'unknown' END), named_struct('source', 'b', 'status', IF(k % 6 = 0, 'malicious', 'clean'))), x -> k % 3 > 0 OR x.source = 'b')"))
    return _cards(c).select("k", "ip", each.alias("v")).select("ip", F.col("v.source").alias("source"), F.col("v.status").alias("status"))


_BAD = "((CASE WHEN k % 4 = 0 AND k % 3 > 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END))"
query(
    "rep_apply",
    f"""SELECT 'ip' || k AS ip, CAST(s AS INT) AS score, CASE WHEN ext AND bad > 0 THEN CASE WHEN s >= 85 THEN 'critical' WHEN s >= 60 THEN 'high' ELSE 'medium' END
      WHEN ext AND k % 4 = 1 AND k % 3 > 0 AND k % 11 > 0 AND k % 13 > 0 THEN CASE WHEN b >= 90 THEN 'high' WHEN b >= 60 THEN 'medium' WHEN b >= 35 THEN 'low' ELSE 'info' END
      WHEN b >= 90 THEN 'critical' WHEN b >= 60 THEN 'high' WHEN b >= 35 THEN 'medium' WHEN b >= 15 THEN 'low' ELSE 'info' END AS severity, CAST(CASE WHEN ext THEN CASE WHEN k % 3 > 0 THEN 2 ELSE 1 END ELSE 0 END AS BIGINT) AS verdicts
    FROM (SELECT *, CASE WHEN ext AND bad >= 2 THEN GREATEST(90, LEAST(100, b + 25)) WHEN ext AND bad = 1 THEN GREATEST(60, LEAST(100, b + 25)) ELSE b END AS s
      FROM (SELECT DISTINCT idx % 400 AS k, (idx % 400) % 97 AS b, (idx % 400) % 5 > 0 AS ext, {_BAD.replace('k %', '(idx % 400) %')} AS bad FROM packet))""",
)(lambda c: reputation.applied(_cards(c), _verdicts(c), _cards(c).filter("k % 13 = 0").select("ip")))
query("rep_apply_domain", "SELECT DISTINCT http_host AS host, CASE WHEN http_host LIKE 'www%' THEN 'a=malicious,b=clean' END AS verdicts FROM packet WHERE http_host IS NOT NULL")(
    lambda c: reputation.by_domain(c.packets.filter("http_host is not null").select(F.col("http_host").alias("host")), constant(c.spark, [(f"WWW{i}.example.com", s, t) for i in range(5) for s, t in (("b", "clean"), ("a", "malicious"))], "host string, source string, status string"))
)
_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def _cache(c: Capture) -> DataFrame:
    asked = F.expr(f"{_NOW} - make_dt_interval(0, CAST(k % 30 AS INT))")
    return _cards(c).filter("k % 3 > 0").select(F.col("ip").alias("indicator"), F.expr("IF(k % 2 = 0, 'a', 'b')").alias("source"), F.expr("IF(k % 4 = 0, 'malicious', 'clean')").alias("verdict"), asked.alias("asked"))


_K = "SELECT DISTINCT idx % 400 AS k FROM packet"
query(
    "rep_cache",
    f""", wanted AS (SELECT 'ip' || k AS indicator, source, CASE WHEN k % 3 > 0 AND ((k % 2 = 0) = (source = 'a')) AND k % 30 < CASE source WHEN 'a' THEN 18 ELSE 24 END THEN CASE WHEN k % 4 = 0 THEN 'malicious' ELSE 'clean' END END AS verdict FROM ({_K}), (VALUES ('a'), ('b')) v(source))
    SELECT *, 'cached' AS state FROM wanted WHERE verdict IS NOT NULL UNION ALL SELECT *, 'ask' FROM (SELECT * FROM wanted WHERE verdict IS NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY indicator) <= 20)""",
)(lambda c: reputation.cached(_cards(c).select(F.col("ip").alias("indicator")), _cache(c), F.expr(_NOW), {"a": 18, "b": 24}, 20))

# --- files, certificates, indicators ------------------------------------------------------------------------
_BOUNDS = ["MIN(ts_ns) AS first_ns", "MAX(ts_ns) AS last_ns"]


def _files(c: Capture) -> DataFrame:
    return c.packets.filter("download is not null").select(F.col("dst_ip").alias("client"), F.col("src_ip").alias("server"), F.col("src_port").alias("port"), F.sha2(F.concat(F.lit("f"), (F.col("idx") % 50).cast("string")), 256).alias("sha256"), F.expr("IF(idx % 3 = 0, 'xx powershell -enc yy', 'plain')").alias("body"), (F.col("download") == "executable").alias("executable"), F.col("ts_ns").alias("first_ns"), F.col("ts_ns").alias("last_ns"))


_FILE = "(SELECT dst_ip, src_ip, src_port, idx, download FROM packet WHERE download IS NOT NULL)"
_FIND = "'{k}' AS kind, {s} AS severity, CAST({p} AS INT) AS score, dst_ip AS src_ip, src_ip AS dst_ip, CAST(src_port AS INT) AS dst_port"
query("det_malware_download", f"SELECT {_FIND.format(k='malware_download', s=chr(39) + 'critical' + chr(39), p=95)} FROM {_FILE} WHERE idx % 50 < 25")(
    lambda c: detect.known_malware(_files(c), _files(c).sparkSession.range(25).select(F.sha2(F.concat(F.lit("f"), F.col("id").cast("string")), 256).alias("sha256"))).select(*_SHOW)
)
query("det_malware_signature", f"SELECT {_FIND.format(k='malware_signature', s='CASE WHEN x THEN ' + chr(39) + 'high' + chr(39) + ' ELSE ' + chr(39) + 'medium' + chr(39) + ' END', p='CASE WHEN x THEN 80 ELSE 55 END')} FROM (SELECT *, download = 'executable' AS x FROM {_FILE}) WHERE idx % 3 = 0")(
    lambda c: detect.suspicious_content(_files(c), constant(c.spark, [("enc", "powershell -enc", False, False), ("exe", "powershell", True, True)], "name string, pattern string, needs_executable boolean, high boolean")).select(*_SHOW)
)
query("det_tls_cert", "SELECT 'tls_cert_health' AS kind, CASE k WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'high' END AS severity, CAST(CASE k WHEN 0 THEN 68 WHEN 1 THEN 48 ELSE 54 END AS INT) AS score, dst_ip AS src_ip, src_ip AS dst_ip, src_port AS dst_port FROM (SELECT *, idx // 16 % 4 AS k FROM packet WHERE tls_version IS NOT NULL) WHERE k < 3")(
    lambda c: detect.certificate_health(c.packets.filter("tls_version is not null").select(F.col("dst_ip").alias("client"), F.col("src_ip").alias("server"), F.col("src_port").alias("port"), F.col("ts_ns").alias("first_ns"), F.col("ts_ns").alias("last_ns"), F.expr("CASE (idx div 16) % 4 WHEN 0 THEN array('expired') WHEN 1 THEN array('self_signed', 'other') WHEN 2 THEN array('weak_key', 'self_signed', 'weak_key') ELSE array('other') END").alias("issues"))).select(*_SHOW)
)
query("det_ioc_list", "SELECT 'ioc_match' AS kind, CASE WHEN http_host = 'www3.example.com' THEN 'high' ELSE 'critical' END AS severity, CAST(CASE WHEN http_host = 'www3.example.com' THEN 90 ELSE 100 END AS INT) AS score, src_ip, dst_ip, CAST(NULL AS INT) AS dst_port FROM packet WHERE http_host = 'www3.example.com' OR download = 'archive'")(
    lambda c: detect.indicator_matches(
        c.packets.select(F.expr("IF(http_host IS NULL, 'hash', 'domain')").alias("kind"), F.coalesce("http_host", "download").alias("value"), "src_ip", "dst_ip", F.col("ts_ns").alias("first_ns"), F.col("ts_ns").alias("last_ns")),
        constant(c.spark, [("domain", "www3.example.com"), ("hash", "archive"), ("hash", "archive")], "kind string, value string"),
    ).select(*_SHOW)
)
query("cor_file_rep", "SELECT idx % 50 AS f, CASE WHEN idx % 50 < 10 THEN 'bad' END AS verdict FROM packet WHERE download IS NOT NULL")(
    lambda c: correlate.with_file_verdicts(c.packets.filter("download is not null").select((F.col("idx") % 50).alias("f"), F.sha2((F.col("idx") % 50).cast("string"), 256).alias("sha256")), c.spark.range(10).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.lit("bad").alias("verdict"))).select("f", "verdict")
)

# --- cases --------------------------------------------------------------------------------------------------
_CASE = f"(SELECT idx % 20 AS capture_id, {_KIND} AS kind, {_SEV} AS severity, src_ip AS host FROM packet WHERE {_WHERE})"


def _case(c: Capture) -> DataFrame:
    return _findings(c).select((F.col("idx") % 20).alias("capture_id"), "kind", "severity", F.col("src_ip").alias("host"))


query("cor_case_rank", f"SELECT CAST(capture_id AS VARCHAR) AS path, capture_id % 3 > 0 AS ok, MIN(severity) AS severity, COUNT(*) AS findings FROM {_CASE} GROUP BY capture_id")(
    lambda c: correlate.case_rank(_case(c).groupBy("capture_id").agg(F.min("severity").alias("severity"), F.count(F.lit(1)).alias("findings")).select(F.col("capture_id").cast("string").alias("path"), (F.col("capture_id") % 3 > 0).alias("ok"), "severity", "findings"))
)
query(
    "cor_workspace",
    f"""SELECT (SELECT COUNT(DISTINCT capture_id) FROM {_CASE}) AS captures, CAST((SELECT COUNT(*) FROM {_CASE}) AS BIGINT) AS flows, CAST((SELECT COUNT(*) * 10 FROM {_CASE}) AS BIGINT) AS bytes, (SELECT COUNT(DISTINCT host) FROM {_CASE}) AS hosts,
    (SELECT COUNT(*) FROM {_CASE} WHERE severity IN ('critical', 'high')) AS serious, (SELECT string_agg(kind, ',' ORDER BY n DESC, kind) FROM (SELECT kind, COUNT(DISTINCT capture_id) AS n FROM {_CASE} GROUP BY 1 ORDER BY n DESC, kind LIMIT 4)) AS top_kinds""",
)(lambda c: correlate.workspace(_case(c).groupBy("capture_id").agg(F.count(F.lit(1)).alias("flows"), (F.count(F.lit(1)) * 10).alias("bytes")), _case(c).select("capture_id", F.col("host").alias("ip")), _case(c)))
query("cor_trend", f", per AS (SELECT capture_id, COUNT(*) FILTER (WHERE severity IN ('critical', 'high')) AS serious FROM {_CASE} GROUP BY 1 ORDER BY capture_id DESC LIMIT 8) SELECT *, (SELECT ARG_MAX(serious, capture_id) > ARG_MIN(serious, capture_id) FROM per) AS rising FROM per")(lambda c: correlate.trend(_case(c)))
query("cor_review", f"SELECT capture_id, COUNT(*) AS hosts FROM (SELECT DISTINCT capture_id, host, severity FROM {_CASE}) WHERE severity IN ('critical', 'high') AND NOT (capture_id % 2 = 0 AND host LIKE '%.1') GROUP BY 1")(
    lambda c: correlate.unreviewed(_case(c).select("capture_id", "host", "severity").distinct(), _case(c).filter("capture_id % 2 = 0 and host like '%.1'").select("capture_id", "host"))
)

# --- guard and replies --------------------------------------------------------------------------------------
# Statements and whether the console admits them.
_STATEMENTS = [
    ("select 1", True), ("WITH a AS (SELECT 1) SELECT * FROM a", True), ("select 'drop table x'", True), ("select 1 -- drop\n", True), ("select /* a /* b */ drop */ 1", True), ("select \"use\" from flow", True), ("select 1;;", True),
    ("drop table flow", False), ("select 1; select 2", False), ("", False), ("explain select 1", False), ("with x as (delete from flow) select 1", False), ("select 1 /* open", False), ("select 1 where force", False), ("select * from use", False), ("select transaction", False), ("select rollback", False),
]


def _filled(c: Capture, templates: list[str]) -> DataFrame:
    """(event_id, text): the templates in turn, each event's number in place of every 1."""
    each = F.get(F.array(*map(F.lit, templates)), (F.col("event_id") % len(templates)).cast("int"))
    return c.spark.read.parquet(f"{c.sf_dir}/events.parquet").select("event_id", F.replace(each, F.lit("1"), F.col("event_id").cast("string")).alias("text"))


def _cases(values: list[str]) -> str:
    return f"CASE event_id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
query("sql_guard", f"SELECT event_id, replace({_cases([_quoted(x) for x, _ in _STATEMENTS])}, '1', CAST(event_id AS VARCHAR)) AS statement, {_cases([str(ok) for _, ok in _STATEMENTS])} AS ok FROM events")(
    lambda c: _filled(c, [x for x, _ in _STATEMENTS]).select("event_id", F.col("text").alias("statement"), F.pandas_udf(lambda s: s.map(lambda x: console.guard(x).ok), "boolean")("text").alias("ok"))
)
_REPLIES = ["Here:\n```sql\n-- intent: count\nSELECT 1\n```\nDone.", "-- error: no column 1", "SELECT 1"]


def _replies_read(text: str):
    def read(replies):
        import pandas as pd

        return pd.DataFrame([console.parse_reply(r) for r in replies], columns=["sql", "intent", "error"])

    return F.pandas_udf(read, "sql string, intent string, error string")(text)


query("sql_nlq", f"SELECT event_id, {_cases(["'SELECT ' || event_id", "''", "'SELECT ' || event_id"])} AS sql, {_cases(["'count'", "''", "''"])} AS intent, {_cases(["''", "'no column ' || event_id", "''"])} AS error FROM events")(
    lambda c: _filled(c, _REPLIES).select("event_id", _replies_read("text").alias("r")).select("event_id", "r.*")
)
