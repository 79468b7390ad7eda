"""Queries of content rules, traffic anomalies and flow files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.tables import constant
from flowquarry.operators import decode as D
from flowquarry.operators import forecast, rules, series
from flowquarry.plans.capture_queries import frames
from flowquarry.plans.more_queries import WIDTH
from flowquarry.plans.queries import Capture, query
from flowquarry.schema import FLOW_COLUMNS
from flowquarry.sources.flows import read_flows, write_flows
from flowquarry.sources.rules import content_hex, parsed, technique_ids

RULES = r"""
# miners and logins
alert tcp any any -> any any (msg:"Miner; login"; content:"mining.submit"; sid:1; classtype:trojan-activity; metadata:attack T1496, T1496.001;)
alert ip any any <> any any (msg:"FTP user"; content:"USER |62 6F 62|"; sid:2; priority:1; reference:url,attack.mitre.org/T1552; rev:3;)
alert tcp any any -> any 80 (content:"Basic dTpw"; sid:3; classtype:policy-violation;)
alert udp any any -> any any (msg:"No UDP"; content:"mining.submit"; sid:4;)
alert tcp any any -> any any (msg:"Executable"; content:"|0d 0a 0D 0A|MZ"; sid:5; priority:9;)
alert tcp any any -> any any (msg:"nocase"; content:"x"; nocase; sid:6;)
alert tcp any any -> any any (msg:"two"; content:"x"; content:"y"; sid:7;)
alert icmp any any -> any any (content:"x"; sid:8;)
alert tcp any any => any any (content:"x"; sid:9;)
alert tcp any 99999 -> any any (content:"x"; sid:10;)
alert tcp any any -> any any (content:"x";)
alert tcp any any -> any any (msg:"none"; sid:12;)
alert tcp any any -> any any (content:"|4|"; sid:13;)
alert tcp any (content:"x"; sid:14;)
alert tcp any any -> any any content:"x"; sid:15;
alert tcp any any -> any any (content:"x"; http_uri; sid:16;)
alert tcp any any -> any any (content:"a\;b"; sid:17;)
alert tcp any any -> any any (content:"a\:b\"|7C|"; sid:18;)
alert tcp any any -> any any (content:"x"; sid:abc;)
"""


def _lines(c: Capture) -> DataFrame:
    return constant(c.spark, list(enumerate(RULES.splitlines(), 1)), "line int, text string")


def _part_lines(c: Capture) -> DataFrame:
    """A rule line for each part: the lines above in turn, with numbers of their own."""
    texts = F.array(*map(F.lit, RULES.splitlines()))
    key = F.col("p_partkey")
    line = F.get(texts, (key % len(RULES.splitlines())).cast("int"))
    return c.spark.read.parquet(f"{c.sf_dir}/part.parquet").select(key.alias("line"), F.regexp_replace(line, F.lit(r"sid:(\d+)"), F.concat(F.lit("sid:"), key.cast("string"), F.lit("00$1"))).alias("text"))


_N = len(RULES.splitlines())
# What each line must give, written out.
query(
    "src_rules",
    rf"""SELECT p_partkey AS line, reason, CASE WHEN sid IS NOT NULL THEN CAST(p_partkey || '00' || sid AS BIGINT) END AS sid, proto, src_port, dst_port, both_ways, msg, attack, severity FROM part JOIN (VALUES
      (3, NULL, 1, 'tcp', NULL, NULL, FALSE, 'Miner; login', 'T1496,T1496.001', 'high'), (4, NULL, 2, 'ip', NULL, NULL, TRUE, 'FTP user', 'T1552', 'critical'), (5, NULL, 3, 'tcp', NULL, 80, FALSE, '', '', 'low'),
      (6, NULL, 4, 'udp', NULL, NULL, FALSE, 'No UDP', '', 'medium'), (7, NULL, 5, 'tcp', NULL, NULL, FALSE, 'Executable', '', 'low'), (8, 'unsupported option: nocase', 6, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
      (9, 'unsupported: not exactly one content (found 2)', 7, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (10, 'unsupported proto: icmp', 8, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
      (11, 'unsupported direction: =>', 9, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (12, 'bad port: 99999', 10, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (13, 'missing sid', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
      (14, 'no content', 12, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (15, 'bad content: |4|', 13, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (16, 'malformed: too few header tokens', 14, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
      (17, 'malformed: no options block', 15, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (18, 'unsupported option: http_uri', 16, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (19, 'bad content: a\;b', 17, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
      (20, NULL, 18, 'tcp', NULL, NULL, FALSE, '', '', 'medium'), (21, 'bad sid: abc', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
    ) v(line, reason, sid, proto, src_port, dst_port, both_ways, msg, attack, severity) ON p_partkey % {_N} + 1 = v.line""",
)(lambda c: parsed(_part_lines(c)).withColumn("attack", F.when(F.col("attack").isNotNull(), F.concat_ws(",", "attack"))).drop("action", "content"))
_CONTENTS = [(1, "GET |2f|x"), (2, "|61 62  63|"), (3, "||"), (4, r"q\"\\\:\|"), (5, r"bad\n"), (6, "|6|"), (7, "open |61"), (8, "|61 6|"), (9, "é"), (10, "")]


def _part_contents(c: Capture) -> DataFrame:
    """A content and a note for each part: those above in turn, before the part's name."""
    notes = {1: "T1059", 3: "T12345.6,T0001 T12", 5: "xT1001."}
    at = (F.col("p_partkey") % len(_CONTENTS)).cast("int")
    raw, note = F.array(*[F.lit(x) for _, x in _CONTENTS]), F.array(*[F.lit(notes.get(n, "none")) for n, _ in _CONTENTS])
    return c.spark.read.parquet(f"{c.sf_dir}/part.parquet").select(F.col("p_partkey").alias("n"), F.concat(F.get(raw, at), "p_name").alias("raw"), F.get(note, at).alias("note"))


query(
    "src_rule_content",
    """SELECT p_partkey AS n, bytes || hex(p_name) AS bytes, ids FROM part JOIN (VALUES (1, '474554202F78', 'T1059'), (2, '616263', ''), (3, '', 'T12345.6,T0001'), (4, '71225C3A7C', ''), (5, NULL, 'T1001'), (6, NULL, ''), (7, NULL, ''), (8, NULL, ''), (9, 'C3A9', ''), (10, '', '')) v(n, bytes, ids) ON p_partkey % 10 + 1 = v.n""",
)(lambda c: _part_contents(c).select("n", content_hex(F.col("raw")).alias("bytes"), F.concat_ws(",", technique_ids(F.col("note"))).alias("ids")))


def _hits(c: Capture) -> DataFrame:
    # Decoded packets are written before, so that no rule decodes them anew.
    sent = c._keep("sent", lambda: D.layers(frames(c.packets).select("idx", "ts_ns", "link", "frame")).select("ts_ns", "transport", "src_ip", "dst_ip", "src_port", "dst_port", "payload"))
    return rules.matches(sent, parsed(_lines(c)))


def _rule(sid: int, severity: str, score: int, title: str, attack: str, size: int, where: str) -> str:
    return f"SELECT DISTINCT 'rule_match' AS kind, '{severity}' AS severity, {score} AS score, '{title}' AS title, src_ip, dst_ip, dst_port, '{attack}' AS attack, 'rule sid:{sid}; matched content ({size} bytes)' AS evidence FROM packet WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL AND {where}"


query(
    "det_rule",
    " UNION ALL ".join([
        _rule(1, "high", 70, "Miner; login", "T1496,T1496.001", 13, "stratum = 'miner' AND transport = 'tcp'"), _rule(2, "critical", 90, "FTP user", "T1552", 8, "cleartext_cred = 'FTP' AND stratum IS NULL"),
        _rule(3, "low", 25, "sid:3", "", 10, "cleartext_cred = 'HTTP Basic' AND http_host IS NOT NULL AND stratum IS NULL AND transport = 'tcp' AND dst_port = 80"),
        _rule(5, "low", 25, "Executable", "", 6, "download = 'executable' AND http_host IS NULL AND stratum IS NULL AND cleartext_cred IS NULL AND transport = 'tcp'"),
    ]),
)(lambda c: _hits(c).select("kind", "severity", "score", "title", "src_ip", "dst_ip", "dst_port", F.concat_ws(",", "attack").alias("attack"), F.concat_ws("; ", "evidence").alias("evidence")))
query("det_rule_fold")(lambda c: rules.folded(c.findings, _hits(c)).withColumns({"stages": F.concat_ws(",", "stages"), "attack": F.concat_ws(",", "attack")}))


def _steps(c: Capture) -> DataFrame:
    return forecast.steps(series.dense_series(series.cells(c.packets), WIDTH), forecast.KEYS, least_peak=forecast.LEAST_PEAK)


# The folds are recursive; tests/test_forecast.py holds them and the choice among series against plain loops.
_flat = lambda df: df.withColumns({k: F.concat_ws("; ", k) for k in ("attack", "evidence", "victims")})
query("fc_anomaly")(lambda c: _flat(forecast.anomalies(_steps(c), WIDTH)))
query("fc_suppress")(lambda c: _flat(forecast.unexplained(forecast.anomalies(_steps(c), WIDTH))))
query("det_forecast")(lambda c: _flat(forecast.traffic_anomalies(series.dense_series(series.cells(c.packets), WIDTH), WIDTH)))


def _flow_files(c: Capture) -> DataFrame:
    """The flow table as two captures of one folder, the second without ``ioc``, read back."""
    table = c.table.withColumn("flow_id", F.lit(0).cast("long"))
    # The flows are checkpointed, so the shared folder is known by now.
    path = f"{c.spark.sparkContext.getCheckpointDir()}/flows-{uuid.uuid4().hex}"
    write_flows(table, path)
    write_flows(table.withColumn("capture_id", F.lit(2).cast("long")).drop("ioc"), path)
    return read_flows(c.spark, path)


_COLS = ", ".join(f"{{{k}}}" if k in ("flow_id", "capture_id", "ioc") else k for k in FLOW_COLUMNS)
query("src_flow_parquet", " UNION ALL ".join(f"SELECT {_COLS.format(flow_id='0 AS flow_id', capture_id=f'{n} AS capture_id', ioc=ioc)} FROM flow" for n, ioc in ((1, "ioc"), (2, "NULL AS ioc"))))(_flow_files)
