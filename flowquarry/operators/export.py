"""Exports of findings and flows as lines of text: CSV, CEF and Sigma, each a column expression of a row; ``df.write.text`` stores them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the two CSV files, severities of CEF and Sigma, log sources of findings.
FINDING_CSV = "kind severity score src_ip dst_ip dst_port attack title evidence".split()
FLOW_CSV = "flow_id src_ip src_port dst_ip dst_port proto app_proto category severity threat_score ioc bytes_c2s bytes_s2c bytes_total pkts start end duration_ms sni http_host http_ua ja3 ja4 ja3s tls_version tls_cipher hassh hassh_server".split()
CEF_SEVERITY = {"critical": 10, "high": 8, "medium": 5, "low": 3, "info": 1}
SIGMA_LEVEL = {"info": "informational"}
SIGMA_SOURCE = {"dns_tunnel": "dns", "dga": "dns", "cleartext_creds": "proxy", "pii_exposure": "proxy"}


def _mapped(column: str, table: dict, other: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(column)], other)


def csv_field(value: Column) -> Column:
    """A field, in quotes where it has a comma, a quote or a line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(line): any rows as CSV, without the header."""
    return df.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in columns or df.columns]).alias("line"))


def findings_csv(findings: DataFrame) -> DataFrame:
    flat = findings.withColumns({"attack": F.concat_ws(";", "attack"), "evidence": F.concat_ws("; ", "evidence")})
    return csv_lines(flat, FINDING_CSV)


def flows_csv(flows: DataFrame) -> DataFrame:
    """``flows``: the flow table, oriented, with start_ts and end_ts."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    ms = lambda c: F.expr(f"unix_micros({c}) div 1000")
    flat = flows.withColumns({"bytes_total": F.col("bytes_c2s") + F.col("bytes_s2c"), "start": stamp("start_ts"), "end": stamp("end_ts"), "duration_ms": ms("end_ts") - ms("start_ts")})
    return csv_lines(flat, FLOW_CSV)


def _cef(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("=", "\\="), ("\n", "\\n"), ("\r", "")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def cef_lines(findings: DataFrame, vendor: str = "flowquarry", version: str = "1") -> DataFrame:
    """(line): a CEF record for each finding."""
    some = lambda c: F.when(F.size(c) > 0, True)
    parts = F.concat_ws(
        " ",
        F.concat(F.lit("src="), _cef(F.col("src_ip"))), F.concat(F.lit("dst="), _cef(F.col("dst_ip"))), F.concat(F.lit("dpt="), F.col("dst_port").cast("string")),
        F.when(some("attack"), F.concat(F.lit("cs1Label=ATT&CK cs1="), _cef(F.concat_ws(",", "attack")))), F.concat(F.lit("cn1Label=score cn1="), F.col("score").cast("string")),
        F.when(some("evidence"), F.concat(F.lit("msg="), _cef(F.concat_ws("; ", "evidence")))),
    )
    severity = _mapped("severity", CEF_SEVERITY, F.lit(1)).cast("string")
    return findings.select(F.concat_ws("|", F.lit("CEF:0"), F.lit(vendor), F.lit(vendor), F.lit(version), _cef(F.col("kind")), _cef(F.col("title")), severity, parts).alias("line"))


def _yaml(text: Column) -> Column:
    clean = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.translate(clean, "\n\r\t", "   "), F.lit('"'))


def sigma_rules(findings: DataFrame, author: str = "flowquarry") -> DataFrame:
    """(rule): a Sigma rule for each finding; its id follows from kind, ends and port alone."""
    seed = F.concat_ws("|", F.lit("sigma"), "kind", "src_ip", F.coalesce("dst_ip", F.lit("")), F.coalesce(F.col("dst_port").cast("string"), F.lit("")))
    h = F.sha2(seed, 256)
    ident = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    line = lambda key, value: F.concat(F.lit(key), value, F.lit("\n"))
    each = lambda f: F.array_join(F.transform("attack", f), "")
    any_ = F.size("attack") > 0
    url = lambda a: line("  - ", _yaml(F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace(a, F.lit("."), F.lit("/")), F.lit("/"))))
    chosen = F.when(F.col("dst_ip").isNotNull(), F.concat(line("    dst_ip: ", _yaml(F.col("dst_ip"))), F.coalesce(line("    dst_port: ", F.col("dst_port").cast("string")), F.lit("")))).otherwise(line("    src_ip: ", _yaml(F.col("src_ip"))))
    rule = F.concat(
        line("title: ", _yaml(F.concat(F.lit(f"{author}: "), F.col("title")))), line("id: ", ident), F.lit("status: experimental\n"),
        F.when(F.size("evidence") > 0, line("description: ", _yaml(F.concat_ws("; ", "evidence")))).otherwise(""), F.lit(f"author: {author}\n"),
        F.when(any_, F.concat(F.lit("references:\n"), each(url))).otherwise(""), line("logsource:\n  category: ", _mapped("kind", SIGMA_SOURCE, F.lit("firewall"))),
        F.lit("detection:\n  selection:\n"), chosen, F.lit("  condition: selection\nfields:\n  - src_ip\n  - dst_ip\n  - dst_port\nfalsepositives:\n  - Legitimate administrative or monitoring traffic\n"),
        line("level: ", _mapped("severity", SIGMA_LEVEL, F.col("severity"))), F.when(any_, F.concat(F.lit("tags:\n"), each(lambda a: line("  - attack.", F.lower(a))))).otherwise(""),
    )
    return findings.select(rule.alias("rule"))


def _uuid(*seed: Column | str) -> Column:
    """A name-based id: the same words give the same id."""
    h = F.sha2(F.concat_ws("|", *seed), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def misp_attributes(findings: DataFrame, domains: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(type, value, attribute): the attributes of a MISP event, each as a JSON object, one a type and value.

    ``domains``: (host, malicious); ``fingerprints``: (ja3, ja4, label).  Targets carry the title of their finding of the
    highest score, the first by title among equals; fingerprints the first label.
    """
    best = F.min_by("title", F.struct(-F.col("score"), "title"))
    ips = findings.filter("dst_ip is not null").groupBy(F.col("dst_ip").alias("value")).agg(best.alias("comment")).select(F.lit("ip-dst").alias("type"), "value", F.lit(True).alias("to_ids"), "comment")
    hosts = domains.filter("host is not null").groupBy(F.col("host").alias("value")).agg(F.bool_or(F.coalesce("malicious", F.lit(False))).alias("to_ids")).select(F.lit("domain").alias("type"), "value", "to_ids", F.lit("").alias("comment"))
    both = F.inline(F.array(F.struct(F.lit("ja3-fingerprint-md5").alias("type"), F.col("ja3").alias("value")), F.struct(F.lit("ja4").alias("type"), F.col("ja4").alias("value"))))
    marks = fingerprints.select(both, "label").filter("value is not null").groupBy("type", "value").agg(F.min("label").alias("comment")).select("type", "value", F.lit(True).alias("to_ids"), "comment")
    rows = ips.unionByName(hosts).unionByName(marks)
    fields = F.struct(_uuid(F.lit("misp"), F.lit("attribute"), "type", "value").alias("uuid"), "type", F.lit("Network activity").alias("category"), "value", "to_ids", "comment")
    return rows.select("type", "value", F.to_json(fields).alias("attribute"))


def misp_event(findings: DataFrame, source: str, unix: int) -> DataFrame:
    """(event): one row, the head of the event as JSON, to which the attributes belong; its tags are the techniques of all findings."""
    worst = F.max(F.when(F.col("severity").isin("critical", "high"), 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0))
    g = findings.agg(F.count(F.lit(1)).alias("n"), F.coalesce(worst, F.lit(0)).alias("worst"))
    tags = findings.select(F.explode("attack").alias("a")).distinct().agg(F.sort_array(F.collect_list("a")).alias("ids"))
    info = F.concat(F.lit(f"flowquarry analysis of {source}: "), F.col("n").cast("string"), F.lit(" findings"))
    fields = F.struct(
        _uuid(F.lit("misp"), F.lit("event"), F.lit(source), F.lit(str(unix))).alias("uuid"), info.alias("info"), F.date_format(F.timestamp_seconds(F.lit(unix)), "yyyy-MM-dd").alias("date"), (4 - F.col("worst")).cast("string").alias("threat_level_id"),
        F.lit("2").alias("analysis"), F.lit(False).alias("published"), F.lit(str(unix)).alias("timestamp"), F.transform("ids", lambda a: F.struct(F.concat(F.lit("mitre-attack:"), a).alias("name"))).alias("Tag"),
    )
    # Both sides are aggregates of one row.
    return g.join(F.broadcast(tags), F.lit(True)).select(F.to_json(fields).alias("event"))
