"""Read-only SQL console over the flow table: guard, shipped queries, filters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_LIMIT, LOAD_LIMIT, TIMEOUT_SECONDS = 5000, 1_000_000, 20

# Words that no console statement may have outside strings and comments.
DENIED = "alter attach begin call checkpoint commit copy create delete detach drop export force grant import insert install load pragma reset revoke rollback set transaction truncate update use vacuum".split()

#: Functions of the engine that run any method of its host, and first parts of names that read files or other catalogs.
REFLECTIVE = {"reflect", "java_method", "try_reflect", "read_files", "input_file_name"}
OUTSIDE = {"text", "csv", "json", "parquet", "orc", "avro", "xml", "binaryfile", "jdbc", "kafka", "delta", "iceberg", "hive", "noop", "spark_catalog", "global_temp", "system", "session", "information_schema"}

_TOKENS = re.compile(r"(?P<line>--[^\n]*)|(?P<open>/\*)|(?P<string>'(?:[^']|'')*'?)|(?P<quoted>\"(?:[^\"]|\"\")*\"?|`(?:[^`]|``)*`?)|(?P<word>[A-Za-z_]\w*)|(?P<number>\d[\w.]*)|(?P<space>\s+)|(?P<sign>.)", re.DOTALL)


@dataclass(frozen=True)
class Verdict:
    ok: bool
    sql: str = ""
    reason: str = ""


def _pieces(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKENS.match(sql, at)
        kind, text, at = m.lastgroup, m[0], m.end()
        if kind == "open":  # block comments nest
            depth = 1
            while depth and at < len(sql):
                step = re.compile(r"/\*|\*/|.", re.DOTALL).match(sql, at)
                depth += {"/*": 1, "*/": -1}.get(step[0], 0)
                at = step.end()
            if depth:
                raise ValueError("unclosed comment")
        elif kind not in ("line", "space"):
            out.append((kind, text))
    return out


def _outside(tokens: list[tuple[str, str]]) -> str | None:
    """The first function or dotted name that reaches beyond the views: a reflective call, a file behind a format, a catalog, a class."""
    at = 0
    while at < len(tokens):
        kind, text = tokens[at]
        if kind not in ("word", "quoted"):
            at += 1
            continue
        parts = [text.strip('`"').lower()]
        while at + 2 < len(tokens) and tokens[at + 1] == ("sign", ".") and tokens[at + 2][0] in ("word", "quoted"):
            at += 2
            parts.append(tokens[at][1].strip('`"').lower())
        at += 1
        called = at < len(tokens) and tokens[at] == ("sign", "(")
        if called and parts[-1] in REFLECTIVE:
            return parts[-1]
        if len(parts) > 1 and (parts[0] in OUTSIDE or len(parts) > 3 or any(set("/:\\") & set(p) for p in parts)):
            return ".".join(parts)
    return None


def guard(sql: str, limit: int | None = ROW_LIMIT) -> Verdict:
    """Admit one SELECT or WITH statement over the given views; add a limit where the outermost query has none.

    Names with a format, a catalog or a path before the dot, and calls that reach the host, are denied before the engine sees them.
    """
    try:
        tokens = _pieces(sql)
    except ValueError as e:
        return Verdict(False, reason=str(e))
    while tokens and tokens[-1] == ("sign", ";"):
        tokens.pop()
    if not tokens:
        return Verdict(False, reason="empty statement")
    if ("sign", ";") in tokens:
        return Verdict(False, reason="more than one statement")
    words = [t.lower() for k, t in tokens if k == "word"]
    if tokens[0][0] != "word" or words[0] not in ("select", "with"):
        return Verdict(False, reason="only SELECT or WITH")
    for w in words:
        if w in DENIED:
            return Verdict(False, reason=f"{w.upper()} is not allowed")
    outside = _outside(tokens)
    if outside:
        return Verdict(False, reason=f"{outside} is not allowed")
    depth, limited = 0, False
    for kind, text in tokens:
        depth += {"(": 1, ")": -1}.get(text, 0) if kind == "sign" else 0
        limited |= kind == "word" and depth == 0 and text.lower() == "limit"
    body = sql.rstrip()
    while body.endswith(";"):
        body = body[:-1].rstrip()
    return Verdict(True, body if limited or limit is None else f"{body}\nLIMIT {limit}")


def run(spark: SparkSession, sql: str, limit: int | None = ROW_LIMIT, **views: DataFrame) -> DataFrame:
    """Run a guarded statement over views; Spark's parser has the last word on what is a query.  ``limit``: most rows shown, None for all."""
    v = guard(sql, limit)
    if not v.ok:
        raise ValueError(v.reason)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(v.sql)


# The shipped analyst queries over the views flow, finding and incident, with casts and names for columns that
# Spark and DuckDB would type or name differently.
QUERIES = {
    "q01": """WITH ends AS (SELECT src_ip AS ip, bytes_c2s + bytes_s2c AS b, pkts FROM flow UNION ALL SELECT dst_ip, bytes_c2s + bytes_s2c, pkts FROM flow)
        SELECT ip, CAST(SUM(b) AS BIGINT) AS total_bytes, CAST(SUM(pkts) AS BIGINT) AS total_pkts, COUNT(*) AS flows FROM ends GROUP BY ip ORDER BY total_bytes DESC, ip LIMIT 50""",
    "q02": "SELECT severity, COUNT(*) AS findings, MAX(confidence) AS max_confidence FROM finding GROUP BY severity ORDER BY array_position(array('critical', 'high', 'medium', 'low', 'info'), severity)",
    "q03": "SELECT category, COUNT(*) AS flows, CAST(SUM(pkts) AS BIGINT) AS pkts, CAST(SUM(bytes_c2s + bytes_s2c) AS BIGINT) AS bytes FROM flow GROUP BY category ORDER BY bytes DESC",
    "q04": """SELECT src_ip, dst_ip, dst_port, COUNT(*) AS flow_count, ROUND(AVG(bytes_c2s + bytes_s2c), 4) AS avg_bytes, ROUND(STDDEV_POP(bytes_c2s + bytes_s2c), 4) AS std_bytes, MIN(start_ts) AS first_seen, MAX(end_ts) AS last_seen
        FROM flow GROUP BY src_ip, dst_ip, dst_port HAVING COUNT(*) >= 5 ORDER BY flow_count DESC, std_bytes, src_ip, dst_ip, dst_port LIMIT 100""",
    "q05": "SELECT proto, COALESCE(app_proto, 'unknown') AS app_proto, COUNT(*) AS flows, CAST(SUM(pkts) AS BIGINT) AS pkts, CAST(SUM(bytes_c2s + bytes_s2c) AS BIGINT) AS bytes FROM flow GROUP BY proto, COALESCE(app_proto, 'unknown') ORDER BY bytes DESC",
    "q06": "SELECT dst_port, proto, COUNT(*) AS flows, CAST(SUM(pkts) AS BIGINT) AS pkts, CAST(SUM(bytes_c2s + bytes_s2c) AS BIGINT) AS bytes FROM flow GROUP BY dst_port, proto ORDER BY pkts DESC, dst_port, proto LIMIT 50",
    "q07": "SELECT date_trunc('second', start_ts) AS bucket, COUNT(*) AS flows, CAST(SUM(pkts) AS BIGINT) AS pkts, CAST(SUM(bytes_c2s + bytes_s2c) AS BIGINT) AS bytes FROM flow GROUP BY date_trunc('second', start_ts) ORDER BY bucket",
    "q08": "SELECT host, severity, COUNT(*) AS incidents, MAX(created_at) AS last_incident FROM incident GROUP BY host, severity ORDER BY array_position(array('critical', 'high', 'medium', 'low', 'info'), severity), host",
    "q09": "SELECT flow_id, src_ip, dst_ip, dst_port, category, severity, threat_score FROM flow WHERE ioc OR severity IN ('high', 'critical') ORDER BY threat_score DESC, flow_id LIMIT 500",
}

SEARCHED = "src_ip dst_ip src_port dst_port app_proto category app_proto_src sni ja3 ja4 tls_version tls_cipher hassh hassh_server ja3s http_host http_ua severity".split()


def flow_filter(flows: DataFrame, text: str = "", **facets: object) -> DataFrame:
    """Facet equality, and free text over the concatenated fields."""
    out = flows
    for name, value in facets.items():
        out = out.filter(F.col(name) == value)
    if text.strip():
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in SEARCHED])), F.lit(text.strip().lower())))
    return out


def finding_filter(findings: DataFrame, text: str = "", **facets: object) -> DataFrame:
    out = findings
    for name, value in facets.items():
        out = out.filter(F.col(name) == value)
    if text.strip():
        fields = F.concat_ws(" ", "kind", "title", "src_ip", "dst_ip", F.col("dst_port").cast("string"), F.concat_ws(" ", "attack"), F.concat_ws(" ", "evidence"))
        out = out.filter(F.contains(F.lower(fields), F.lit(text.strip().lower())))
    return out


def worst_first(severity: Column, score: Column) -> list[Column]:
    return [F.array_position(F.array(*map(F.lit, ["critical", "high", "medium", "low", "info"])), severity).asc(), score.desc()]


def restrict(flows: DataFrame, result: DataFrame) -> DataFrame:
    """Flows of a result's flow_id set."""
    return flows.join(result.select("flow_id").distinct(), "flow_id", "left_semi")


def daily_counts(events: DataFrame, days: tuple[str, str], ts: str = "ts") -> DataFrame:
    """Events per day of a calendar, zero-filled."""
    calendar = events.sparkSession.sql("SELECT explode(sequence(date'%s', date'%s')) AS day" % days)
    got = events.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(F.broadcast(got), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def traffic_figures(events: DataFrame) -> DataFrame:
    """Views, sessions and sessions with a purchase."""
    return events.agg(F.count(F.lit(1)).alias("views"), F.count_distinct("user_id").alias("sessions"), F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"))


def top_paths(events: DataFrame, k: int = 20) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("path")).agg(F.count(F.lit(1)).alias("views"), F.count_distinct("user_id").alias("sessions")).orderBy(F.desc("views"), "path").limit(k)


def rate_limit(events: DataFrame, key: str, seconds: int, most: int, ts: str = "ts") -> DataFrame:
    """Requests per key and fixed window, and whether they pass the limit."""
    w = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")
    return events.groupBy(key, w.start.alias("window_start")).agg(F.count(F.lit(1)).alias("n")).withColumn("blocked", F.col("n") > most)


def parse_reply(reply: str) -> dict[str, str]:
    """SQL, intent or error of a text-to-SQL reply: a fenced block, ``-- intent:`` and ``-- error:`` lines."""
    fence = re.search(r"```(?:sql)?\s*\n(.*?)```", reply, re.DOTALL | re.IGNORECASE)
    body = (fence[1] if fence else reply).strip()
    notes = {k.lower(): v.strip() for k, v in re.findall(r"^--\s*(intent|error)\s*:?\s*(.*)$", body, re.IGNORECASE | re.MULTILINE)}
    rest = re.sub(r"^--\s*(?:intent|error).*$", "", body, flags=re.IGNORECASE | re.MULTILINE).strip()
    return {"sql": "" if "error" in notes else rest, "intent": notes.get("intent", ""), "error": notes.get("error", "")}
