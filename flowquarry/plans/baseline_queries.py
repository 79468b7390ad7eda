"""Queries of behavioral baselines: days are captures, and the /24 blocks of clients are the hosts that have a history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.operators import baseline
from flowquarry.plans.oracle import external, num
from flowquarry.plans.queries import _SHOW, Capture, query

DAY = 86_400_000_000_000
#: Days from this one on are held against the profile of those before.
CUT = 19_723 + 15
BLOCK = r"^(\d+\.\d+\.\d+)\."


def _snapshot(c: Capture, block: bool = True) -> baseline.Snapshot:
    client = F.concat(F.regexp_extract("client", BLOCK, 1), F.lit(".0")) if block else F.col("client")
    day = F.expr(f"first_ns div {DAY}")
    return baseline.snapshot(c.contacts.withColumns({"client": client, "capture": day, "unix": day * 86_400}))


def _past(c: Capture) -> baseline.Profile:
    return baseline.build(_snapshot(c).filter(f"capture < {CUT}"))


def _new(c: Capture) -> baseline.Snapshot:
    return _snapshot(c).filter(f"capture >= {CUT}")


def _snap_sql(host: str) -> str:
    return f"""seg AS (SELECT *, {host} AS host, first_ns // {DAY} AS capture FROM contact),
    eg AS (SELECT *, GREATEST(0, first_ns - LAG(first_ns) OVER (PARTITION BY capture, host, server, port ORDER BY first_ns, last_ns, lo_port, hi_port)) AS gap FROM seg WHERE NOT {external(num("host"))} AND {external(num("server"))}),
    ch AS (SELECT *, CASE WHEN gaps < 2 OR mean_gap <= 0 THEN 0 ELSE std_gap / mean_gap END AS cv FROM (
      SELECT capture, host, server, port, COUNT(*) AS contacts, COUNT(gap) AS gaps, COALESCE(AVG(gap), 0) AS mean_gap, COALESCE(STDDEV_POP(gap), 0) AS std_gap, SUM(bytes_out) AS bytes_out, SUM(bytes_in) AS bytes_in FROM eg GROUP BY ALL)),
    vol AS (SELECT capture, host, CAST(SUM(bytes_out) AS BIGINT) AS bytes_out, CAST(SUM(bytes_in) AS BIGINT) AS bytes_in, CAST(SUM(contacts) AS BIGINT) AS flows FROM ch GROUP BY ALL),
    trait AS (
      SELECT DISTINCT capture, host, 'peer' AS dim, server AS value, 1 AS total FROM ch UNION ALL SELECT DISTINCT capture, host, 'port', CAST(port AS VARCHAR), 1 FROM ch
      UNION ALL SELECT DISTINCT capture, host, 'beacon', server || ':' || port, 1 FROM ch WHERE contacts >= 4 AND mean_gap > 0 AND cv <= 0.35
      UNION ALL SELECT DISTINCT capture, host, 'ja3', ja3, 1 FROM seg SEMI JOIN vol USING (capture, host) WHERE ja3 IS NOT NULL
      UNION ALL SELECT capture, host, 'hour', CAST((first_ns // 3600000000000) % 24 AS VARCHAR), COUNT(*) FROM seg SEMI JOIN vol USING (capture, host) GROUP BY ALL
      UNION ALL SELECT capture, host, 'category', category, COUNT(*) FROM seg SEMI JOIN vol USING (capture, host) GROUP BY ALL)"""


_HOSTS = _snap_sql("client")
_BLOCKS = _snap_sql(f"regexp_extract(client, '{BLOCK}', 1) || '.0'")
query("bl_snapshot", f", {_HOSTS} SELECT * FROM vol")(lambda c: _snapshot(c, False).volumes.drop("unix"))
query("bl_snapshot_traits", f", {_HOSTS} SELECT capture, host, dim, value, CAST(total AS BIGINT) AS total FROM trait")(lambda c: _snapshot(c, False).traits.select("capture", "host", "dim", "value", "total"))

_METRICS = "('bytes_out', 0), ('bytes_in', 1), ('flows', 2)"


def _long(where: str) -> str:
    return f"""long AS (SELECT capture, host, metric, CAST(CASE k WHEN 0 THEN bytes_out WHEN 1 THEN bytes_in ELSE flows END AS DOUBLE) AS x, capture % 7 AS phase FROM vol, (VALUES {_METRICS}) m(metric, k) WHERE {where}),
    stat AS (SELECT host, metric, COUNT(*) AS n, AVG(x) AS mean, STDDEV_POP(x) AS deviation, MIN(x) AS least, MAX(x) AS most, SUM(x * POWER(0.7, back - 1) * CASE WHEN back = size THEN 1 ELSE 0.3 END) AS ewma,
      list(x ORDER BY capture) FILTER (WHERE back <= 24) AS xs, list(capture ORDER BY capture) FILTER (WHERE back <= 24) AS days
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY host, metric ORDER BY capture DESC) AS back, COUNT(*) OVER (PARTITION BY host, metric) AS size FROM long) GROUP BY ALL),
    seen AS (SELECT host, dim, value, COUNT(*) AS captures, CAST(SUM(total) AS BIGINT) AS total, MIN(capture) AS first, MAX(capture) AS last FROM trait WHERE {where} GROUP BY ALL)"""


_STAT = "SELECT host, metric, n, ROUND(mean, 3) AS mean, ROUND(deviation, 2) AS deviation, least, most, {} array_to_string(list_transform(xs, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS recent FROM stat"


def _stats(p: baseline.Profile, *more) -> DataFrame:
    recent = F.array_join(F.transform("recent", lambda r: r["value"].cast("long").cast("string")), ",").alias("recent")
    return p.stats.select("host", "metric", "n", F.round("mean", 3).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("n")), 2).alias("deviation"), "least", "most", *more, recent)


_EWMA = lambda: F.round("ewma", 3).alias("ewma")


def _updated(c: Capture) -> baseline.Profile:
    """Three folds of captures in the order of their days."""
    snap = _snapshot(c)
    parts = [snap.filter(w) for w in (f"capture < {CUT - 12}", f"capture between {CUT - 12} and {CUT - 1}", f"capture >= {CUT}")]
    out = baseline.build(parts[0])
    for p in parts[1:]:
        out = baseline.merge(out, baseline.build(p), later=True)
    return out


def _halves(c: Capture) -> baseline.Profile:
    snap = _snapshot(c)
    return baseline.merge(baseline.build(snap.filter("capture % 2 = 0")), baseline.build(snap.filter("capture % 2 = 1")))


_ALL = f", {_BLOCKS}, {_long('TRUE')} "
query("bl_observe", _ALL + _STAT.format("ROUND(ewma, 3) AS ewma,"))(lambda c: _stats(baseline.build(_snapshot(c)), _EWMA()))
query("bl_update", _ALL + _STAT.format("ROUND(ewma, 3) AS ewma,"))(lambda c: _stats(_updated(c), _EWMA()))
query("bl_merge", _ALL + _STAT.format(""))(lambda c: _stats(_halves(c)))
_SEEN = "SELECT host, dim, value, captures, total, first * 86400 AS first_unix, last * 86400 AS last_unix FROM seen"
query("bl_merge_traits", _ALL + _SEEN)(lambda c: _halves(c).traits.drop("interval_ns", "cv"))
_FEW = {"peer": 5, "port": 2, "ja3": 2, "beacon": 1}
query(
    "bl_caps",
    _ALL + f"""SELECT host, dim, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY host, dim ORDER BY captures DESC, total DESC, CASE WHEN dim = 'port' THEN TRY_CAST(value AS INT) END, value) AS place FROM seen)
      JOIN (SELECT host FROM stat WHERE metric = 'bytes_out' ORDER BY n DESC, mean DESC, host LIMIT 4) USING (host) WHERE place <= CASE dim WHEN 'peer' THEN 5 WHEN 'port' THEN 2 WHEN 'ja3' THEN 2 WHEN 'beacon' THEN 1 ELSE 24 END""",
)(lambda c: baseline.capped(baseline.build(_snapshot(c)), _FEW, 4).traits.select("host", "dim", "value"))

# Holt's recurrence step by step over the samples of each series, less the effects of their phases.
_PAST = f""", {_BLOCKS}, {_long(f'capture < {CUT}')},
    phases AS (SELECT host, metric, phase, COUNT(*) AS n, AVG(x) AS mean, STDDEV_POP(x) AS deviation FROM long GROUP BY ALL HAVING COUNT(*) >= 2),
    rhythm AS (SELECT host, metric, COUNT(*) AS phases, AVG(mean) AS every FROM phases GROUP BY ALL),
    effect AS (SELECT host, metric, phase, mean - every AS effect, mean AS own, deviation AS spread FROM phases JOIN rhythm USING (host, metric)),
    asked AS (SELECT v.capture, host, metric, CAST(CASE k WHEN 0 THEN bytes_out WHEN 1 THEN bytes_in ELSE flows END AS DOUBLE) AS observed, v.capture % 7 AS phase FROM vol v, (VALUES {_METRICS}) m(metric, k) WHERE v.capture >= {CUT}),
    chosen AS (SELECT a.*, s.n, s.mean, s.deviation, s.xs, s.days, e.effect, e.own, e.spread, COALESCE(r.phases >= 3 AND e.own IS NOT NULL, FALSE) AS seasonal
      FROM asked a JOIN stat s USING (host, metric) LEFT JOIN rhythm r USING (host, metric) LEFT JOIN effect e USING (host, metric, phase)),
    flat AS (SELECT DISTINCT c.host, c.metric, c.seasonal, list(t.x - CASE WHEN c.seasonal THEN COALESCE(e.effect, 0) ELSE 0 END ORDER BY t.day) AS ys
      FROM (SELECT DISTINCT host, metric, seasonal, xs, days FROM chosen) c, LATERAL (SELECT UNNEST(c.xs) AS x, UNNEST(c.days) AS day) t LEFT JOIN effect e ON e.host = c.host AND e.metric = c.metric AND e.phase = t.day % 7 GROUP BY c.host, c.metric, c.seasonal),
    holt AS (SELECT * FROM (WITH RECURSIVE h AS (
        SELECT host, metric, seasonal, ys, 2 AS i, ys[1] AS level, ys[2] - ys[1] AS trend, CAST(0 AS DOUBLE) AS var FROM flat WHERE len(ys) >= CASE WHEN seasonal THEN 3 ELSE 4 END
        UNION ALL SELECT host, metric, seasonal, ys, i + 1, 0.4 * ys[i] + 0.6 * (level + trend), 0.2 * (0.4 * ys[i] + 0.6 * (level + trend) - level) + 0.8 * trend, 0.3 * (ys[i] - level - trend) * (ys[i] - level - trend) + 0.7 * var FROM h WHERE i <= len(ys))
      SELECT host, metric, seasonal, GREATEST(0, level + trend) AS forecast, GREATEST(SQRT(var), 1, 0.15 * list_avg(ys)) AS sigma FROM h WHERE i = len(ys) + 1)),
    expected AS (SELECT c.*, CASE WHEN c.seasonal THEN 'seasonal' WHEN h.forecast IS NOT NULL THEN 'trend' ELSE 'static' END AS model,
      CASE WHEN c.seasonal AND h.forecast IS NOT NULL THEN GREATEST(0, h.forecast + effect) WHEN c.seasonal THEN own ELSE h.forecast END AS forecast, COALESCE(h.sigma, CASE WHEN c.seasonal THEN GREATEST(spread, 1, 0.15 * GREATEST(1, own)) END) AS sigma
      FROM chosen c LEFT JOIN holt h ON h.host = c.host AND h.metric = c.metric AND h.seasonal = c.seasonal),
    departed AS (SELECT *, CASE WHEN model = 'static' THEN CASE WHEN deviation > 0 AND observed > mean + 4 * deviation THEN 'above' END WHEN observed > forecast + 3 * sigma THEN 'above'
        WHEN observed < GREATEST(0, forecast - 3 * sigma) AND forecast > sigma THEN 'below' END AS direction FROM expected WHERE n >= 5),
    fresh AS (SELECT t.* FROM trait t JOIN (SELECT host FROM stat WHERE metric = 'flows' AND n >= 5) USING (host) LEFT JOIN (SELECT host, COUNT(*) AS hours FROM seen WHERE dim = 'hour' GROUP BY host) USING (host)
      WHERE t.capture >= {CUT} AND (host, dim, value) NOT IN (SELECT (host, dim, value) FROM seen) AND (dim <> 'hour' OR hours BETWEEN 3 AND 23)) """


def _asked(c: Capture) -> DataFrame:
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("observed")) for m in baseline.METRICS])
    return baseline.expected(_past(c), _new(c).volumes.select("capture", "unix", "host", F.inline(each)))


query("bl_seasonal", _PAST + "SELECT capture, host, metric, model, ROUND(forecast, 2) AS forecast, ROUND(sigma, 2) AS sigma, n FROM expected")(
    lambda c: _asked(c).select("capture", "host", "metric", "model", F.round("forecast", 2).alias("forecast"), F.round("sigma", 2).alias("sigma"), "n")
)
query("bl_volume", _PAST + "SELECT capture, host, metric, model, observed, direction FROM departed")(
    lambda c: baseline.judged_volumes(_past(c), _new(c)).select("capture", "host", "metric", "model", "observed", "direction")
)
query("bl_compare", _PAST + "SELECT capture, host, dim, value FROM fresh")(lambda c: baseline.new_traits(_past(c), _new(c)).select("capture", "host", "dim", "value"))
query(
    "det_baseline",
    _PAST + """, found AS (SELECT capture, host, SUM(points) AS points FROM (SELECT capture, host, CASE WHEN model = 'static' THEN 10 ELSE 15 END AS points FROM departed WHERE direction IS NOT NULL
        UNION ALL SELECT DISTINCT ON (capture, host, dim) capture, host, CASE WHEN dim IN ('peer', 'beacon') THEN 15 ELSE 10 END FROM fresh) GROUP BY ALL),
      score AS (SELECT *, CAST(LEAST(45, points) AS INT) AS score FROM found)
      SELECT capture, 'baseline_deviation' AS kind, CASE WHEN score >= 35 THEN 'medium' WHEN score >= 15 THEN 'low' ELSE 'info' END AS severity, score, host AS src_ip,
        COALESCE(MIN(value) FILTER (WHERE dim = 'peer'), split_part(MIN(value) FILTER (WHERE dim = 'beacon'), ':', 1)) AS dst_ip,
        COALESCE(MIN(TRY_CAST(value AS INT)) FILTER (WHERE dim = 'port'), CAST(split_part(MIN(value) FILTER (WHERE dim = 'beacon'), ':', 2) AS INT)) AS dst_port
      FROM score LEFT JOIN (SELECT capture, host, dim, CASE WHEN dim IN ('peer', 'port', 'beacon') THEN value END AS value FROM fresh) USING (capture, host) GROUP BY capture, score, host""",
)(lambda c: baseline.deviations(_past(c), _new(c)).select("capture", *_SHOW))
