"""Queries over series, baselines, reputation answers and single flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.operators import reputation, series, stream
from flowquarry.plans.oracle import external, num
from flowquarry.plans.queries import Capture, query

_OUT, _IN = external(num("dst_ip")), external(num("src_ip"))
_SIDED = f"""(SELECT CASE WHEN {_OUT} THEN 'egress' ELSE 'ingress' END AS direction, CASE WHEN {_OUT} THEN src_ip ELSE dst_ip END AS host, CASE WHEN {_OUT} THEN dst_ip ELSE src_ip END AS peer,
    CAST(LEAST(src_port, dst_port) AS VARCHAR) AS port, ts_ns // 1000000000 AS second, wire_len FROM packet WHERE ts_known AND src_ip IS NOT NULL AND dst_ip IS NOT NULL AND ({_OUT}) <> ({_IN}))"""
_CELLS = f"""cells AS (SELECT direction, dim, host, key, second, CAST(SUM(wire_len) AS BIGINT) AS bytes FROM (
    SELECT direction, 'host' AS dim, host, '' AS key, second, wire_len FROM {_SIDED} UNION ALL SELECT direction, 'peer', host, peer, second, wire_len FROM {_SIDED} UNION ALL SELECT direction, 'port', host, port, second, wire_len FROM {_SIDED})
    GROUP BY ALL)"""
WIDTH = 21_600

query("fc_cells", f", {_CELLS} SELECT * FROM cells")(lambda c: series.cells(c.packets))
query(
    "fc_series",
    f""", {_CELLS}, binned AS (SELECT direction, dim, host, key, second // {WIDTH} AS bin, CAST(SUM(bytes) AS BIGINT) AS bytes FROM cells GROUP BY ALL),
    total AS (SELECT direction, dim, host, key, SUM(bytes) AS total, MIN(bin) AS low, MAX(bin) AS high FROM binned GROUP BY ALL),
    grid AS (SELECT direction, dim, host, key, UNNEST(generate_series(low, high)) AS bin FROM (SELECT * FROM total QUALIFY ROW_NUMBER() OVER (PARTITION BY direction, dim, host ORDER BY total DESC, key) <= 8))
    SELECT direction, dim, host, key, bin, COALESCE(bytes, 0) AS bytes FROM grid LEFT JOIN binned USING (direction, dim, host, key, bin)""",
)(lambda c: series.dense_series(series.cells(c.packets), WIDTH))


def _daily(c: Capture) -> DataFrame:
    """Bytes that each source sent on each day; a day counts as a capture."""
    return c.packets.filter("ts_known and src_ip is not null").groupBy("src_ip", F.floor(F.col("ts_ns") / 86_400_000_000_000).alias("day")).agg(F.sum("wire_len").alias("bytes"))


_DAILY = "daily AS (SELECT src_ip, ts_ns // 86400000000000 AS day, CAST(SUM(wire_len) AS BIGINT) AS bytes FROM packet WHERE ts_known AND src_ip IS NOT NULL GROUP BY ALL)"
query("bl_running", f", {_DAILY} SELECT src_ip, COUNT(*) AS n, ROUND(AVG(bytes), 3) AS mean, ROUND(STDDEV_POP(bytes), 3) AS deviation, MIN(bytes) AS least, MAX(bytes) AS most, ROUND(SUM(bytes * POWER(0.7, back - 1) * CASE WHEN back = size THEN 1 ELSE 0.3 END), 2) AS ewma FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY src_ip ORDER BY day DESC) AS back, COUNT(*) OVER (PARTITION BY src_ip) AS size FROM daily) GROUP BY src_ip")(
    lambda c: series.running(_daily(c), "src_ip", "day", "bytes").select("src_ip", "n", F.round("mean", 3).alias("mean"), F.round("deviation", 3).alias("deviation"), "least", "most", F.round("ewma", 2).alias("ewma"))
)


def _merged(c: Capture) -> DataFrame:
    daily = _daily(c)
    moments = [F.count("bytes").alias("n"), F.avg("bytes").alias("mean"), (F.var_pop("bytes") * F.count("bytes")).alias("m2")]
    early, late = (daily.filter(cond).groupBy("src_ip").agg(*moments) for cond in ("day % 2 = 0", "day % 2 = 1"))
    both = early.alias("a").join(late.alias("b"), "src_ip", "full_outer")
    part = lambda x: tuple(F.coalesce(F.col(f"{x}.{k}"), F.lit(0)) for k in ("n", "mean", "m2"))
    n, mean, m2 = series.merged_moments(part("a"), part("b"))
    return both.select("src_ip", n.alias("n"), F.round(mean, 3).alias("mean"), F.round(F.sqrt(m2 / n), 2).alias("deviation"))


query("bl_merge_stat", f", {_DAILY} SELECT src_ip, COUNT(*) AS n, ROUND(AVG(bytes), 3) AS mean, ROUND(STDDEV_POP(bytes), 2) AS deviation FROM daily GROUP BY src_ip")(_merged)
query("bl_phase", "SELECT idx, ((ts_ns // 3600000000000) % 168 + 168) % 168 AS phase FROM packet WHERE ts_known")(lambda c: c.packets.filter("ts_known").select("idx", series.phase(F.floor(F.col("ts_ns") / 1_000_000_000), 3600, 168).alias("phase")))
query("scr_dims", "SELECT idx, LEAST(45, 15 * (idx % 4) + 10 * (idx % 3)) AS points FROM packet")(lambda c: c.packets.select("idx", series.clamped_points(F.array((F.col("idx") % 4 * 15).cast("int"), (F.col("idx") % 3 * 10).cast("int"))).alias("points")))

query("rep_map_abuseipdb", "SELECT idx, CASE WHEN idx % 101 >= 75 THEN 'malicious' WHEN idx % 101 >= 25 THEN 'unknown' WHEN idx % 3 = 0 THEN 'clean' ELSE 'unknown' END AS verdict FROM packet")(
    lambda c: c.packets.select("idx", reputation.by_confidence(F.col("idx") % 101, F.col("idx") % 3).alias("verdict"))
)
_LABEL = "CASE idx % 3 WHEN 0 THEN 'malicious' WHEN 1 THEN 'benign' ELSE 'unknown' END"
query("rep_map_greynoise", "SELECT idx, CASE WHEN idx % 7 = 0 THEN 'notfound' WHEN idx % 3 = 0 THEN 'malicious' WHEN idx % 3 = 1 OR idx % 5 = 0 THEN 'clean' ELSE 'unknown' END AS verdict FROM packet")(
    lambda c: c.packets.select("idx", reputation.by_label(F.when(F.col("idx") % 7 == 0, 404).otherwise(200), F.expr(_LABEL), F.col("idx") % 5 == 0).alias("verdict"))
)


def _engines(c: Capture) -> DataFrame:
    verdict, share = reputation.by_engines(F.col("idx") % 4, F.lit(70))
    return c.packets.select("idx", verdict.alias("verdict"), share.alias("share"))


query("rep_map_vt", "SELECT idx, CASE WHEN idx % 4 > 0 THEN 'malicious' ELSE 'clean' END AS verdict, CAST(ROUND(100.0 * (idx % 4) / 70) AS INT) AS share FROM packet")(_engines)

_ENDS = "(src_ip = '10.0.1.5' AND dst_ip = '45.77.1.9' AND dst_port = 8081)", "(src_ip = '45.77.1.9' AND dst_ip = '10.0.1.5' AND src_port = 8081)"
_SPAN = (1_704_067_200_000_000_000, 1_704_153_600_000_000_000)
query(
    "pk_extract",
    f", hits AS (SELECT idx, ts_ns, CASE WHEN {_ENDS[0]} THEN 'c2s' ELSE 's2c' END AS direction, wire_len FROM packet WHERE ({_ENDS[0]} OR {_ENDS[1]}) AND ts_ns BETWEEN {_SPAN[0] - 1_000_000} AND {_SPAN[1] + 1_000_000}) SELECT *, (SELECT COUNT(*) FROM hits) AS total FROM hits ORDER BY ts_ns, idx LIMIT 2000",
)(lambda c: stream.extract(c.packets, "10.0.1.5", "45.77.1.9", 8081, *_SPAN))
query(
    "pk_stream",
    """, k AS (SELECT *, CASE WHEN fwd THEN src_ip ELSE dst_ip END AS li, CASE WHEN fwd THEN dst_ip ELSE src_ip END AS hi, CASE WHEN fwd THEN src_port ELSE dst_port END AS lo, CASE WHEN fwd THEN dst_port ELSE src_port END AS ho FROM keyed WHERE ts_known AND payload_len > 0 AND src_ip IS NOT NULL),
    g AS (SELECT *, CASE WHEN fwd <> LAG(fwd) OVER w THEN 1 ELSE 0 END AS changed FROM k WINDOW w AS (PARTITION BY li, lo, hi, ho, transport ORDER BY ts_ns, idx)),
    t AS (SELECT *, SUM(changed) OVER (PARTITION BY li, lo, hi, ho, transport ORDER BY ts_ns, idx) AS turn FROM g)
    SELECT li AS lo_ip, hi AS hi_ip, CAST(lo AS BIGINT) AS lo_port, CAST(ho AS BIGINT) AS hi_port, CAST(turn AS BIGINT) AS turn, fwd, COUNT(*) AS pkts, CAST(SUM(payload_len) AS BIGINT) AS payload FROM t GROUP BY li, lo, hi, ho, transport, turn, fwd""",
)(lambda c: stream.turns(c.packets).select("lo_ip", "hi_ip", F.col("lo_port").cast("long"), F.col("hi_port").cast("long"), "turn", "fwd", "pkts", "payload"))


def _page_hosts(c: Capture) -> DataFrame:
    from flowquarry.sources.indicators import indicators

    return indicators(c.spark.read.parquet(f"{c.sf_dir}/pages.parquet"), "url")


query("src_ioc_text", "SELECT DISTINCT 'domain' AS kind, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS value FROM pages")(_page_hosts)
