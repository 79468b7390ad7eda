"""Holt forecasts of series with a residual band, and the bins that leave it.

A series is one row with its bins in order: the fold is sequential by nature, and a series has as many bins as the
capture's time has widths, however much traffic they count.  Many series spread over the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.net import human_bytes, let
from flowquarry.operators.detect import COLUMNS

# Smoothing of level, trend and residual variance, band width, warm-up, CUSUM slack and limit, least sigma.
ALPHA, BETA, GAMMA, Z, MIN_BINS, SLACK, LIMIT, FLOOR = 0.4, 0.2, 0.3, 4.0, 8, 0.5, 6.0, 0.15
# Points of a spike, a level shift and a drop, least bytes of a series' largest bin, and the order in which series explain each other.
POINTS = {"spike": 15, "shift": 15, "drop": 10}
LEAST_PEAK = 8_192
DIMS = ["host", "peer", "port"]
KEYS = ["direction", "dim", "host", "key"]


def steps(series: DataFrame, keys: list[str], order: str = "bin", value: str = "bytes", least_peak: float = 0) -> DataFrame:
    """(keys, bin, t, actual, forecast, sigma, z, spike, drop, shift): every bin but the first of each series of three bins or more.

    Series whose largest bin is below ``least_peak`` are left out.  The CUSUM sums start at the warm-up's end and begin anew after a shift.
    """
    whole = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("bin"), F.col(value).cast("double").alias("y")))).alias("s")).filter(F.size("s") >= 3)
    whole = whole.filter(F.array_max(F.transform("s", lambda x: x["y"])) >= least_peak)
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["y"]) / F.size("s")
    whole = whole.withColumn("floor_", F.greatest(F.lit(1.0), FLOOR * mean))
    y = lambda i: F.col("s")[i]["y"]
    zero = F.lit(0.0)
    shape = "array<struct<bin:bigint,t:int,actual:double,forecast:double,sigma:double,z:double,spike:boolean,drop:boolean,shift:boolean>>"
    start = F.struct(y(0).alias("level"), (y(1) - y(0)).alias("trend"), zero.alias("var"), zero.alias("hi"), zero.alias("lo"), F.lit(0).alias("t"), F.array().cast(shape).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        forecast = acc["level"] + acc["trend"]
        sigma = F.greatest(F.sqrt(acc["var"]), F.col("floor_"))
        now = F.struct((acc["t"] + 1).alias("t"), forecast.alias("f"), sigma.alias("sigma"), ((x["y"] - forecast) / sigma).alias("z"), (ALPHA * x["y"] + (1 - ALPHA) * forecast).alias("level"))

        def with_sums(n: Column) -> Column:
            warm = n["t"] >= MIN_BINS
            clamped = F.greatest(F.lit(-1e6), F.least(F.lit(1e6), n["z"]))
            sums = F.struct(F.when(warm, F.greatest(zero, acc["hi"] + clamped - SLACK)).otherwise(zero).alias("hi"), F.when(warm, F.greatest(zero, acc["lo"] - clamped - SLACK)).otherwise(zero).alias("lo"))

            def made(c: Column) -> Column:
                shift = warm & ((c["hi"] > LIMIT) | (c["lo"] > LIMIT))
                spike, drop = warm & (n["z"] >= Z), warm & (n["z"] <= -Z) & (n["f"] > F.col("floor_"))
                row = F.struct(x["bin"].cast("long").alias("bin"), n["t"].alias("t"), x["y"].alias("actual"), n["f"].alias("forecast"), n["sigma"].alias("sigma"), n["z"].alias("z"), spike.alias("spike"), drop.alias("drop"), shift.alias("shift"))
                trend = BETA * (n["level"] - acc["level"]) + (1 - BETA) * acc["trend"]
                var = GAMMA * (x["y"] - n["f"]) * (x["y"] - n["f"]) + (1 - GAMMA) * acc["var"]
                rest = [F.when(shift, zero).otherwise(c[k]).alias(k) for k in ("hi", "lo")]
                return F.struct(n["level"].alias("level"), trend.alias("trend"), var.alias("var"), *rest, n["t"].alias("t"), F.concat(acc["out"], F.array(row)).alias("out"))

            return let(sums, made)

        return let(now, with_sums)

    folded = F.aggregate(F.slice("s", 2, F.size("s")), start, step)
    return whole.select(*keys, F.inline(folded["out"]))


def hits(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, hit): a row for each spike, drop and level shift."""
    kinds = F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in ("spike", "drop", "shift")]), lambda k: k.isNotNull())
    return found.select(*keys, "bin", F.explode(kinds).alias("hit"))


def band(found: DataFrame, keys: list[str], z: float = Z) -> DataFrame:
    """(keys, bin, actual, forecast, lower, upper): the band around each forecast, not below zero."""
    low = lambda x: F.greatest(F.lit(0.0), x)
    f, s = F.col("forecast"), z * F.col("sigma")
    return found.select(*keys, "bin", "actual", low(f).alias("forecast"), low(f - s).alias("lower"), low(f + s).alias("upper"))


def anomalies(found: DataFrame, width: int) -> DataFrame:
    """Findings of the kind ``traffic_anomaly`` beside (direction, dim, key): one for each series of ``steps`` that has hits.

    ``found``: steps of the series (direction, dim, host, key) in bins of ``width`` seconds.  The largest hit of each
    kind is evidence; the largest of all gives the title, the later of two that are equal.
    """
    kinds = F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in ("spike", "drop", "shift")]), lambda k: k.isNotNull())
    each = found.select(*KEYS, "bin", "actual", "forecast", "sigma", F.abs("z").alias("z"), F.explode(kinds).alias("hit"))
    largest = lambda k: F.max(F.when(F.col("hit") == k, F.struct("z", "bin", "actual", "forecast", "sigma"))).alias(k)
    g = each.groupBy(*KEYS).agg(*map(largest, POINTS), F.max(F.struct("z", "bin", (F.col("hit") == "shift").alias("late"), "hit", "actual", "forecast")).alias("top"), F.min("bin").alias("low"), F.max("bin").alias("high"))
    egress = F.col("direction") == "egress"
    where = F.when(F.col("dim") == "peer", F.concat(F.when(egress, " to ").otherwise(" from "), F.col("key"))).when(F.col("dim") == "port", F.concat(F.lit(" on port "), F.col("key"))).otherwise("")
    size = lambda c: human_bytes(F.greatest(F.col(c), F.lit(0.0)).cast("long"))
    clock = lambda c: F.date_format(F.timestamp_seconds(F.col(c) * width), "HH:mm:ss")

    def line(k: str) -> Column:
        return F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k} in "), "direction", where, F.lit(" at "), clock(f"{k}.bin"), F.lit(": "), size(f"{k}.actual"), F.lit(" against "), size(f"{k}.forecast"), F.lit(" (sigma "), size(f"{k}.sigma"), F.lit(")")))

    score = sum((F.when(F.col(k).isNotNull(), n).otherwise(0) for k, n in POINTS.items()), F.lit(0))
    attack = F.when(F.col("spike").isNotNull() | F.col("shift").isNotNull(), F.array(F.when(egress, "T1048").otherwise("T1498"))).otherwise(F.array().cast("array<string>"))
    title = F.concat("host", F.lit(": "), "direction", F.lit(" "), F.col("top.hit"), where, F.lit(", "), size("top.actual"), F.lit(" against a forecast of "), size("top.forecast"))
    return g.withColumn("score", score.cast("int")).select(
        "direction", "dim", "key", F.lit("traffic_anomaly").alias("kind"), F.when(F.col("score") >= 35, "medium").when(F.col("score") >= 15, "low").otherwise("info").alias("severity"), "score", title.alias("title"), F.col("host").alias("src_ip"),
        F.when(F.col("dim") == "peer", F.col("key")).alias("dst_ip"), F.when(F.col("dim") == "port", F.col("key").cast("int")).alias("dst_port"), attack.alias("attack"), F.array_compact(F.array(*map(line, POINTS))).alias("evidence"),
        (F.col("low") * width * 1_000_000_000).cast("long").alias("first_ns"), ((F.col("high") + 1) * width * 1_000_000_000).cast("long").alias("last_ns"), F.array().cast("array<string>").alias("victims"),
    )


def unexplained(found: DataFrame) -> DataFrame:
    """Of each host and direction the anomalies of the whole host, else those by peer, else those by port."""
    place = F.array_position(F.array(*map(F.lit, DIMS)), F.col("dim"))
    first = found.groupBy("direction", "src_ip").agg(F.min(place).alias("first_"))
    return found.join(first, ["direction", "src_ip"]).filter(place == F.col("first_")).select(*found.columns)


def traffic_anomalies(series: DataFrame, width: int) -> DataFrame:
    """Findings of all series (direction, dim, host, key, bin, bytes) in bins of ``width`` seconds."""
    return unexplained(anomalies(steps(series, KEYS, least_peak=LEAST_PEAK), width)).select(*COLUMNS)
