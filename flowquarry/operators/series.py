"""Traffic cells, dense series and running statistics of internal hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.net import is_external

SECOND = 1_000_000_000
#: Fixed value: keys of one host that get series of their own.
TOP_KEYS = 8
#: Fixed value: weight of the newest capture in the moving average of a baseline.
EWMA = 0.3
#: Fixed value: most points that several deviations add to a score.
DIMENSION_CAP = 45


def cells(packets: DataFrame) -> DataFrame:
    """(direction, dim, host, key, second, bytes): wire bytes of internal hosts with external peers, in all, by peer and by service port.

    All three groupings go through one shuffle; a packet counts once in each.
    """
    known = packets.filter(F.col("ts_known") & F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    out, back = is_external(F.col("dst_ip")) & ~is_external(F.col("src_ip")), is_external(F.col("src_ip")) & ~is_external(F.col("dst_ip"))
    sided = known.withColumn("direction", F.when(out, "egress").when(back, "ingress")).filter("direction is not null")
    egress = F.col("direction") == "egress"
    port = F.least("src_port", "dst_port").cast("string")
    dims = F.array(F.struct(F.lit("host").alias("dim"), F.lit("").alias("key")), F.struct(F.lit("peer").alias("dim"), F.when(egress, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("key")), F.struct(F.lit("port").alias("dim"), port.alias("key")))
    each = sided.select("direction", F.when(egress, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("host"), F.floor(F.col("ts_ns") / SECOND).alias("second"), "wire_len", F.inline(dims))
    return each.groupBy("direction", "dim", "host", "key", "second").agg(F.sum("wire_len").alias("bytes"))


def dense_series(found: DataFrame, width: int, top: int = TOP_KEYS) -> DataFrame:
    """(direction, dim, host, key, bin, bytes): cells in bins of ``width`` seconds, with zeros between a series' first and last bin.

    Of the peers and ports of a host the ``top`` largest have series.
    """
    ids = ["direction", "dim", "host", "key"]
    binned = found.groupBy(*ids, F.floor(F.col("second") / width).alias("bin")).agg(F.sum("bytes").alias("bytes"))
    total = binned.groupBy(*ids).agg(F.sum("bytes").alias("total"), F.min("bin").alias("low"), F.max("bin").alias("high"))
    place = F.row_number().over(Window.partitionBy("direction", "dim", "host").orderBy(F.desc("total"), "key"))
    grid = total.withColumn("place", place).filter(F.col("place") <= top).select(*ids, F.explode(F.sequence("low", "high")).alias("bin"))
    return grid.join(binned, [*ids, "bin"], "left").select(*ids, "bin", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def running(snapshots: DataFrame, key: str, order: str, value: str, weight: float = EWMA) -> DataFrame:
    """(key, n, mean, deviation, least, most, ewma) over the captures of each key; a key has one row a capture."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double"))
    stats = snapshots.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most"), ordered.alias("past"))
    moving = F.aggregate(F.slice("past", 2, F.greatest(F.size("past") - 1, F.lit(0))), F.element_at("past", 1), lambda acc, x: acc * (1 - weight) + x * weight)
    return stats.withColumn("ewma", moving).drop("past")


def merged_moments(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Count, mean and sum of squared deviations of two parts together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, F.when(n == 0, 0.0).otherwise(a[1] + gap * b[0] / n), F.when(n == 0, 0.0).otherwise(a[2] + b[2] + gap * gap * a[0] * b[0] / n)


def phase(unix: Column, slot: int, period: int) -> Column:
    """Place of a time in a cycle of ``period`` slots of ``slot`` seconds, for times before 1970 too."""
    return F.pmod(F.floor(unix / slot), F.lit(period))


def clamped_points(points: Column) -> Column:
    """Sum of an array of points, between zero and the cap."""
    return F.greatest(F.lit(0), F.least(F.lit(DIMENSION_CAP), F.aggregate(points, F.lit(0).cast("int"), lambda acc, x: acc + x)))
