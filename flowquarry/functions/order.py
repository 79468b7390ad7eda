"""Global order without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.tables import constant


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode where that is unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir", "")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="flowquarry-"))
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder.

    A table of columns is read again by those columns alone that a reader asks for, and its plan starts anew: a checkpoint
    of rows would carry the constraints of all steps before it.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, name: str, *order: Column | str, partitions: int | None = None) -> DataFrame:
    """Number rows from 0 in ``order``: sort by range, then offset each range by the sizes of those before it.

    Only one count a range goes to the driver.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id()))
    part = F.shiftright("place_", 33)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, size in sizes:
        offsets.append((int(p), total))
        total += size
    ahead = constant(df.sparkSession, offsets or [(0, 0)], "p_ long, off_ long")
    return placed.join(F.broadcast(ahead), part == F.col("p_")).withColumn(name, F.col("off_") + F.col("place_").bitwiseAND(F.lit((1 << 33) - 1))).drop("p_", "off_", "place_")
