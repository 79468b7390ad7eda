"""Flow files: a folder for each capture, in Parquet, read back together by column name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.schema import FLOW_COLUMNS


def write_flows(flows: DataFrame, path: str, compression: str = "snappy") -> None:
    """Write the columns of the flow table that ``flows`` has under ``path``/capture_id=N; captures written again are replaced."""
    kept = flows.select(*[c for c in FLOW_COLUMNS if c in flows.columns])
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy("capture_id").parquet(path)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """The flow table of all captures under ``path``; columns that a capture's files lack are null, and all others are left out."""
    found = spark.read.option("mergeSchema", True).parquet(path)
    return found.select(*[(F.col(c) if c in found.columns else F.lit(None)).alias(c) for c in FLOW_COLUMNS]).withColumn("capture_id", F.col("capture_id").cast("long"))
