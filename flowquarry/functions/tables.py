"""Small constant tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_TYPES = {"string": pa.string(), "int": pa.int32(), "short": pa.int16(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def constant(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A local relation of ``rows``.  Spark knows its size, so that joins with it need no shuffle."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return spark.createDataFrame(pa.table({n: pa.array(list(c), _TYPES[k]) for n, k, c in zip(names, kinds, cols, strict=True)}))
