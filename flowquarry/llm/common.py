"""Helpers that several operators share: scratch tables, tokenizer files, ordered shards."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file.  The package that holds the files is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``; a temporary folder only in local mode where that is unset."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="flowquarry-"))
        found = sc.getCheckpointDir()
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back; this cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    # The job's shuffle files are of no further use once the table is there.
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and that no later job reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def numbered(docs: DataFrame, nulls_last: bool = False) -> tuple[DataFrame, str]:
    """``docs`` as a written table with a row number in the order (doc_id, text), and the new column's name.

    Rows of equal doc_id, null included, and equal rows have numbers of their own.
    """
    name = free_name("row_", docs.columns)
    key = F.asc_nulls_last("doc_id") if nulls_last else F.asc_nulls_first("doc_id")
    # Starts of texts bound the ranges, so rows of one doc_id are dealt as well and no long texts go to the driver.
    dealt = docs.repartitionByRange(shuffle_partitions(docs.sparkSession), key, F.asc_nulls_first(F.substring(F.col("text").cast("string"), 1, 64)))
    return materialise(dealt.sortWithinPartitions(key, F.asc_nulls_first("text")).withColumn(name, F.monotonically_increasing_id())), name


def in_place(docs: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` and (file_, at_), which name a row of ``docs`` by its file and its place in it; a frame that is no table of files is written once."""
    named = [c.alias(k) for k, c in columns.items()]
    if docs.inputFiles() and "_metadata" not in docs.columns:
        try:
            return docs.select(*named, F.xxhash64("_metadata.file_path").alias("file_"), F.col("_metadata.row_index").alias("at_"))
        except AnalysisException:
            pass  # rows of a join or an aggregate have no place in a file
    return materialise(docs.select(*named, F.lit(0).cast("long").alias("file_"), F.monotonically_increasing_id().alias("at_")))


def one_array(slots: DataFrame, size: int) -> Column:
    """An array of ``size`` longs, a power of two: place ``slot`` has the union of the bits ``v`` of the rows of ``slots`` (slot int, v long), or 0.

    It is a scalar subquery of a written table, so that neither plans nor Python hold the numbers; the last task reads rows of about the root of ``size`` numbers.
    """
    half = (size.bit_length() - 1) // 2
    every = slots.unionByName(slots.sparkSession.range(size).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("v")))
    parts = every.groupBy("slot").agg(F.bit_or("v").alias("v")).groupBy(F.shiftright("slot", half).alias("part")).agg(F.sort_array(F.collect_list(F.struct("slot", "v")))["v"].alias("vs"))
    return materialise(parts.agg(F.flatten(F.sort_array(F.collect_list(F.struct("part", "vs")))["vs"]).alias("vs"))).scalar()


def maybe_in(keys: DataFrame, columns: list[str], size: int) -> Column:
    """Whether ``columns`` may be a row of ``keys``, of which there are ``size``: a bitmap of sixteen bits a row and 2**25 bits at most, which passes more the fuller it is."""
    bits = min(25, max(16, (16 * size).bit_length()))
    h = F.xxhash64(*columns).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    one = F.lit(1).cast("long")
    slots = keys.select(h.alias("h")).select(F.shiftright("h", 6).cast("int").alias("slot"), F.call_function("shiftleft", one, F.col("h").bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("v"))
    word = F.get(one_array(slots, 1 << (bits - 6)), F.shiftright(h, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, h.bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(one) == 1


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or with as many ``_`` behind it as make it none of ``taken``; names differ by more than case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A configuration value for the jobs that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs that run inside; whole texts make large rows."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batch: pa.RecordBatch, text: int, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes in the string column number ``text``, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:], dtype=np.int64), limit, side="right")))
        yield batch.slice(at, n)
        at += n


def ordered_shards(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Deal ``rows`` to shards of ascending ranges of the integer column ``key``.

    Adds ``shard`` and ``lookahead``.  Each shard also gets a copy of the first row of the next
    shard that has rows (the last one: of the first), marked ``lookahead``, so that a pass over the
    sorted shard sees the successor of every row.  Only one bound a shard goes to the driver.
    Null keys come first, in shard 0; rows of equal keys share a shard.
    """
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    probs = [i / n for i in range(1, n)] or [0.5]
    got = rows.agg(F.percentile_approx(key, [float(p) for p in probs], F.lit(max(10_000, 20 * n)))).first()[0]
    bounds = np.array(sorted({int(x) for x in got or []}), dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def shard_of(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        out = np.zeros(len(keys), dtype=np.int32)
        out[known] = np.searchsorted(bounds, keys[known].to_numpy().astype(np.int64), side="right")
        return pd.Series(out)

    heads = rows.select(key, shard_of(key).alias("shard")).groupBy("shard").agg(F.min(key).alias("first"), F.max(F.col(key).isNull()).alias("nulls")).orderBy("shard").collect()
    firsts = [(r["shard"], None if r["nulls"] else r["first"]) for r in heads]
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}
    # At most one entry a shard: the first key of each shard and the shard that looks ahead to it.
    ahead = spark.createDataFrame([(k, s) for k, s in before.items()] or [(None, None)], f"first {rows.schema[key].dataType.simpleString()}, prior int").filter("prior is not null")
    dealt = rows.withColumn("shard", shard_of(key)).withColumn("lookahead", F.lit(False))
    copies = rows.join(F.broadcast(ahead), F.col(key).eqNullSafe(F.col("first")), "inner").drop("first").withColumn("lookahead", F.lit(True)).withColumnRenamed("prior", "shard")
    return dealt.unionByName(copies), n
