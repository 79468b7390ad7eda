"""Token counts without ids: pieces are counted once per distinct pre-token and joined to documents.

1. One pass counts in how many documents each distinct pre-token occurs (combined in every task).
2. Each distinct pre-token is counted in pieces once.
3. A second pass joins the counts to the pre-token frequencies of every document.  Pre-tokens of at
   least ``1 / HOT_SHARE`` of all documents would be hot join keys; their counts go along with the
   tasks instead.  With a mean of m distinct pre-tokens a document there are at most m * HOT_SHARE of
   them however large the corpus is, and no more than ``HOT_LIMIT`` are sent.  The others meet their
   counts by a shuffle join, in which no key has more than that share.

Defined cases: null text is empty and has no tokens; texts are counted whole; special strings inside
texts count as the library's default has them; rows that repeat a doc_id stay rows of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.llm.common import materialise, slices
from flowquarry.llm.textids import ByteLevelCutter, of_worker

HOT_SHARE = 5_000
HOT_LIMIT = 300_000
#: Distinct pre-tokens that a task holds before it hands on what it has counted.
HELD = 150_000


def document_frequencies(docs: DataFrame, path: str) -> DataFrame:
    """(pretoken, df): number of documents that have each pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = of_worker(ByteLevelCutter, path), Counter()
        for whole in batches:
            for b in slices(whole, 0, 2_000_000):
                for t in b.column(0):
                    seen.update(set(cutter.cut(t.as_py() or "")[0]))
                if len(seen) > HELD:
                    yield _counts(seen)
                    seen = Counter()
        yield _counts(seen)

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "pretoken string, df long")
    return found.groupBy("pretoken").agg(F.sum("df").alias("df"))


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["pretoken", "df"])


def piece_counts(frequencies: DataFrame, path: str) -> DataFrame:
    """(pretoken, df, pieces) for distinct pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = of_worker(ByteLevelCutter, path)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cutter.count(b.column(0).to_pylist()), pa.int32())], names=["pretoken", "df", "pieces"])

    return frequencies.select("pretoken", "df").mapInArrow(run, "pretoken string, df long, pieces int")


def token_counts(docs: DataFrame, path: str, limit: int = 1024, hot_share: int = HOT_SHARE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.  ``path``: place of a byte-level .json file on every node."""
    spark = docs.sparkSession
    counts = materialise(piece_counts(document_frequencies(docs, path), path))
    least = max(2, docs.count() // hot_share)
    hot = counts.filter(F.col("df") >= least).orderBy(F.desc("df"), "pretoken").limit(HOT_LIMIT).select("pretoken", "pieces").toArrow()
    sent = spark.sparkContext.broadcast(dict(zip(hot.column(0).to_pylist(), hot.column(1).to_pylist(), strict=True)))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("part", T.LongType()), ("rare", T.ArrayType(T.StringType())), ("times", T.ArrayType(T.IntegerType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known = of_worker(ByteLevelCutter, path), sent.value
        for whole in batches:
            for b in slices(whole, 1, 4_000_000):
                size, part, rare, times = [], [], [], []
                for t in b.column(1):
                    text = t.as_py() or ""
                    pretokens, total = cutter.cut(text)
                    freq = Counter(pretokens)
                    left = {}
                    for w, n in freq.items():
                        if (k := known.get(w)) is not None:
                            total += k * n
                        else:
                            left[w] = n
                    size.append(len(text.encode("utf-8", "surrogatepass")))
                    part.append(total)
                    rare.append(list(left))
                    times.append(list(left.values()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(part, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))], names=schema.names)

    # Each row gets a number, so that rows of one doc_id stay apart; a row of its own keeps its base figures.
    rows = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    base = F.struct(F.concat(F.lit("\x00row "), F.col("row")).alias("pretoken"), F.lit(None).cast("int").alias("n"), F.col("doc_id").alias("id"), F.col("n_bytes").alias("size"), F.col("part").alias("so_far"))
    each = F.transform(F.arrays_zip("rare", "times"), lambda x: F.struct(x["rare"].alias("pretoken"), x["times"].alias("n"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("id"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("so_far")))
    long = rows.select("row", F.inline(F.concat(F.array(base), each)))
    total = long.join(counts.select("pretoken", "pieces"), "pretoken", "left").groupBy("row").agg(F.max("id").alias("doc_id"), F.max("size").alias("n_bytes"), (F.max("so_far") + F.coalesce(F.sum(F.col("n") * F.col("pieces")), F.lit(0))).alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
