"""Token ids in files: fixed-width bit packing with block offsets.

Documents go in ascending doc_id order to shards, a table partition each.  A shard's stream of ids is
cut into blocks of whole documents; a block is one binary value: every id takes ``bits`` bits (the
fewest that hold the vocabulary's largest id), least significant bit first.  Beside it stand the
block's first id position in the shard, its least and largest doc_id, the doc_ids and the start of each
document in the block: a document is found by the two bounds, which Parquet's statistics prune by, and
unpacked without its neighbours.

Ranges of (doc_id, hash of the text, row) bound the shards, so a hot doc_id is dealt as well.

Defined cases: null text is empty and has the end id only; rows with null doc_id come first; rows that
repeat a doc_id follow one another in the order of the hashes of their texts; long texts fill a block of
their own; doc_id may have any type that sorts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.llm.common import scratch_dir, shuffle_partitions, slices
from flowquarry.llm.textids import WordEncoder, of_worker

#: A block is closed once it has this many ids.
BLOCK_IDS = 1 << 16


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, one behind the other."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """``n`` ids from position ``start`` on; reads only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n, offset=start * bits // 8).astype("<u4")
    first, last = start * bits // 8, -(-(start + n) * bits // 8)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=last - first, offset=first), bitorder="little")
    planes = flat[start * bits - 8 * first :][: n * bits].reshape(n, bits).astype(np.uint32)
    return (planes << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, path: str, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all rows, each followed by ``end_id``, as packed blocks under ``path``."""
    id_ = docs.schema["doc_id"].dataType
    fields = [("shard", T.IntegerType()), ("block", T.IntegerType()), ("first", T.LongType()), ("bits", T.IntegerType()), ("least", id_), ("most", id_)]
    fields += [("doc_ids", T.ArrayType(id_)), ("starts", T.ArrayType(T.IntegerType())), ("n_ids", T.IntegerType()), ("data", T.BinaryType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = of_worker(WordEncoder, tokenizer)
        bits, shard = width_of(max(coder.size, end_id + 1)), TaskContext.get().partitionId()
        at, block, first, ids, names = 0, 0, 0, [], []

        def close(id_type: pa.DataType) -> pa.RecordBatch:
            starts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            known = [n for n in names if n is not None]
            values = [[shard], [block], [first], [bits], [min(known, default=None)], [max(known, default=None)], [names], [starts[:-1].tolist()], [int(starts[-1])], [pack(np.concatenate(ids), bits)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), id_type, id_type, pa.list_(id_type), pa.list_(pa.int32()), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=schema.names)

        kind = pa.null()
        for whole in batches:
            kind = whole.schema.field(0).type
            for b in slices(whole, 1):
                for doc, x in zip(b.column(0).to_pylist(), coder.encode([t.as_py() or "" for t in b.column(1)]), strict=True):
                    if ids and at - first >= block_ids:
                        yield close(kind)
                        block, first, ids, names = block + 1, at, [], []
                    ids.append(np.append(x, np.uint32(end_id)))
                    names.append(doc)
                    at += len(ids[-1])
        if ids:
            yield close(kind)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hash_", F.xxhash64("text")).withColumn("row_", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), "hash_", "row_"]
    # A partition's number is its shard, as ranges ascend with it.
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(run, schema).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in files that ``write_ids`` wrote."""
    files = spark.read.parquet(path)
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row a shard
    offsets = dict(zip([r["shard"] for r in sizes], np.concatenate(([0], np.cumsum([r["n"] for r in sizes], dtype=np.int64))).tolist(), strict=False))
    item = files.schema["doc_ids"].dataType.elementType
    fields = [T.StructField("doc_id", item), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                shard, first, bits, doc_ids, starts, n, data = (b.column(c)[r].as_py() for c in ("shard", "first", "bits", "doc_ids", "starts", "n_ids", "data"))
                ids = unpack(data, bits, 0, n)
                stops = [*starts[1:], n]
                out = [b.column("doc_ids")[r].values, pa.array([offsets[shard] + first + s for s in starts], pa.int64()), pa.array([e - s for s, e in zip(starts, stops, strict=True)], pa.int64()), pa.array([zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, stops, strict=True)], pa.int64())]
                if with_ids:
                    out.append(pa.array([ids[s:e].astype(np.int32) for s, e in zip(starts, stops, strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return files.select("shard", "first", "bits", "doc_ids", "starts", "n_ids", "data").mapInArrow(run, T.StructType(fields))


def document_ids(spark: SparkSession, path: str, doc_id: int | str) -> list[np.ndarray]:
    """Random access: ids of the rows of one document, from the blocks whose bounds allow it alone."""
    near = spark.read.parquet(path).filter((F.col("least") <= F.lit(doc_id)) & (F.col("most") >= F.lit(doc_id)))
    found = near.filter(F.array_contains("doc_ids", F.lit(doc_id))).select("shard", "block", "doc_ids", "starts", "n_ids", "bits", "data").orderBy("shard", "block").collect()
    return [unpack(bytes(r["data"]), r["bits"], s, e - s) for r in found for d, s, e in zip(r["doc_ids"], r["starts"], [*r["starts"][1:], r["n_ids"]], strict=True) if d == doc_id]


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write to the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write_ids(docs, tokenizer, end_id, path)
    return read_ids(spark, path)
