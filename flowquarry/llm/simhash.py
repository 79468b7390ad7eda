"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are cut into ``SEGMENTS`` consecutive segments placed on a ring.  If two fingerprints
differ in at most ``d`` bits, some segment starts a chain in which the first ``k`` segments differ in
at most ``k * d / SEGMENTS`` bits for every ``k``.  The first segments of that chain have a budget
below one bit, so they agree and give an equi-join key; the later budgets prune candidates inside the
join condition, before the Hamming distance of all 64 bits is tested.

Only distinct fingerprints are joined: exact copies share one class.  A key that many distinct
fingerprints share is not joined pairwise.  Its fingerprints go by an exact second way: each emits
itself and its 64 one-bit variants, and fingerprints within two bits share a variant.  A variant has
at most 65 fingerprints, so the work is linear in the group.

Defined cases: null or wordless text has fingerprint zero and links like any other; texts of one or
two words use the whole sequence as their only shingle; repeated rows are exact copies; an empty table
gives an empty result; rows with null doc_id keep their fingerprint and take part through it, and
their component is named by the smallest non-null doc_id, null if there is none; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.llm.common import batches_of, materialise
from flowquarry.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
SEGMENTS = 5
#: A join key with more distinct fingerprints than this goes by one-bit variants instead of pairs.
HOT_KEY = 64


def simhash64(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one text as a signed 64-bit integer; shingles are hashed in blocks of bounded size."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined, total = b" ".join(words), len(words) - width + 1
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, total, 65_536):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65_536], stops[at : at + 65_536], strict=False)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long) for every row of ``docs``."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash64(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def _ring(segments: int) -> list[tuple[int, ...]]:
    """Bit masks of the segments, as signed 64-bit integers, in ring order."""
    edges = [round(i * 64 / segments) for i in range(segments + 1)]
    masks = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def pigeonring_links(classes: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, hot_key: int = HOT_KEY) -> DataFrame:
    """(src, dst) links that connect classes within ``max_bits`` of each other.  ``classes``: (rep, fp), fp distinct.

    Every pair of linked classes is joined directly, or through the variant that both share.
    """
    if max_bits >= segments:
        raise ValueError("segments must exceed max_bits")
    if max_bits > 2:
        raise ValueError("the exact way for hot keys covers at most two bits")
    masks = _ring(segments)
    budget = [k * max_bits // segments for k in range(segments + 1)]
    clean = max(k for k in range(1, segments + 1) if budget[k] == 0)

    def union(parts: list[int]) -> int:
        out = 0
        for p in parts:
            out |= p & ((1 << 64) - 1)
        return out - (1 << 64) if out >= 1 << 63 else out

    chains = [[union([masks[(i + j) % segments] for j in range(k)]) for k in range(1, segments + 1)] for i in range(segments)]
    starts = F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(chains[i][clean - 1])).alias("key")) for i in range(segments)])
    keys = classes.select("rep", "fp", F.inline(starts))
    sizes = keys.groupBy("start", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    keyed = keys.join(sizes, ["start", "key"])

    a, b = (keyed.filter(F.col("size") <= hot_key).alias(x) for x in "ab")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    within = F.col("a.fp") < F.col("b.fp")
    for k in range(clean + 1, segments):
        cut = F.coalesce(*[F.when(F.col("a.start") == i, F.lit(chains[i][k - 1])) for i in range(segments)])
        within &= F.bit_count(x.bitwiseAND(cut)) <= budget[k]
    within &= F.bit_count(x) <= max_bits
    pairs = a.join(b, (F.col("a.start") == F.col("b.start")) & (F.col("a.key") == F.col("b.key")) & within).select(F.col("a.rep").alias("src"), F.col("b.rep").alias("dst"))

    hot = keyed.filter(F.col("size") > hot_key).select("rep", "fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)])
    variants = hot.select("rep", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    if max_bits < 2:  # a variant then links only its own fingerprint with the flipped ones
        variants = variants.join(hot.select(F.col("fp").alias("variant")), "variant", "left_semi")
    stars = variants.groupBy("variant").agg(F.min("rep").alias("dst"), F.collect_set("rep").alias("reps")).filter(F.size("reps") > 1)
    linked = stars.select(F.explode("reps").alias("src"), "dst").filter("src <> dst")
    return pairs.unionByName(linked).distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, hot_key: int = HOT_KEY) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    with batches_of(docs.sparkSession, 500):
        fps = materialise(fingerprints(docs))
    named = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).withColumn("rep", F.monotonically_increasing_id()))
    links = materialise(pigeonring_links(named.select("rep", "fp"), max_bits, segments, hot_key))
    groups = connected_components(links)
    # Components are found over class numbers, then named by the smallest doc_id of their classes.
    member = named.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    names = member.filter(F.col("component") != F.col("rep")).select("component").distinct().join(member, "component").groupBy("component").agg(F.min("doc_id").alias("name"))
    labelled = member.join(names, "component", "left").select("fp", F.coalesce("name", "doc_id").alias("component_id"))
    return fps.join(labelled, "fp").select("doc_id", "fp", "component_id")
