"""Centroid clustering of vectors with Hamerly's bounds, in exact integers.

Every round is one pass over a written table of vectors with their state: the cluster, an upper bound of the
distance to its centroid and a lower bound of the distance to every other one.  When centroids move, the upper
bound grows by the drift of the own centroid and the lower bound shrinks by the largest drift of another one.  A
vector whose upper bound stays under its lower bound, or under half the way from its centroid to the next one,
keeps its cluster unseen; then the upper bound is made exact and asked once more; what is still ambiguous gets a
full scan of all centroids in integers.  The bounds carry a margin beyond the rounding of doubles and must hold
strictly, so a tie always goes to the scan, which gives it to the smaller centroid.

A pass sums the vectors by cluster within its tasks; the driver gets the sums of ``k`` clusters and sends ``k``
centroids, whatever the number of vectors.

Defined cases: vectors that are null, have another number of components, or a null or non-finite one, take no part
and are not in the result; with fewer vectors than ``k`` each is a starting centroid; repeated rows and repeated
ids are vectors of their own; a null id starts no centroid unless others run out and stays null in the result;
scaled components beyond 2**27 are taken as 2**27, so that squared distances fit 64 bits; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.llm.common import discard, materialise

MOST = 1 << 27
#: Margin of the bounds, far beyond the rounding of a few operations on doubles.
SLACK = 1e-9


def scaled(values: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    return np.clip(np.floor(values.astype(np.float64) * scale), -MOST, MOST).astype(np.int64)


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that have exactly ``dims`` finite components, and their places."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(whole)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = np.isfinite(flat).all(axis=1)
    return flat[good], whole[good]


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows ``x`` to integer rows ``c``."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:  # every product and sum is a whole number that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)


@dataclass
class Move:
    """Centroids of a round, how far each came, and half the way from each to its nearest other one."""

    centroids: np.ndarray
    drift: np.ndarray
    half: np.ndarray

    @staticmethod
    def to(new: np.ndarray, old: np.ndarray | None) -> Move:
        gaps = np.sqrt(squared_distances(new, new).astype(np.float64))
        np.fill_diagonal(gaps, np.inf)
        drift = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)) if old is not None else np.zeros(len(new))
        return Move(new, drift, gaps.min(axis=1, initial=np.inf) / 2)

    def other_drift(self) -> np.ndarray:
        """For each centroid the largest drift among the others."""
        order = np.sort(self.drift)[::-1]
        first = order[0] if len(order) else 0.0
        second = order[1] if len(order) > 1 else 0.0
        return np.where((self.drift == first) & ((self.drift == first).sum() == 1), second, first)


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds under the moved centroids, and how many vectors were scanned.  Cluster -1: not yet assigned."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    new = cluster < 0
    own = np.where(new, 0, cluster)
    upper = np.where(new, np.inf, (upper + move.drift[own]) * (1 + SLACK) + SLACK)
    lower = np.where(new, -np.inf, (lower - move.other_drift()[own]) * (1 - np.sign(lower - move.other_drift()[own]) * SLACK) - SLACK)
    safe = np.maximum(lower, move.half[own] * (1 - SLACK) - SLACK)
    open_ = np.flatnonzero((upper >= safe) | new)
    known = open_[~new[open_]]
    exact = np.sqrt(((x[known] - move.centroids[cluster[known]]).astype(np.float64) ** 2).sum(axis=1))
    upper[known] = exact * (1 + SLACK) + SLACK
    open_ = np.flatnonzero((upper >= safe) | new)
    if len(open_):
        d = squared_distances(x[open_], move.centroids)
        cluster[open_] = d.argmin(axis=1)  # the first of equals
        near = np.partition(d, 1, axis=1)[:, :2] if d.shape[1] > 1 else np.concatenate([d, np.full_like(d, MOST**2)], axis=1)
        upper[open_] = np.sqrt(near[:, 0].astype(np.float64)) * (1 + SLACK) + SLACK
        lower[open_] = np.sqrt(near[:, 1].astype(np.float64)) * (1 - SLACK) - SLACK
    return cluster, upper, lower, len(open_)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _lists(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32).ravel()))


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that takes part.

    The first centroids are the vectors whose ids have the smallest SHA-256 of ``seed:id``, in the order of the hashes
    and, for one id, of the components.
    """
    spark = vectors.sparkSession
    kind = T.StructField("vec_id", vectors.schema[id_column].dataType)
    plain = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector_column}`").alias("v"))
    state = T.StructType([kind, T.StructField("q", T.ArrayType(T.IntegerType())), *[T.StructField(n, t) for n, t in (("cluster", T.IntegerType()), ("upper", T.DoubleType()), ("lower", T.DoubleType()))]])
    names = state.names

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = matrix(b.column(1), dims)
            n = len(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), _lists(scaled(flat, scale)), pa.array(np.full(n, -1, np.int32)), pa.array(np.full(n, np.inf)), pa.array(np.full(n, -np.inf))], names=names)

    now = materialise(plain.mapInArrow(start, state))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    firsts = now.select(order.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()  # at most k rows
    if not firsts:
        return spark.createDataFrame([], T.StructType([kind])).selectExpr("vec_id", "0 cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256").limit(0)
    move = Move.to(np.array([r["q"] for r in firsts], dtype=np.int64), None)

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(move)

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _vectors(b.column(1), dims)
                got, upper, lower, _ = assign(x, *[b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)], sent.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got.astype(np.int32)), pa.array(upper), pa.array(lower)], names=names)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for b in batches:
                x, c = _vectors(b.column(1), dims), b.column(0).to_numpy(zero_copy_only=False)
                for j in np.unique(c).tolist():
                    mine = x[c == j]
                    had = total.setdefault(j, [0, np.zeros(dims, dtype=object)])
                    had[0] += len(mine)
                    had[1] = had[1] + mine.sum(axis=0).astype(object)  # whole numbers of any size
            rows = [(j, i, n if i < 0 else int(s[i])) for j, (n, s) in total.items() for i in range(-1, dims)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.decimal128(38, 0))], names=["cluster", "at", "total"])

        after = materialise(now.mapInArrow(step, state))
        discard(now)
        now = after
        new = move.centroids.copy()
        # k * (dims + 1) numbers
        got = {(r["cluster"], r["at"]): int(r["total"]) for r in now.select("cluster", "q").mapInArrow(sums, "cluster int, at int, total decimal(38,0)").groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect()}
        for (j, i), n in got.items():
            if i >= 0:
                new[j, i] = n // got[j, -1]
        move = Move.to(new, move.centroids)

    sent = spark.sparkContext.broadcast(move)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column(1), dims)
            got = assign(x, *[b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)], sent.value)[0]
            far = ((x - sent.value.centroids[got]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    found = materialise(now.mapInArrow(last, T.StructType([kind, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])))
    discard(now)
    totals = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    sha = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in move.centroids.tolist()]
    table = spark.createDataFrame([(j, s, sum(totals.values()), sha[j]) for j, s in totals.items()] or [(0, 0, 0, "")], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
