"""Hard-negative mining by one-dimensional distance keys.

Inner products become distances when every vector gets one more component, the root of (largest squared length -
its own), and every anchor a zero: the highest score is then the nearest vector.  Rows are keyed by their nearest
pivot and their distance to it, and stored sorted by that key in blocks of consecutive keys.  By the triangle
inequality a row whose key is (pivot, r) is at least |d(anchor, pivot) - r| away from an anchor, so an anchor needs
the blocks whose key interval meets an annulus about the pivot alone.  Annuli grow from scan to scan: the first
scan opens the blocks of the least bounds, and the distance of the k-th best row found sets the next radius; an
anchor is done when no block that it has not opened lies within that radius.  With fewer than k rows found the radius
doubles, at last to all blocks.  So the results are exact; the bound of a block decides only the cost.

A negative of a positive lies in a band of scores, whose upper end is the inner circle from which its annuli grow.
The anchors are taken in blocks of ``ANCHORS``; the index is read once a scan for a block of anchors, with nothing of
it broadcast or shuffled but the best rows of each task.

Pivots come from a bounded sample of ``SAMPLE`` rows; they decide only the cost.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; vectors of
different lengths count missing components as zeros; repeated rows and repeated ids are rows of their own, so a
copy of an anchor is another row; equal scores go by id (null last), and rows of equal score and id cannot be told
apart in the result; scaled components beyond 2**27 are taken as 2**27, so that scores fit 64 bits; an anchor without a row of its label, or without
a row in the band, gives no row; a table without anchors, or an empty one, gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import discard, materialise, scratch_dir, shuffle_partitions
from flowquarry.llm.hamerly import scaled

#: Rows of the sample that gives the pivots, and how many pivots.
SAMPLE, PIVOTS = 8192, 64
#: Most rows of a block of the index.
BLOCK = 2048
#: Anchors that are searched at once.
ANCHORS = 4096
#: Slack of a distance bound, relative to the longest vector.
SLACK = 1e-6


def _padded(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column without null or non-finite components, filled with zeros to ``dims``, and their places."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths >= 0)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths = lengths[at]
    bad = np.zeros(len(at), dtype=bool)
    bad[np.repeat(np.arange(len(at)), lengths)[~np.isfinite(flat)]] = True
    out = np.zeros((len(at), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = np.where(np.isfinite(flat), flat, 0.0)
    return out[~bad], at[~bad]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


@dataclass
class Pivots:
    """Pivots in the space with the added component, and the largest squared length of any row."""

    points: np.ndarray
    longest: float

    def added(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.longest - (x * x).sum(axis=1)))[:, None]], axis=1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of rows that have the added component to all pivots."""
        p = self.points
        return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * (x @ p.T) + (p * p).sum(axis=1)[None, :]))

    def anchors(self, x: np.ndarray) -> np.ndarray:
        return self.distances(np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], axis=1))


def pivots_of(sample: np.ndarray, longest: float, k: int = PIVOTS, rounds: int = 8) -> Pivots:
    """Centres of a few rounds of k-means over distinct rows of the sample, begun far apart."""
    out = Pivots(np.zeros((1, sample.shape[1] + 1)), longest)
    rows = out.added(np.unique(sample, axis=0))
    if not len(rows):
        return out
    # Each start is the row farthest from the starts before it.
    starts, away = [0], np.full(len(rows), np.inf)
    while len(starts) < min(k, len(rows)):
        away = np.minimum(away, ((rows - rows[starts[-1]]) ** 2).sum(axis=1))
        starts.append(int(away.argmax()))
    out.points = rows[starts]
    for _ in range(rounds):
        near = out.distances(rows).argmin(axis=1)
        out.points = np.stack([rows[near == j].mean(axis=0) if (near == j).any() else p for j, p in enumerate(out.points)])
    return out


INDEX = "pivot int, low double, high double, n int, rows array<long>, ids array<long>, labels array<long>, q array<int>"


def build_index(rows: DataFrame, pivots: Pivots, dims: int, block: int = BLOCK) -> DataFrame:
    """Blocks of consecutive keys of ``rows`` (row_, id, label, q), sorted by (pivot, distance), as a written table."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = sent.value.distances(sent.value.added(_matrix(b.column(3), dims)))
            near = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=[*b.schema.names, "pivot", "r"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, r = (b.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(pivot)) + 1, np.arange(0, len(pivot), block), [len(pivot)]]))
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = b.slice(a, z - a)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (part.column(0), part.column(1), part.column(2), part.column(3).flatten())]
                yield pa.RecordBatch.from_arrays([pa.array([pivot[a]], pa.int32()), pa.array([r[a]]), pa.array([r[z - 1]]), pa.array([z - a], pa.int32()), *lists], names=["pivot", "low", "high", "n", "rows", "ids", "labels", "q"])

    keyed = materialise(rows.mapInArrow(key, "row_ long, id long, label long, q array<int>, pivot int, r double"))
    dealt = keyed.repartitionByRange(shuffle_partitions(rows.sparkSession), "pivot", "r", "row_").sortWithinPartitions("pivot", "r")
    out = materialise(dealt.mapInArrow(blocks, INDEX))
    discard(keyed)
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


@dataclass
class Search:
    """Searches of one scan: from which circle their annuli grow, how far, and which rows count.

    Search ``i`` belongs to anchor ``anchor[i]`` and takes the ``k`` highest scores from ``least[i]`` to ``most[i]`` of
    rows with the anchor's label (``same``) or without it.  It opens the blocks whose bound is above ``had[i]`` and
    at most ``radius[i]``.  ``q``, ``row``, ``label`` and ``to_pivot`` are the anchors'.
    """

    q: np.ndarray
    row: np.ndarray
    label: np.ndarray
    to_pivot: np.ndarray
    longest: float
    k: int
    same: bool
    number: np.ndarray
    anchor: np.ndarray
    least: np.ndarray
    most: np.ndarray
    had: np.ndarray
    radius: np.ndarray

    def slack(self) -> float:
        return SLACK * (1 + math.sqrt(self.longest))

    def far(self, score: np.ndarray) -> np.ndarray:
        """Distances of rows with these scores."""
        lengths = (self.q.astype(np.float64) ** 2).sum(axis=1)
        return np.sqrt(np.maximum(0.0, self.longest + lengths[self.anchor] - 2.0 * score.astype(np.float64)))

    def bounds(self, pivot: int, low: float, high: float, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """How far beyond the inner circle each search must reach to meet the block; infinite if no row of it is in the band."""
        d = self.to_pivot[self.anchor, pivot]
        near, wide = np.maximum(0.0, np.maximum(d - high, low - d)) - self.slack(), d + high + self.slack()
        return np.where((near > outer + self.slack()) | (wide < inner), np.inf, np.maximum(0.0, near - inner))

    def only(self, which: np.ndarray) -> Search:
        return replace(self, **{c: getattr(self, c)[which] for c in ("number", "anchor", "least", "most", "had", "radius")})


def _best(score: np.ndarray, id_: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best."""
    return np.lexsort((id_, ~known, -score))[:k]


def scan(index: DataFrame, search: Search, dims: int) -> DataFrame:
    """(search, score, id): the best rows that each task finds in the blocks that the searches open, at most ``k`` a search."""
    sent = index.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Search = sent.value
        inner, outer = s.far(s.most), s.far(s.least)
        kept: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for i in range(b.num_rows):
                bound = s.bounds(b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py(), inner, outer)
                open_ = np.flatnonzero((bound > s.had) & (bound <= s.radius))
                if not len(open_):
                    continue
                rows, ids, labels, flat = (b.column(c)[i].values for c in (4, 5, 6, 7))
                x = flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
                rows, labels = rows.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                needed, place = np.unique(s.anchor[open_], return_inverse=True)
                scores = products(s.q[needed], x)
                fits = (labels[None, :] == s.label[needed][:, None]) == s.same
                fits &= rows[None, :] != s.row[needed][:, None]
                for j, p in zip(open_.tolist(), place.tolist(), strict=True):
                    at = np.flatnonzero(fits[p] & (scores[p] >= s.least[j]) & (scores[p] <= s.most[j]))
                    if not len(at):
                        continue
                    mine = [scores[p][at], ids[at], known[at]]
                    if j in kept:
                        mine = [np.concatenate(pair) for pair in zip(kept[j], mine, strict=True)]
                    top = _best(*mine, s.k)
                    kept[j] = [m[top] for m in mine]
        if kept:
            score, id_, known = (np.concatenate(c) for c in zip(*kept.values(), strict=True))
            number = np.repeat(s.number[np.fromiter(kept, np.int64)], [len(m[0]) for m in kept.values()])
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(score), pa.array(id_, mask=~known)], names=["search", "score", "id"])

    return index.mapInArrow(run, "search long, score long, id long")


def certified(index: DataFrame, search: Search, directory: list[tuple[int, float, float]], dims: int) -> DataFrame:
    """(search, score, id, rank) of every search, exact, as a written table.

    ``directory``: some key intervals (pivot, low, high) that cover all keys; the first radius comes from them.
    """
    n = len(search.anchor)
    inner, outer = search.far(search.most), search.far(search.least)
    ordered = np.sort(np.stack([search.bounds(*c, inner, outer) for c in directory], axis=1), axis=1)
    # The first scan opens the keys of the least bounds; none lies beyond the last radius.
    search.had, search.radius = np.full(n, -1.0), np.nan_to_num(ordered[:, min(ordered.shape[1] - 1, max(1, ordered.shape[1] // 16))], posinf=0.0)
    last = np.minimum(np.maximum(search.to_pivot.max(axis=1)[search.anchor], max(c[2] for c in directory)), np.maximum(0.0, outer - inner)) + 4 * search.slack()
    left, found = np.arange(n), None
    order = [F.col("score").desc(), F.asc_nulls_last("id")]
    while len(left):
        new = scan(index, search.only(left), dims)
        both = new if found is None else found.drop("rank").unionByName(new)
        best = materialise(both.withColumn("rank", F.row_number().over(Window.partitionBy("search").orderBy(*order))).filter(F.col("rank") <= search.k))
        if found is not None:
            discard(found)
        found = best
        # A row for each search of this block of anchors.
        state = {r["search"]: (r["n"], r["s"]) for r in found.groupBy("search").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).collect()}
        full = np.array([state.get(i, (0, 0))[0] >= search.k for i in left.tolist()])
        kth = np.array([state.get(i, (0, 0))[1] for i in left.tolist()], dtype=np.int64)
        reached = np.maximum(0.0, replace(search, anchor=search.anchor[left]).far(kth) - inner[left]) + search.slack()
        search.had[left] = search.radius[left]
        need = np.where(full, np.minimum(reached, last[left]), np.minimum(last[left], 2 * search.radius[left] + last[left] / 4))
        done = np.where(full, need <= search.had[left], search.had[left] >= last[left])
        search.radius[left] = np.maximum(need, search.had[left])
        left = left[~done]
    return found


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, band: tuple[int, int, int] = (30, 90, 100), scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", pivots: int = PIVOTS, block: int = BLOCK, anchors_at_once: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    ``band``: (a, b, c) takes the negatives with a * positive score <= c * negative score <= b * positive score.
    """
    spark = rows.sparkSession
    anchor_ = is_anchor
    plain = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("long").alias("label"), F.col(f"`{vector_column}`").alias("v"), F.coalesce(anchor_, F.lit(False)).alias("anchor"))
    plain = plain.filter(F.col("label").isNotNull() & F.col("v").isNotNull())
    dims = max(1, plain.agg(F.max(F.size("v"))).first()[0] or 1)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = _padded(b.column(2), dims)
            x, at = scaled(x, scale), pa.array(at)
            q = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32)), pa.array(x.astype(np.int32).ravel()))
            longest = (x.astype(np.float64) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(3).take(at), q, pa.array(longest)], names=["id", "label", "anchor", "q", "length"])

    named = materialise(plain.mapInArrow(quantise, "id long, label long, anchor boolean, q array<int>, length double").withColumn("row_", F.monotonically_increasing_id()))
    count, longest, n_anchors = named.agg(F.count(F.lit(1)), F.max("length"), F.count_if("anchor")).first()
    share = min(1.0, 2 * SAMPLE / max(1, count))
    sample = named.filter(F.pmod(F.xxhash64("row_"), F.lit(1 << 20)) < share * (1 << 20)).select("q").limit(SAMPLE).toArrow()
    places = pivots_of(_matrix(sample.column(0).combine_chunks(), dims) if sample.num_rows else np.zeros((0, dims), np.int64), longest or 0.0, pivots)
    index = build_index(named.select("row_", "id", "label", "q"), places, dims, block)
    # The extent of the keys of each pivot, cut in 16: at most 16 * PIVOTS intervals, whatever the number of blocks.
    extent = index.groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    directory = [(r["pivot"], a, z) for r in extent for steps in [np.linspace(r["low"], r["high"], 17).tolist()] for a, z in zip(steps, steps[1:], strict=False)]

    out = f"{scratch_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    groups = math.ceil(n_anchors / anchors_at_once)
    for g in range(groups):
        # The driver holds one block of anchors, about ``anchors_at_once`` vectors, and their best rows.
        got = named.filter(F.col("anchor") & (F.pmod(F.xxhash64("row_"), F.lit(groups)) == g)).select("row_", "id", "label", "q").toArrow().combine_chunks()
        n = got.num_rows
        if not n:
            continue
        q, ids = _matrix(got["q"].combine_chunks(), dims), got["id"].to_pylist()
        lengths = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        top = (lengths.astype(np.int64) + 1) * (math.isqrt(int(longest)) + 2)  # beyond every score
        first = Search(q, got["row_"].to_numpy(), got["label"].to_numpy(), places.anchors(q), float(longest), positives, True, np.arange(n), np.arange(n), -top, top, np.zeros(0), np.zeros(0))
        best = certified(index, first, directory, dims)
        found = best.select("search", "score", "id").toArrow()
        discard(best)
        anchor, scores, names = found["search"].to_numpy(), found["score"].to_pylist(), found["id"].to_pylist()
        low, high, whole = band
        least, most = (np.array(x, dtype=np.int64) for x in ([-(-low * s // whole) for s in scores], [high * s // whole for s in scores]))
        some = np.flatnonzero(least <= most)
        if not len(some):
            continue
        second = replace(first, k=negatives, same=False, number=np.arange(len(some)), anchor=anchor[some], least=least[some], most=most[some])
        best = certified(index, second, directory, dims)
        told = [(i, ids[anchor[j]], names[j], scores[j]) for i, j in enumerate(some.tolist())]
        told = spark.createDataFrame(told, "search long, anchor_id long, positive_id long, positive_score long")
        best.join(F.broadcast(told), "search").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        discard(best)
    discard(named)
    discard(index)
    return spark.read.schema(schema).parquet(out)
