"""Hard negatives and centroid clusters against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import hamerly, hardnegatives
from flowquarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, q int, pivot string, row_ int, cluster int, anchor int"


def quantised(vector, dims=None):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector) or dims is not None and len(vector) != dims:
        return None
    return [math.floor(256 * float(x)) for x in vector]


def brute_negatives(rows, positives=5, negatives=10):
    kept = []
    for i, v, g in rows:
        x = quantised(v)
        if x is not None and g is not None:
            kept.append((i, x, (g + 1) % 10 if i is not None and i % 7 == 0 else g))
    out = []
    for at, (i, x, g) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=False)), j is None, j or 0, h) for other, (j, y, h) in enumerate(kept) if other != at))
        for ps, pnull, p, _ in [s for s in scored if s[3] == g][:positives]:
            fits = [s for s in scored if s[3] != g and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:negatives]
            out += [(i, None if pnull else p, r + 1, None if null else n, -ps, -ns) for r, (ns, null, n, _) in enumerate(fits)]
    return sorted(out, key=str)


def brute_clusters(rows, k, rounds, dims=64, seed=2):
    kept = [(i, x) for i, v in rows if (x := quantised(v, dims)) is not None]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [list(x) for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x: min(range(len(centroids)), key=lambda j: (far(x, centroids[j]), j))
    for _ in range(rounds):
        own = [near(x) for _, x in kept]
        for j in range(len(centroids)):
            mine = [x for (_, x), c in zip(kept, own, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = [near(x) for _, x in kept]
    d = [far(x, centroids[c]) for (_, x), c in zip(kept, own, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, e, sum(x for x, y in zip(d, own, strict=True) if y == c), sum(d), sha[c]) for (i, _), c, e in zip(kept, own, d, strict=True)), key=str)


def vectors(seed, n, dims, clashing=True):
    """Groups of near vectors, many copies of one of them, equal ids, and all kinds of unusable rows."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(7)]
    hot = [rng.gauss(0, 0.2) for _ in range(dims)]
    rows = []
    for i in range(n):
        v = list(hot) if i % 3 == 0 else [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]
        rows.append((i if i % 11 else rng.choice((None, 200, 14)), v, rng.choice((None, *range(10))) if i % 5 == 0 else i % 10))
    rows += [(100, None, 1), (300, [], 2), (7, [None] * dims, 1), (8, [float("nan")] * dims, 1), (9, [float("inf")] + [0.1] * (dims - 1), 1), (400, [0.5] * (dims - 1), 3), (None, hot, None), (500, [0.0] * dims, 4)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, 3, 4) for r in rows], VECTORS).repartition(5)


def mined(spark, rows, **options):
    df = frame(spark, rows).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return sorted(map(tuple, hardnegatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect()), key=str)


@pytest.mark.parametrize(("block", "pivots", "at_once"), [(16, 8, 6), (4096, 1, 4096)])
def test_negatives_against_all_rows(spark, block, pivots, at_once):
    rows = vectors(3, 700, 12)
    got = mined(spark, rows, block=block, pivots=pivots, anchors_at_once=at_once)
    assert got == brute_negatives(rows)
    assert len(got) > 100


def test_negatives_without_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [0.1], 2)]) == [] and mined(spark, [(100, [0.1], 2)]) == []


def test_hard_negatives_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op12_hard_negatives"](spark, SF)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str) == brute_negatives(rows)


def test_annuli_leave_blocks_unopened(spark):
    rng = np.random.default_rng(1)
    x = hamerly.scaled(np.repeat(np.eye(8) * 3, 100, axis=0) + rng.normal(0, 0.05, (800, 8)))
    p = hardnegatives.pivots_of(x, float((x**2).sum(axis=1).max()), 8)
    d = p.distances(p.added(x))
    s = hardnegatives.Search(x[:1], np.zeros(1), np.zeros(1), p.anchors(x[:1]), p.longest, 5, True, np.zeros(1, int), np.zeros(1, int), np.array([-(10**9)]), np.array([10**9]), np.zeros(1), np.zeros(1))
    keys = [d[d.argmin(axis=1) == j, j] for j in range(8)]
    bound = [s.bounds(j, r.min(), r.max(), s.far(s.most), s.far(s.least))[0] for j, r in enumerate(keys)]
    fifth = np.sort(hardnegatives.products(x[:1], x)[0])[-5]
    assert sum(b <= s.far(np.array([fifth]))[0] for b in bound) == 1


@pytest.mark.parametrize(("k", "rounds", "n"), [(6, 5, 400), (3, 0, 50), (40, 2, 20)])
def test_clusters_against_full_scans(spark, k, rounds, n):
    rows = vectors(4, n, 64)
    got = hamerly.cluster(frame(spark, rows), k=k, rounds=rounds)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters([r[:2] for r in rows], k, rounds)
    assert hamerly.cluster(frame(spark, rows[:0]), k=k, rounds=rounds).collect() == []


def test_clusters_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES["op13_centroid_clusters"](spark, SF)
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == brute_clusters(rows, 40, 5)


def test_bounds_spare_scans_and_keep_ties():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-200, 200, (300, 6)), np.zeros((50, 6), np.int64)])
    c = np.concatenate([rng.integers(-200, 200, (9, 6)), np.ones((1, 6), np.int64), -np.ones((1, 6), np.int64)])
    cluster, upper, lower, scanned = hamerly.assign(x, np.full(350, -1), np.full(350, np.inf), np.full(350, -np.inf), hamerly.Move.to(c, None))
    assert scanned == 350 and (cluster == hamerly.squared_distances(x, c).argmin(axis=1)).all() and (cluster[300:] == 9).all()
    few = []
    for _ in range(20):
        new = c + rng.integers(-3, 4, c.shape)
        cluster, upper, lower, scanned = hamerly.assign(x, cluster, upper, lower, hamerly.Move.to(new, c))
        c = new
        d = hamerly.squared_distances(x, c)
        assert (cluster == d.argmin(axis=1)).all()
        few.append(scanned)
    assert min(few) < 200


def test_large_components_stay_exact():
    x = np.array([[1 << 27, -(1 << 27)] * 32, [3] * 64])
    c = np.array([[-(1 << 27), 1 << 27] * 32, [2] * 64])
    assert hamerly.squared_distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in c] for r in x]
    assert hamerly.scaled(np.array([1e30, -0.001])).tolist() == [1 << 27, -1]
