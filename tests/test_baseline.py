"""Baselines against plain folds, one capture after another."""

from __future__ import annotations

import math
import random

import pytest

from flowquarry.operators import baseline

DAY = 86_400


def made(spark, seed=1, days=30, hosts=4):
    """Volumes with a weekly rhythm and traits that come and go, as rows of snapshots."""
    rng = random.Random(seed)
    volumes, traits = [], []
    for d in range(days):
        for h in range(hosts):
            if h == 3 and d % 9:
                continue  # met in too few captures
            base = 1000 * (1 + d % 7) * (h + 1) + rng.randrange(50)
            out = base * 40 if d == days - 1 and h == 1 else base
            volumes.append((d, d * DAY + 5, f"10.0.0.{h}", out, out // 3, 7 + d % 7 + rng.randrange(2)))
            for dim, value in [("peer", f"8.8.{rng.randrange(4)}.1"), ("port", str(rng.choice((443, 80)))), ("hour", str(rng.choice((8, 9, 10, 11)))), ("category", "web"), ("ja3", "j1")]:
                traits.append((d, d * DAY + 5, f"10.0.0.{h}", dim, value, 3 if dim in ("hour", "category") else 1, None, None))
            if d == days - 1:
                traits += [(d, d * DAY + 5, f"10.0.0.{h}", *t) for t in (("peer", "9.9.9.9", 1, None, None), ("port", "4444", 1, None, None), ("port", "90", 1, None, None), ("hour", "3", 2, None, None), ("beacon", "9.9.9.9:4444", 1, 60_000_000_000, 0.05))]
    v = spark.createDataFrame(volumes, "capture long, unix long, host string, bytes_out long, bytes_in long, flows long")
    t = spark.createDataFrame(traits, "capture long, unix long, host string, dim string, value string, total long, interval_ns long, cv double")
    return baseline.Snapshot(v, t), volumes, traits


def fold(volumes):
    """(host, metric): count, mean, sum of squared deviations, average that moves, last 24 values, and samples by phase."""
    out = {}
    for d, unix, host, *xs in sorted(volumes):
        for metric, x in zip(baseline.METRICS, xs, strict=True):
            s = out.setdefault((host, metric), {"n": 0, "mean": 0.0, "m2": 0.0, "ewma": None, "recent": [], "phases": {}})
            s["n"] += 1
            delta = x - s["mean"]
            s["mean"] += delta / s["n"]
            s["m2"] += delta * (x - s["mean"])
            s["ewma"] = float(x) if s["ewma"] is None else 0.3 * x + 0.7 * s["ewma"]
            s["recent"] = [*s["recent"], (unix, float(x))][-24:]
            s["phases"].setdefault(unix // DAY % 7, []).append(float(x))
    return out


def holt(ys):
    if len(ys) < 3:
        return None
    level, trend, var = ys[0], ys[1] - ys[0], 0.0
    for y in ys[1:]:
        f = level + trend
        before, level = level, 0.4 * y + 0.6 * f
        trend = 0.2 * (level - before) + 0.8 * trend
        var = 0.3 * (y - f) ** 2 + 0.7 * var
    return max(0.0, level + trend), max(math.sqrt(var), 1.0, 0.15 * sum(ys) / len(ys))


def expectation(s, unix):
    means = {p: sum(x) / len(x) for p, x in s["phases"].items() if len(x) >= 2}
    p = unix // DAY % 7
    if len(means) >= 3 and p in means:
        every = sum(means.values()) / len(means)
        got = holt([y - (means[t // DAY % 7] - every if t // DAY % 7 in means else 0) for t, y in s["recent"]])
        return "seasonal", max(0.0, got[0] + means[p] - every), got[1]
    got = holt([y for _, y in s["recent"]]) if len(s["recent"]) >= 4 else None
    return ("trend", *got) if got else ("static", None, None)


def stats_of(profile):
    return {(r["host"], r["metric"]): r for r in profile.stats.collect()}


@pytest.fixture(scope="module")
def history(spark):
    snap, volumes, traits = made(spark)
    return baseline.Snapshot(snap.volumes.cache(), snap.traits.cache()), volumes, traits


def test_one_fold_after_another_and_any_split(history):
    snap, volumes, _ = history
    want = fold(volumes)
    whole = baseline.build(snap)
    parts = [snap.filter(f"capture between {a} and {b}") for a, b in ((0, 3), (4, 4), (5, 22), (23, 40))]
    updated = baseline.build(parts[0])
    for p in parts[1:]:
        updated = baseline.merge(updated, baseline.build(p), later=True)
    halves = baseline.merge(baseline.build(snap.filter("capture % 2 = 1")), baseline.build(snap.filter("capture % 2 = 0")))
    for name, got in (("whole", stats_of(whole)), ("updated", stats_of(updated)), ("halves", stats_of(halves))):
        assert set(got) == set(want)
        for k, s in want.items():
            r = got[k]
            assert r["n"] == s["n"] and math.isclose(r["mean"], s["mean"], rel_tol=1e-9) and math.isclose(r["m2"], s["m2"], rel_tol=1e-6, abs_tol=1e-6)
            assert [x["value"] for x in r["recent"]] == [x for _, x in s["recent"]]
            assert name == "halves" or math.isclose(r["ewma"], s["ewma"], rel_tol=1e-9)
    for name in ("phases", "traits"):
        columns = [c for c in getattr(whole, name).columns if c not in ("ewma", "first_value", "interval_ns", "cv")]
        rows = [sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in getattr(p, name).select(*columns).collect()) for p in (whole, updated, halves)]
        assert rows[0] == rows[1] == rows[2]


def test_merge_with_nothing_changes_nothing(history):
    snap, *_ = history
    whole, none = baseline.build(snap), baseline.build(snap.filter("capture < 0"))
    assert none.stats.count() == 0
    for got in (baseline.merge(whole, none), baseline.merge(none, whole, later=True)):
        assert sorted(map(str, got.stats.select(*sorted(whole.stats.columns)).collect())) == sorted(map(str, whole.stats.select(*sorted(whole.stats.columns)).collect()))


def test_expectations_against_loops(history):
    snap, volumes, _ = history
    past = [v for v in volumes if v[0] < 29]
    got = baseline.expected(baseline.build(snap.filter("capture < 29")), snap.filter("capture = 29").volumes.selectExpr("capture", "unix", "host", "explode(array('bytes_out', 'bytes_in', 'flows')) as metric")).collect()
    assert len(got) == 9 and {r["model"] for r in got} == {"seasonal"}
    short = baseline.expected(baseline.build(snap.filter("capture < 6")), snap.filter("capture = 6").volumes.selectExpr("capture", "unix", "host", "explode(array('bytes_out', 'bytes_in', 'flows')) as metric")).collect()
    assert {r["model"] for r in short} == {"trend"}
    for rows, folded in ((got, fold(past)), (short, fold([v for v in volumes if v[0] < 6]))):
        for r in rows:
            model, forecast, sigma = expectation(folded[r["host"], r["metric"]], r["unix"])
            assert r["model"] == model and math.isclose(r["forecast"], forecast, rel_tol=1e-9) and math.isclose(r["sigma"], sigma, rel_tol=1e-9)


def test_deviations_in_every_dimension(history):
    snap, *_ = history
    got = {r["src_ip"]: r for r in baseline.deviations(baseline.build(snap.filter("capture < 29")), snap.filter("capture = 29")).collect()}
    assert set(got) == {"10.0.0.0", "10.0.0.1", "10.0.0.2"}
    calm, loud = got["10.0.0.0"], got["10.0.0.1"]
    assert (calm["dst_ip"], calm["dst_port"], calm["score"], calm["severity"]) == ("9.9.9.9", 90, 45, "medium")
    assert [e.split()[1] + " " + e.split()[2] for e in calm["evidence"]] == ["new external", "new destination", "active at", "new periodic"]
    assert "90, 4444" in calm["evidence"][1] and "03:00" in calm["evidence"][2]
    assert len(loud["evidence"]) == 6 and "above the seasonal expectation" in loud["evidence"][2]
    # Five captures are the least to be judged by, and an hour counts only beside a window of three hours.
    few = baseline.deviations(baseline.build(snap.filter("capture between 25 and 28")), snap.filter("capture = 29"))
    assert few.count() == 0
    five = baseline.deviations(baseline.build(snap.filter("capture between 24 and 28")), snap.filter("capture = 29"))
    assert five.count() == 3


def test_caps_keep_what_most_captures_have(history):
    snap, _, traits = history
    p = baseline.capped(baseline.build(snap), {"peer": 2, "port": 1, "ja3": 1, "beacon": 1}, 2)
    counted = {}
    for d, _, host, dim, value, total, *_ in traits:
        e = counted.setdefault((host, dim, value), [0, 0])
        e[0] += 1
        e[1] += total
    got = {(r["host"], r["dim"], r["value"]) for r in p.traits.collect()}
    assert {h for h, _, _ in got} == {"10.0.0.1", "10.0.0.2"} == {r["host"] for r in p.stats.select("host").distinct().collect()}
    for host in ("10.0.0.1", "10.0.0.2"):
        peers = sorted(((-n, -t, v) for (h, dim, v), (n, t) in counted.items() if h == host and dim == "peer"))[:2]
        assert {v for h, dim, v in got if h == host and dim == "peer"} == {v for *_, v in peers}
