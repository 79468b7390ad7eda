"""Forecast folds against a plain loop."""

from __future__ import annotations

import math
import random

from flowquarry.operators import forecast


def plain(ys):
    floor = max(0.15 * sum(ys) / len(ys), 1.0)
    level, trend, var, hi, lo, out = ys[0], ys[1] - ys[0], 0.0, 0.0, 0.0, []
    for t, y in enumerate(ys[1:], 1):
        f, sigma = level + trend, max(math.sqrt(var), floor)
        z, shift = (y - f) / sigma, False
        if t >= 8:
            hi, lo = max(0.0, hi + z - 0.5), max(0.0, lo - z - 0.5)
            shift = hi > 6 or lo > 6
            hi, lo = (0.0, 0.0) if shift else (hi, lo)
        out.append((t, y, round(f, 6), round(sigma, 6), t >= 8 and z >= 4, t >= 8 and z <= -4 and f > floor, shift))
        new = 0.4 * y + 0.6 * f
        trend, level, var = 0.2 * (new - level) + 0.8 * trend, new, 0.3 * (y - f) ** 2 + 0.7 * var
    return out


def test_steps_and_hits(spark):
    rng = random.Random(4)
    shapes = {"flat": [100.0] * 20 + [900.0] + [100.0] * 5, "drop": [1000.0 + rng.random() for _ in range(15)] + [0.0, 1000.0], "level": [50.0] * 12 + [200.0] * 12, "noise": [rng.random() * 300 for _ in range(60)], "short": [1.0, 2.0]}
    rows = [(k, i, y) for k, ys in shapes.items() for i, y in enumerate(ys)]
    rng.shuffle(rows)
    found = forecast.steps(spark.createDataFrame(rows, "key string, bin long, bytes double"), ["key"]).cache()
    for k, ys in shapes.items():
        got = [(r["t"], r["actual"], round(r["forecast"], 6), round(r["sigma"], 6), r["spike"], r["drop"], r["shift"]) for r in found.filter(found.key == k).orderBy("bin").collect()]
        assert got == (plain(ys) if len(ys) > 2 else [])
    kinds = {(r["key"], r["hit"]) for r in forecast.hits(found, ["key"]).collect()}
    assert ("flat", "spike") in kinds and ("drop", "drop") in kinds and ("level", "shift") in kinds
    assert all(r["lower"] <= r["forecast"] <= r["upper"] for r in forecast.band(found, ["key"]).collect())


def test_anomalies_of_series(spark):
    calm, wild, low = [10_000.0] * 30, [10_000.0] * 20 + [900_000.0] + [10_000.0] * 9, [10.0] * 20 + [5_000.0]
    gone = [50_000.0 + i % 3 for i in range(20)] + [0.0, 50_000.0]
    shapes = {
        ("egress", "host", "a", ""): calm, ("egress", "peer", "a", "9.9.9.9"): wild, ("egress", "port", "a", "443"): wild, ("ingress", "host", "a", ""): wild, ("ingress", "peer", "a", "9.9.9.9"): wild,
        ("egress", "host", "b", ""): low, ("egress", "port", "b", "53"): gone, ("egress", "port", "b", "80"): wild,
    }
    rows = [(*k, 100 + i, y) for k, ys in shapes.items() for i, y in enumerate(ys)]
    table = spark.createDataFrame(rows, "direction string, dim string, host string, key string, bin long, bytes double")
    found = forecast.anomalies(forecast.steps(table, forecast.KEYS, least_peak=forecast.LEAST_PEAK), 60).cache()
    want = {}
    for k, ys in shapes.items():
        kinds = {n: [t for t, *_, a, b, c in plain(ys) if (a, b, c)[i]] for i, n in enumerate(("spike", "drop", "shift"))}
        bins = sorted(t for ts in kinds.values() for t in ts)
        if max(ys) >= 8192 and bins:
            points = sum({"spike": 15, "drop": 10, "shift": 15}[n] for n, ts in kinds.items() if ts)
            want[k] = (points, "medium" if points >= 35 else "low" if points >= 15 else "info", (100 + bins[0]) * 60 * 10**9, (101 + bins[-1]) * 60 * 10**9, bool(kinds["spike"] or kinds["shift"]), sum(map(bool, kinds.values())))
    got = {(r["direction"], r["dim"], r["src_ip"], r["key"]): (r["score"], r["severity"], r["first_ns"], r["last_ns"], bool(r["attack"]), len(r["evidence"])) for r in found.collect()}
    assert got == want and len(want) == 6
    kept = {(r["direction"], r["dim"], r["src_ip"], r["key"]) for r in forecast.unexplained(found).collect()}
    assert kept == {("egress", "peer", "a", "9.9.9.9"), ("ingress", "host", "a", ""), ("egress", "port", "b", "53"), ("egress", "port", "b", "80")}
    assert all(r["title"] and r["dst_ip"] == (r["key"] if r["dim"] == "peer" else None) for r in found.collect())
    assert not forecast.traffic_anomalies(table.limit(0), 60).collect()


def test_rule_hits_take_the_first_packet_and_both_ways(spark):
    from flowquarry.operators import rules
    from flowquarry.sources.rules import parsed

    text = [
        'alert tcp any 21 <> any any (msg:"both"; content:"ab|00|"; sid:1;)', 'alert tcp any 21 -> any any (msg:"one"; content:"ab|00|"; sid:2;)',
        'alert ip any any -> any any (msg:"late"; content:"zz"; sid:3; priority:4;)', 'alert ip any any -> any any (msg:"same sid"; content:"z"; sid:3; priority:1;)', 'alert ip any any -> any any (msg:"empty"; content:""; sid:4;)',
    ]
    lines = spark.createDataFrame([*enumerate(text, 1), (6, None), (7, "  ")], "line int, text string")
    packets = [
        (3, "tcp", "a", "b", 21, 5, b"xab\x00y"), (2, "tcp", "a", "b", 5, 21, b"ab\x00"), (1, "udp", "a", "b", 21, 5, b"ab\x00"), (4, "udp", "a", "b", 1, 2, b"z"), (5, "udp", "a", "b", 1, 2, b"zz"), (6, "udp", "a", "b", 1, 2, b"zz"),
        (7, "tcp", None, "b", 1, 2, b"zz"), (8, "tcp", "a", "b", 1, 2, None), (9, "tcp", "a", "b", 1, 2, b""), (10, "udp", "c", "b", 1, 2, b"zz"),
    ]
    sent = spark.createDataFrame(packets, "ts_ns long, transport string, src_ip string, dst_ip string, src_port int, dst_port int, payload binary")
    for block in (5000, 2):
        got = {(r["title"], r["src_ip"], r["dst_port"], r["score"]) for r in rules.matches(sent, parsed(lines), block).collect()}
        assert got == {("both", "a", 5, 47), ("both", "a", 21, 47), ("one", "a", 5, 47), ("same sid", "a", 2, 90), ("late", "c", 2, 25)}
    assert not rules.matches(sent, parsed(lines.limit(0))).collect()
