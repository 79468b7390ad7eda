"""Pivot edges and the forest of parents against loops over single hosts."""

from __future__ import annotations

import random

import pytest

from flowquarry.operators import correlate

FINDING = "kind string, src_ip string, dst_ip string, first_ns long, victims array<string>"
HOUR = 3_600_000_000_000
WEIGHT = {"brute_force": 100, "exposed_remote_access": 90, "lateral_movement": 80, "host_sweep": 30, "port_scan": 30}


def brute_edges(findings):
    start = {}
    for _, src, _, t, _ in findings:
        start[src] = min((x for x in (start.get(src), t) if x is not None), default=None)
    out = []
    for kind, src, dst, t, victims in findings:
        for b in ([dst] if dst else []) if kind in ("brute_force", "exposed_remote_access", "port_scan") else victims or [] if kind in WEIGHT else []:
            if b == src or b not in start:
                continue
            gap = None if t is None or start[b] is None else start[b] - t
            if gap is None or -1_000_000_000 <= gap <= HOUR:
                out.append((src, b, kind, WEIGHT[kind], None if gap is None else abs(gap)))
    return sorted(out, key=str)


def brute_parents(edges):
    parent = {}
    for b in sorted({e[1] for e in edges}):
        for e in sorted((e for e in edges if e[1] == b), key=lambda e: (-e[3], e[4] is None, e[4] or 0, e[0], e[2])):
            up = e[0]
            while up != b and up in parent:
                up = parent[up][0]
            if up != b:
                parent[b] = e
                break
    return sorted(parent.values(), key=str)


def edges_of(spark, findings):
    return sorted(map(tuple, correlate.pivot_edges(spark.createDataFrame(findings, FINDING)).collect()), key=str)


def test_only_the_first_act_of_a_victim_counts(spark):
    late = [("brute_force", "a", "b", 10 * HOUR, None), ("beacon", "b", None, HOUR, None), ("beacon", "b", None, 10 * HOUR + 5, None)]
    assert edges_of(spark, late) == []
    soon = [("brute_force", "a", "b", HOUR, None), ("beacon", "b", None, HOUR + 7, None), ("beacon", "b", None, None, None)]
    assert edges_of(spark, soon) == [("a", "b", "brute_force", 100, 7)]
    untimed = [("lateral_movement", "a", None, None, ["b", "c", "a"]), ("beacon", "b", None, 5, None), ("host_sweep", "d", None, 3, ["c"]), ("beacon", "c", None, None, None)]
    assert edges_of(spark, untimed) == [("a", "b", "lateral_movement", 80, None), ("a", "c", "lateral_movement", 80, None), ("d", "c", "host_sweep", 30, None)]
    assert edges_of(spark, [("brute_force", "a", "b", 2 * 10**9, None), ("beacon", "b", None, 10**9, None)]) == [("a", "b", "brute_force", 100, 10**9)]


EDGE = "from_host string, to_host string, kind string, weight int, dwell_ns long"


def parents_of(spark, edges):
    return sorted(map(tuple, correlate.parents(spark.createDataFrame(edges, EDGE)).collect()), key=str)


def test_a_cycle_costs_its_last_host_its_best_edge(spark):
    edges = [("a", "b", "brute_force", 100, 1), ("b", "a", "brute_force", 100, 1), ("c", "b", "port_scan", 30, 9)]
    assert parents_of(spark, edges) == [("b", "a", "brute_force", 100, 1), ("c", "b", "port_scan", 30, 9)]
    assert parents_of(spark, edges[:2]) == [("b", "a", "brute_force", 100, 1)]
    assert parents_of(spark, []) == []


@pytest.mark.parametrize("seed", range(2))
def test_forest_against_a_loop(spark, seed):
    rng = random.Random(seed)
    hosts = [f"h{i}" for i in range(14)]
    findings = []
    for _ in range(90):
        src = rng.choice(hosts)
        kind = rng.choice([*WEIGHT, "beacon"])
        findings.append((kind, src, rng.choice([None, *hosts]), rng.choice((None, rng.randrange(2 * HOUR))), rng.sample(hosts, 2)))
    want = brute_edges(findings)
    assert edges_of(spark, findings) == want and len(want) > 20
    assert parents_of(spark, want) == brute_parents(want)
