"""Payloads against many content rules, held against a plain loop."""

from __future__ import annotations

import random

from flowquarry.operators.rules import SCORES, matches
from flowquarry.sources.rules import parsed

RULE = "line int, reason string, sid long, action string, proto string, src_port int, dst_port int, both_ways boolean, content string, msg string, attack array<string>, severity string"
PACKET = "ts_ns long, transport string, src_ip string, dst_ip string, src_port int, dst_port int, payload binary"


def _loop(packets, rules):
    first = {}
    for ts, transport, src, dst, sport, dport, payload in packets:
        for line, reason, sid, _, proto, rs, rd, both, content, msg, _, severity in rules:
            if reason or not content or src is None or dst is None or not payload or bytes.fromhex(content) not in payload:
                continue
            way = lambda a, b: (rs is None or rs == a) and (rd is None or rd == b)  # noqa: B023, E731
            if proto in ("ip", transport) and (way(sport, dport) or both and way(dport, sport)):
                key = (sid, src, dst, dport)
                first[key] = min(first.get(key, (ts, line)), (ts, line))
    named = {r[0]: r for r in rules}
    return sorted((named[line][9] or f"sid:{sid}", src, dst, dport, SCORES[named[line][11]], f"matched content ({len(named[line][8]) // 2} bytes)") for (sid, src, dst, dport), (_, line) in first.items())


def _got(spark, packets, rules, **bounds):
    out = matches(spark.createDataFrame(packets, PACKET), spark.createDataFrame(rules, RULE), **bounds)
    return out, sorted((r.title, r.src_ip, r.dst_ip, r.dst_port, r.score, r.evidence[1]) for r in out.collect())


def _rules(n, rng):
    rows = []
    for i in range(n):
        # Contents that are parts of each other, repeat, and hold bytes of all values.
        content = bytes(rng.choice((0, 65, 66, 255)) for _ in range(rng.randint(1, 6)))
        port = lambda: rng.choice((None, None, 80, 443))
        rows.append((i + 1, rng.choice((None,) * 9 + ("bad",)), i // 2, "alert", rng.choice(("ip", "tcp", "udp")), port(), port(), rng.random() < 0.5, content.hex().upper(), rng.choice(("", f"m{i}")), ["T1"], rng.choice(list(SCORES))))
    return [*rows, (n + 1, None, 10**6, "alert", "ip", None, None, False, "", "empty", [], "low")]


def test_matches_agree_with_a_loop(spark):
    rng = random.Random(7)
    rules = _rules(60, rng)
    host = lambda: rng.choice(("10.0.0.1", "10.0.0.2", "2001:db8::1", None))
    packets = [(rng.randint(0, 40), rng.choice(("tcp", "udp", "icmp", None)), host(), host(), rng.choice((80, 443, 5)), rng.choice((80, 443, 6)), rng.choice((None, b"", bytes(rng.choice((0, 65, 66, 255, 1)) for _ in range(rng.randint(1, 30)))))) for _ in range(300)]
    want = _loop(packets, rules)
    assert len(want) > 100
    assert _got(spark, packets, rules)[1] == want
    # Several automata give the same as one.
    assert _got(spark, packets, rules, most_contents=9)[1] == want
    assert _got(spark, packets, rules, most_bytes=40)[1] == want


def test_no_rules_no_packets(spark):
    rules = _rules(3, random.Random(1))
    assert _got(spark, [], rules)[1] == []
    assert _got(spark, [(1, "tcp", "a", "b", 1, 2, b"AB")], [r for r in rules if not r[8]])[1] == []


def test_fifty_thousand_rules(spark):
    rules = [(i, None, i, "alert", "tcp", None, None, False, f"rule {i:06d};".encode().hex(), "", [], "low") for i in range(50_000)]
    packets = [(i, "tcp", "10.0.0.1", "10.0.0.2", 1, 2, b"x" * (i % 50) + f"rule {i * 7 % 60_000:06d};".encode() * 2) for i in range(2_000)]
    out, got = _got(spark, packets, rules)
    assert [g[0] for g in got] == sorted(f"sid:{i * 7 % 60_000}" for i in range(2_000) if i * 7 % 60_000 < 50_000)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "CartesianProduct" not in out._jdf.queryExecution().toString()


def test_numbers_beyond_32_bits(spark):
    texts = [f'alert tcp any any -> any any (msg:"m"; content:"x"; sid:{sid};)' for sid in (4_294_967_295, 4_294_967_296, 1_200_000_0018, (1 << 63) - 1, 1 << 63)] + ['alert icmp any any -> any any (content:"x"; sid:9000000000;)']
    got = parsed(spark.createDataFrame(list(enumerate(texts)), "line int, text string")).orderBy("line").select("sid", "reason").collect()
    assert [r.sid for r in got] == [4_294_967_295, 4_294_967_296, 12_000_000_018, (1 << 63) - 1, None, 9_000_000_000]
    assert [r.reason for r in got] == [None] * 4 + [f"bad sid: {1 << 63}", "unsupported proto: icmp"]
