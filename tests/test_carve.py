"""Carved frames against a loop, and capture files written and read back."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowquarry.operators import carve
from flowquarry.sources.capture import INDEX, discovered, read_captures, read_packet_index
from flowquarry.sources.capture_sink import write_captures

SCHEMA = "idx long, ts_ns long, link int, cap_len long, wire_len long, transport string, src_ip string, dst_ip string, src_port int, dst_port int, frame binary"


def _rows(n=400):
    rng = random.Random(9)
    hosts = ["a", "b", "c", None]
    out = []
    for i in range(n):
        frame = rng.randbytes(rng.randint(0, 60))
        out.append((i, rng.randint(0, 50) * 1_000_000_000, rng.choice((1, 1, 1, 101)), len(frame), len(frame) + 5, rng.choice(("tcp", "udp")), rng.choice(hosts), rng.choice(hosts), rng.choice((1, 2)), rng.choice((1, 2)), frame))
    return out


def _loop(rows, match, link, most_packets, most_bytes):
    kept, held, skipped, cut = [], 24, 0, False
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[6] is None or r[7] is None or not match(r):
            continue
        if r[2] != link:
            skipped += 1
        elif not cut:
            if len(kept) >= most_packets or held + 16 + r[3] > most_bytes:
                cut = True
            else:
                kept.append(r[0])
                held += 16 + r[3]
    return sorted(kept), cut, skipped


_HOST = lambda: carve.of_host("a"), lambda r: "a" in r[6:8]
_FLOW = lambda: carve.of_flow("a", "b", 1, 2, "tcp"), lambda r: r[5] == "tcp" and r[6:10] in (("a", "b", 1, 2), ("b", "a", 2, 1))


@pytest.mark.parametrize("most_packets, most_bytes", [(10**9, 10**9), (0, 10**9), (1, 10**9), (57, 10**9), (10**9, 24), (10**9, 1_000), (10**9, 3_003), (40, 1_500)])
def test_budgets(spark, most_packets, most_bytes):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    for target, match in (_HOST, _FLOW):
        got = carve.carve(df, target(), 1, ["ts_ns", "idx"], most_packets=most_packets, most_bytes=most_bytes)
        kept, cut, skipped = _loop(rows, match, 1, most_packets, most_bytes)
        assert sorted(r.idx for r in got.frames.collect()) == kept
        assert (got.packets, got.truncated) == (len(kept), cut)
        assert got.skipped == skipped


def test_a_budget_that_is_just_met(spark):
    rows = _rows()
    all_, _, _ = _loop(rows, _HOST[1], 1, 10**9, 10**9)
    size = 24 + sum(16 + r[3] for r in rows if r[0] in all_)
    df = spark.createDataFrame(rows, SCHEMA)
    for most_bytes, cut in ((size, False), (size - 1, True)):
        assert carve.carve(df, _HOST[0](), 1, ["ts_ns", "idx"], most_bytes=most_bytes).truncated == cut
    for most_packets, cut in ((len(all_), False), (len(all_) - 1, True)):
        assert carve.carve(df, _HOST[0](), 1, ["ts_ns", "idx"], most_packets=most_packets).truncated == cut
    empty = carve.carve(df.limit(0), _HOST[0](), 1, ["ts_ns", "idx"])
    assert (empty.frames.collect(), empty.packets, empty.truncated, empty.skipped) == ([], 0, False, 0)


@pytest.mark.parametrize("most_bytes", [1 << 30, 500])
def test_files_give_back_the_frames(spark, tmp_path, most_bytes):
    df = spark.createDataFrame(_rows(), SCHEMA)
    files = write_captures(df, str(tmp_path / "c"), ["ts_ns", "idx"], files=3, most_bytes=most_bytes).collect()
    found = discovered(str(tmp_path / "c"))
    assert [(f.path, f.bytes) for f in sorted(files)] == found
    assert all(f.bytes <= most_bytes for f in files) and sum(f.frames for f in files) == df.count()
    key = ("ts_ns", "wire_len", "link", "frame")
    back = read_captures(spark, str(tmp_path / "c"), span=256)
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, df.select(*key).collect()))
    # In the order of names and numbers, each link type has its frames in time.
    for link in (1, 101):
        times = [r.ts_ns for r in back.filter(F.col("link") == link).orderBy("path", "no").collect()]
        assert times == sorted(times)


def test_times_and_lengths_a_file_does_not_know(spark, tmp_path):
    df = spark.createDataFrame([(None, None, None, b"ab"), (-5, 7, 1, None), ((1 << 63) - 1, 3, 1, b"xyz")], "ts_ns long, wire_len long, link int, frame binary")
    write_captures(df, str(tmp_path / "c"), files=2).count()
    got = sorted((r.ts_ns, r.wire_len, r.link, bytes(r.frame)) for r in read_captures(spark, str(tmp_path / "c")).collect())
    assert got == [(0, 2, 1, b"ab"), (0, 7, 1, b""), ((1 << 32) * 1_000_000_000 - 1, 3, 1, b"xyz")]


def test_packet_index(spark, tmp_path):
    spark.createDataFrame([(1, 2, 24, 60, 0)], "capture_id long, flow_id long, file_offset long, len long, frame_no long").write.parquet(str(tmp_path / "i"))
    got = read_packet_index(spark, str(tmp_path / "i"))
    assert got.columns == [c.split()[0] for c in INDEX.split(", ")]
    assert tuple(got.first()) == (1, 2, None, 24, 60, 0)
