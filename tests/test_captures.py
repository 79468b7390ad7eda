"""Capture files on disk: ranges against one pass, damaged files, discovery."""

from __future__ import annotations

import gzip
import io
import random
import struct

import pytest

from flowquarry.sources import capture
from flowquarry.sources.capture import discovered, ranges, read_captures


def _record(order, second, part, frame, wire=None):
    return struct.pack(f"{order}IIII", second, part, len(frame), wire or len(frame)) + frame


def _pcap(frames, order="<", magic=b"\xd4\xc3\xb2\xa1"):
    return magic + struct.pack(f"{order}HHiIII", 2, 4, 0, 0, 65535, 1) + b"".join(_record(order, 1_700_000_000 + i, i, f) for i, f in enumerate(frames))


def _block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(f"{order}II", kind, len(body) + 12) + body + struct.pack(f"{order}I", len(body) + 12)


def _section(order):
    return b"\x0a\x0d\x0d\x0a" + struct.pack(f"{order}IIHHqI", 28, 0x1A2B3C4D, 1, 0, -1, 28)


def _face(order, link, resolution, offset=None):
    options = struct.pack(f"{order}HHB3x", 9, 1, resolution) + (struct.pack(f"{order}HHq", 14, 8, offset) if offset is not None else b"") + b"\0\0\0\0"
    return _block(order, 1, struct.pack(f"{order}HHI", link, 0, 65535) + options)


def _packet(order, face, ticks, frame):
    return _block(order, 6, struct.pack(f"{order}IIIII", face, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame)


def _frames(rng, n):
    return [rng.randbytes(rng.randint(0, 90)) for _ in range(n)]


def _pcapng(rng):
    """Two sections of different byte orders, interfaces declared late, frames of unknown interfaces, simple packets."""
    out = b""
    for order in "<>":
        out += _section(order) + _face(order, 1, 6)
        for i in range(150):
            if i == 60:
                out += _face(order, 101, 9, 5) + _face(order, 113, 0x80 | 10)
            if i % 40 == 7:
                out += _block(order, 3, struct.pack(f"{order}I", 5) + b"abcde") + _block(order, 0xBAD, b"other")
            out += _packet(order, rng.randint(0, 2), rng.getrandbits(50), rng.randbytes(rng.randint(0, 70)))
    return out


def _hostile():
    """Frames that hold long runs of well-formed records themselves."""
    inner = b"".join(_record("<", 1, 1, b"ab") for _ in range(60))
    return _pcap([b"x" * (i % 7) + inner for i in range(12)])


def _cases():
    rng = random.Random(3)
    plain = _pcap(_frames(rng, 300))
    mixed = _pcapng(rng)
    damaged = bytearray(plain)
    damaged[24 + 8 : 24 + 12] = b"\xff\xff\xff\xff"
    middle = _pcap(_frames(rng, 100)) + struct.pack("<IIII", 1, 1, 1 << 30, 1) + b"".join(_record("<", 1, 1, b"abc") for _ in range(50))
    return {
        "a.pcap": plain, "big.cap": _pcap(_frames(rng, 200), ">", b"\xa1\xb2\x3c\x4d"), "b.pcapng": mixed, "hostile.pcap": _hostile(), "cut.pcap": plain[:-5], "cutng.pcapng": mixed[:-3],
        "damaged.pcap": bytes(damaged), "middle.pcap": middle, "empty.pcap": b"", "head.pcap": plain[:24], "short.pcap": plain[:11], "text.pcap": b"no capture at all" * 50, "long.pcap": _pcap([b"z" * 3000, b"y", b"", b"w" * 1500] * 3),
        "z.pcap.gz": gzip.compress(plain[:4000]) + gzip.compress(plain[4000:]), "cut.pcap.gz": gzip.compress(plain)[:-2000], "nested.pcap.gz": gzip.compress(gzip.compress(plain)), "hidden.pcap": gzip.compress(mixed),
        "junk.pcap.gz": gzip.compress(plain) + b"junk behind the end",
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("captures")
    for i, (name, data) in enumerate(_cases().items()):
        at = root / ("sub" if i % 3 == 0 else ".") / name
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(data)
    for name in ("note.txt", ".a.pcap", "_b.pcap", "c.pcapx"):
        (root / name).write_bytes(b"x")
    return root


def _plain_pcap(data):
    """Records of a classic capture, one after another."""
    order, tick = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1)}[data[:4]]
    out, file = [], io.BytesIO(data[24:])
    while len(head := file.read(16)) == 16:
        s, part, held, wire = struct.unpack(f"{order}IIII", head)
        if held > 1 << 24 or len(frame := file.read(held)) < held:
            break
        out.append((s * 10**9 + part * tick, True, wire, held, 1, frame))
    return out


def test_one_pass_reads_the_records():
    cases = _cases()
    for name in ("a.pcap", "big.cap", "hostile.pcap", "cut.pcap", "damaged.pcap", "middle.pcap", "long.pcap"):
        got = [(ts, known, wire, len(f), link, f) for _, (ts, known, wire, link, f) in capture._whole(io.BytesIO(cases[name]))]
        assert got == _plain_pcap(cases[name]), name
    assert len(_plain_pcap(cases["middle.pcap"])) == 100
    assert _plain_pcap(cases["damaged.pcap"]) == []
    whole = list(capture._whole(io.BytesIO(cases["a.pcap"])))
    assert list(capture._whole(io.BytesIO(cases["z.pcap.gz"]))) == whole == list(capture._whole(io.BytesIO(cases["junk.pcap.gz"])))
    part = list(capture._whole(io.BytesIO(cases["cut.pcap.gz"])))
    assert 0 < len(part) < len(whole) and part == whole[: len(part)]
    assert list(capture._whole(io.BytesIO(cases["nested.pcap.gz"]))) == []


def test_pcapng_times_and_interfaces():
    order = "<"
    data = _section(order) + _face(order, 1, 6) + _face(order, 101, 9, 5) + _face(order, 113, 0x80 | 10) + _packet(order, 0, 1_000_001, b"a") + _packet(order, 1, 7, b"bc") + _packet(order, 2, 512, b"") + _packet(order, 3, 1, b"unknown") + _block(order, 3, struct.pack("<I", 3) + b"xyz")
    got = [f for _, f in capture._whole(io.BytesIO(data))]
    assert got == [(1_000_001_000, True, 1, 1, b"a"), (5_000_000_007, True, 2, 101, b"bc"), (500_000_000, True, 0, 113, b""), (0, False, 3, 1, b"xyz")]


@pytest.mark.parametrize("span", [96, 1000, 1 << 20])
def test_ranges_agree_with_one_pass(spark, folder, span):
    want = []
    for path, _ in discovered(str(folder)):
        with open(path, "rb") as f:
            want += [(path, no, at, ts, known, wire, len(frame), link, frame) for no, (at, (ts, known, wire, link, frame)) in enumerate(capture._whole(io.BytesIO(f.read())))]
    got = [(*r[:-1], bytes(r[-1])) for r in read_captures(spark, str(folder), span=span).collect()]
    assert sorted(got) == sorted(want)


def test_a_long_file_is_read_by_many_tasks(spark, folder):
    path = str(folder / "big.cap")
    spans = ranges(spark, discovered(path), 1000)
    assert len(spans) > 8
    assert read_captures(spark, path, span=1000).select(capture.F.spark_partition_id()).distinct().count() > 4


def test_many_misled_ranges_are_walked_again_at_once(spark, tmp_path, monkeypatch):
    """The last 16 bytes of a short frame look like an empty record, at which every third range or so begins."""
    frame = bytes(range(1, 45)) + bytes.fromhex("00025002200000000000000000000000")
    (tmp_path / "a.pcap").write_bytes(_pcap([frame] * 4000))
    asked, walked = [], capture._walked
    monkeypatch.setattr(capture, "_walked", lambda spans: asked.append(spans.count()) or walked(spans))
    got = read_captures(spark, str(tmp_path), span=1000).select("no", "frame").collect()
    assert sorted(r.no for r in got) == list(range(4000)) and {bytes(r.frame) for r in got} == {frame}
    assert asked[1] > 30 and len(asked) < 12 and sum(asked) < 4 * asked[0]


def test_discovery(folder):
    found = [p for p, _ in discovered(str(folder))]
    assert found == sorted(found) and len(found) == len(_cases())
    assert all("/sub/" not in p for p, _ in discovered(str(folder), recursive=False))
    assert len(discovered(str(folder), recursive=False)) < len(found)


def test_empty_folder(spark, tmp_path):
    assert read_captures(spark, str(tmp_path)).collect() == []
