"""Capture files: classic pcap and pcapng, gzipped or not, to a row for each frame.

``frames`` takes contents that are already rows.  ``read_captures`` reads folders: long files are cut into byte ranges that
tasks read side by side, each with a window of a few megabytes, and gzipped files, which cannot be cut, run through such a
window in one task.  A file that is cut off or damaged gives the frames before the fault; one that is no capture gives none.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.tables import constant

#: ``at`` is the byte at which the frame's record begins, in the unpacked file.
SCHEMA = "path string, no long, at long, ts_ns long, ts_known boolean, wire_len long, cap_len long, link int, frame binary"

# First four bytes of a capture file, with byte order and nanoseconds a tick for pcap.
PCAP_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
GZIP_MAGIC = b"\x1f\x8b"
LARGEST_FRAME = 1 << 24


def sniff(content: Column) -> Column:
    """Format by the first bytes: pcap, pcapng, gzip, or null."""
    start = F.hex(F.substring(content, 1, 4))
    known = [m.hex().upper() for m in PCAP_MAGIC]
    return F.when(start.isin(*known), "pcap").when(start == PCAPNG_MAGIC.hex().upper(), "pcapng").when(F.startswith(start, F.lit(GZIP_MAGIC.hex().upper())), "gzip")


#: Bytes a window holds beside the record it stands at.
WINDOW = 1 << 20
#: Bytes of a range; a record belongs to the range in which it begins.
RANGE = 128 << 20
#: With more walks than this a range is walked again only from a place that is sure.
GUESSES = 2
#: Records that must follow one another before a place is taken for the start of one.
CHAIN = 8

#: Times beyond what a long holds become the nearest that it does.
LATEST = (1 << 63) - 1

#: (ts_ns, ts_known, wire_len, link, frame)
Frame = tuple[int, bool, int, int, bytes]


class Window:
    """Bytes of a file by place.  What is held is a block, so that walking through a file needs no more memory than that."""

    def __init__(self, file: Any, block: int = WINDOW):
        self.file, self.start, self.held, self.block = file, 0, b"", block

    def read(self, at: int, size: int) -> bytes:
        """The bytes from ``at``, fewer at the end of the file.  A stream that cannot seek is only read forwards."""
        if not self.start <= at <= at + size <= self.start + len(self.held):
            if self.file.seekable():
                self.file.seek(at)
                self.start, self.held = at, self.file.read(max(size, self.block))
            else:
                parts, have = [self.held[at - self.start :]], max(0, self.start + len(self.held) - at)
                skip = at - self.start - len(self.held)
                while have < size or skip > 0:
                    more = self.file.read(WINDOW)
                    if not more:
                        break
                    kept = more[max(0, skip) :]
                    skip -= len(more)
                    parts.append(kept)
                    have += len(kept)
                self.start, self.held = at, b"".join(parts)
        return self.held[at - self.start : at - self.start + size]


class Unpacked(io.RawIOBase):
    """A gzipped file of one member or more, unpacked as it is read; it ends where the data are cut off or damaged."""

    def __init__(self, file: Any):
        self.file, self.left, self.unpack = file, b"", zlib.decompressobj(31)

    def seekable(self) -> bool:
        return False

    def read(self, size: int = WINDOW) -> bytes:
        while True:
            if self.unpack.eof:
                self.left = self.unpack.unused_data or self.left
                self.unpack = zlib.decompressobj(31)
            chunk, self.left = self.left or self.file.read(size), b""
            if not chunk:
                return b""
            try:
                out = self.unpack.decompress(chunk, size)
            except zlib.error:
                self.file, self.left = io.BytesIO(), b""
                return b""
            self.left = self.unpack.unconsumed_tail
            if out:
                return out


class Pcap:
    """Walks the records of a classic capture.  After a walk, ``at`` is the next record and ``ended`` tells whether the file has no more."""

    first, step = 24, 1

    def __init__(self, window: Window, state: tuple | None = None):
        head = window.read(0, 24)
        self.window, self.ended, self.at, self.news = window, len(head) < 24, 24, []
        self.order, self.tick = PCAP_MAGIC[head[:4]]
        self.link = 0 if self.ended else struct.unpack_from(f"{self.order}I", head, 20)[0] & 0xFFFF

    def _head(self, at: int) -> tuple | None:
        head = self.window.read(at, 16)
        return struct.unpack(f"{self.order}IIII", head) if len(head) == 16 else None

    def starts(self, at: int, size: int) -> bool:
        """Whether records seem to follow one another from here."""
        for _ in range(CHAIN):
            if at == size:
                break
            head = self._head(at)
            if head is None or head[1] * self.tick >= 1_000_000_000 or head[2] > min(head[3], LARGEST_FRAME) or at + 16 + head[2] > size:
                return False
            at += 16 + head[2]
        return True

    def walk(self, at: int, stop: int | None, size: int | None = None) -> Iterator[tuple[int, Frame]]:
        """Frames whose records begin before ``stop``.  With ``size``, the length of the file, they are passed over unread and have no bytes."""
        self.at = at
        while not self.ended and (stop is None or self.at < stop):
            head = self._head(self.at)
            if head is None or head[2] > LARGEST_FRAME or (size is not None and self.at + 16 + head[2] > size):
                self.ended = True
                return
            seconds, part, held, wire = head
            frame = b"" if size is not None else self.window.read(self.at + 16, held)
            if size is None and len(frame) < held:
                self.ended = True
                return
            begun, self.at = self.at, self.at + 16 + held
            yield begun, (seconds * 1_000_000_000 + part * self.tick, True, wire, self.link, frame)


def _options(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(data):
        code, size = struct.unpack_from(f"{order}HH", data, at)
        if code == 0:
            return
        yield code, data[at + 4 : at + 4 + size]
        at += 4 + size + -size % 4


class Pcapng:
    """Walks the blocks of a pcapng file as ``Pcap`` walks records.

    ``state``: (byte order, interfaces) at the place where a walk begins; ``news`` lists the sections (a byte order) and
    interfaces (link, ticks a second, offset in seconds) that a walk has met, for those who begin behind it.
    """

    first, step = 0, 4

    def __init__(self, window: Window, state: tuple | None = None):
        self.window, self.ended, self.at, self.news = window, False, 0, []
        self.order, faces = state or ("<" if window.read(8, 4) == b"\x4d\x3c\x2b\x1a" else ">", [])
        self.faces = list(faces)

    def _block(self, at: int) -> tuple[int, int] | None:
        head = self.window.read(at, 12)
        if len(head) < 12:
            return None
        order = self.order
        if head[:4] == PCAPNG_MAGIC:
            order = "<" if head[8:] == b"\x4d\x3c\x2b\x1a" else ">"
        kind, size = struct.unpack_from(f"{order}II", head)
        return None if size < 12 or size % 4 or size > LARGEST_FRAME + 4096 else (kind, size)

    def starts(self, at: int, size: int) -> bool:
        for _ in range(CHAIN):
            if at == size:
                break
            block = self._block(at)
            if block is None or at + block[1] > size or self.window.read(at + block[1] - 4, 4) != self.window.read(at + 4, 4):
                return False
            at += block[1]
        return True

    def walk(self, at: int, stop: int | None, size: int | None = None) -> Iterator[tuple[int, Frame]]:
        self.at = at
        while not self.ended and (stop is None or self.at < stop):
            block = self._block(self.at)
            if block is None or (size is not None and self.at + block[1] > size):
                self.ended = True
                return
            kind, length = block
            # Of frames that are passed over, only the fixed fields are read.
            want = min(length, 32) if size is not None and kind in (3, 6) else length
            data = self.window.read(self.at, want)
            if len(data) < want:
                self.ended = True
                return
            begun, self.at = self.at, self.at + length
            if data[:4] == PCAPNG_MAGIC:  # a section may have its own byte order and interfaces
                self.order, self.faces = "<" if data[8:12] == b"\x4d\x3c\x2b\x1a" else ">", []
                self.news.append(self.order)
            elif kind == 1 and length >= 20:
                body = data[8:-4]
                found = dict(_options(body[8:], self.order))
                res = (found.get(9) or b"\x06")[0]
                ticks = 2 ** (res & 127) if res & 128 else 10**res
                offset = found.get(14, b"")
                self.faces.append((struct.unpack_from(f"{self.order}H", body)[0], ticks, struct.unpack(f"{self.order}q", offset)[0] if len(offset) == 8 else 0))
                self.news.append(self.faces[-1])
            elif kind == 6 and length >= 32:
                face, high, low, held, wire = struct.unpack_from(f"{self.order}IIIII", data, 8)
                if face < len(self.faces) and 32 + held <= length:
                    link, ticks, offset = self.faces[face]
                    yield begun, (max(-LATEST, min(LATEST, (high << 32 | low) * 1_000_000_000 // ticks + offset * 1_000_000_000)), True, wire, link, data[28 : 28 + held] if size is None else b"")
            elif kind == 3 and length >= 16 and self.faces:
                wire = struct.unpack_from(f"{self.order}I", data, 8)[0]
                yield begun, (0, False, wire, self.faces[0][0], data[12 : 12 + min(wire, length - 16)] if size is None else b"")


def _walker(window: Window, state: tuple | None = None) -> Pcap | Pcapng | None:
    magic = window.read(0, 4)
    return Pcap(window, state) if magic in PCAP_MAGIC else Pcapng(window, state) if magic == PCAPNG_MAGIC else None


def _whole(file: Any) -> Iterator[tuple[int, Frame]]:
    """All frames of an open file, unpacked once where it is gzipped; a gzipped file within a gzipped one gives none."""
    window = Window(file)
    if window.read(0, 2) == GZIP_MAGIC:
        file.seek(0)
        window = Window(Unpacked(file))
    walker = _walker(window)
    return walker.walk(walker.first, None) if walker else iter(())


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def _batches(path: str, first: int, found: Iterator[tuple[int, Frame]], rows: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` frames and about ``size`` bytes; the frames are numbered from ``first``."""
    made, held = [], 0
    for no, (at, (ts, known, wire, link, frame)) in enumerate(found, first):
        made.append((path, no, at, ts, known, wire, len(frame), link, frame))
        held += len(frame)
        if len(made) == rows or held >= size:
            yield _batch(made)
            made, held = [], 0
    if made:
        yield _batch(made)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def frames(files: DataFrame, batch: int = 2000) -> DataFrame:
    """A row for each frame of ``files`` (path, content); ``no`` counts from 0 in each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _batches(path, 0, _whole(io.BytesIO(content.as_py() or b"")), batch)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path within it, what stands before that path) of a path or URI; a URI of a local file may have one slash or three."""
    path = re.sub("^file:/+", "/", path)
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    return *fs.FileSystem.from_uri(path), path.split("://")[0] + "://" + (path.split("/")[2] if path.startswith("hdfs:") else "")


def discovered(folder: str, recursive: bool = True) -> list[tuple[str, int]]:
    """Capture files of a folder, or the one file named, with their sizes, by path.  Names that begin with a point or an underscore are left out."""
    system, root, before = located(folder)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=recursive))
    named = [f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.base_name.lower().removesuffix(".gz").endswith((".pcap", ".pcapng", ".cap"))]
    return sorted((before + f.path, f.size) for f in named)


def _open(path: str) -> Any:
    system, name, _ = located(path)
    return system.open_input_file(name)


_SPAN = "path string, start long, stop long, size long, state string, first long, no long"
_WALKED = "path string, start long, state string, found long, next long, ended boolean, frames long, news string"


def _spread(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return constant(spark, rows, _SPAN).repartition(max(1, min(len(rows), 8 * spark.sparkContext.defaultParallelism)))


def _window(r: dict, file: Any) -> Window:
    """A window for one range: blocks no longer than the range, so that short ranges do not read their neighbours anew."""
    return Window(file, min(WINDOW, max(4096, r["stop"] - r["start"])))


def _after(state: str | None, news: list) -> str | None:
    """State behind a walk, as text: what it met added to what was known before."""
    order, faces = json.loads(state) if state else (None, [])
    for x in news:
        order, faces = (x, []) if isinstance(x, str) else (order, [*faces, list(x)])
    return json.dumps([order, faces]) if order else None


def _walk(r: dict, file: Any) -> tuple:
    """What a walk through a range finds without reading its frames, as a row of ``_WALKED``.

    Where the range's first record is not known, the walk begins at the first place that looks like one, with the interfaces
    that the file declares before its first frame.
    """
    window, state, at = _window(r, file), r["state"], r["first"]
    walker = _walker(window)
    if walker is None:  # no capture, or gzipped whatever its name
        return r["path"], r["start"], None, None, 0, True, None if window.read(0, 2) == GZIP_MAGIC else 0, "[]"
    if r["start"] == 0:
        at = walker.first
    elif at is None:
        next(walker.walk(walker.first, r["start"], r["size"]), None)
        state = _after(None, walker.news)
        walker = _walker(window, json.loads(state) if state else None)
        # The next record begins within the largest record of here, unless the file is damaged.  Of the places that look like
        # one, the first from which records lead out of the range is taken: those inside a frame end with the frame.
        begin = r["start"] + -r["start"] % walker.step
        for x in range(begin, min(r["stop"], begin + LARGEST_FRAME + 8192), walker.step):
            if walker.starts(x, r["size"]):
                trial = _walk({**r, "state": state, "first": x}, file)
                if not trial[5] or trial[4] == r["size"]:
                    return trial
    else:
        walker = _walker(window, json.loads(state) if state else None)
    count = sum(1 for _ in walker.walk(at, r["stop"], r["size"])) if at is not None else 0
    return r["path"], r["start"], state, at, walker.at, walker.ended, count, json.dumps(walker.news)


def _walked(spans: DataFrame) -> DataFrame:
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in _WALKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with _open(r["path"]) as file:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(_walk(r, file), types, strict=True)], names=names)

    return spans.mapInArrow(run, _WALKED)


def ranges(spark: SparkSession, files: list[tuple[str, int]], span: int = RANGE) -> list[tuple]:
    """Rows of ``_SPAN`` that together hold all frames of the files; one without ``start`` is a gzipped file, whole.

    All ranges are walked at once, each from the first place that looks like a record.  The walk before tells where a range
    truly begins and with which interfaces; one that began otherwise (bytes of a frame can look like records) is walked
    again from there, so that the result is that of one pass.  The driver holds a row a range, never frames.

    A walk that began otherwise nearly always comes upon the true records before its end, so where it ended is tried as the
    start of what follows, and all such ranges are walked again at once: as many jobs follow as ranges in a row are on a
    wrong path that never meets the true one.  Nothing is taken over before the whole file fits together.
    """
    whole = [(path, None, None, size, None, None, 0) for path, size in files if path.lower().endswith(".gz")]
    cut: dict[str, list[tuple]] = {path: [(at, min(at + span, size)) for at in range(0, size, span)] for path, size in files if not path.lower().endswith(".gz")}
    sizes = dict(files)
    # The walks of each range by where and in which state they began; the first is the one from its own start.
    seen: dict[tuple[str, int], dict[tuple, Row]] = {}
    todo = [(path, start, stop, sizes[path], None, None, None) for path, parts in cut.items() for start, stop in parts]
    known: list[tuple] = []
    while todo:
        for w in _walked(_spread(spark, todo)).collect():
            seen.setdefault((w.path, w.start), {})[w.found, w.state] = w
        todo, known = [], []
        for path, parts in cut.items():
            at, state, no, sure = None, None, 0, True
            for start, stop in parts:
                walks = seen[path, start]
                own = next(iter(walks.values()))
                if own.frames is None:
                    known.append((path, None, None, sizes[path], None, None, 0))
                    break
                if start and at >= stop:  # a record longer than the range
                    continue
                w = walks.get((at, state)) if start else own
                if w is None:
                    if sure or len(walks) <= GUESSES:
                        todo.append((path, start, stop, sizes[path], state, at, None))
                    sure, w = False, own
                    # What a walk from elsewhere took for sections and interfaces says nothing about the ranges behind it.
                    if w.found is None or (w.found != at and w.news != "[]"):
                        break
                if w.frames:
                    known.append((path, start, stop, sizes[path], w.state, w.found, no))
                at, state, no = w.next, _after(w.state if not start else state, json.loads(w.news)), no + w.frames
                if w.ended:
                    break
    return sorted(whole + known, key=lambda r: (r[0], r[1] or 0))


def read_captures(spark: SparkSession, folder: str, recursive: bool = True, span: int = RANGE, batch: int = 2000) -> DataFrame:
    """Frames of all capture files of a folder, or of one file: a row for each, numbered from 0 in its file.

    Files of more than ``span`` bytes are read by several tasks.  The folder is listed and the ranges are found when this is
    called; frames are read when the result is.
    """
    rows = ranges(spark, discovered(folder, recursive), span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with _open(r["path"]) as file:
                    if r["start"] is None:
                        found = _whole(file)
                    else:
                        walker = _walker(_window(r, file), json.loads(r["state"]) if r["state"] else None)
                        found = walker.walk(r["first"], r["stop"])
                    yield from _batches(r["path"], r["no"], found, batch)

    return _spread(spark, rows).mapInArrow(run, SCHEMA)


#: Columns of a packet index: where in its capture file a frame of a flow is.
INDEX = "capture_id long, flow_id long, ts timestamp, file_offset long, len long, frame_no long"


def read_packet_index(spark: SparkSession, path: str) -> DataFrame:
    """A packet index from Parquet, by column name; columns that a file lacks are null."""
    return spark.read.schema(INDEX).parquet(path)
