"""Frames to capture files."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.sources.capture import located

#: Bytes of a file after which a task begins another.
FILE_BYTES = 1 << 30

_WRITTEN = "path string, frames long, bytes long"


def write_captures(frames: DataFrame, folder: str, order: list[str] | None = None, files: int | None = None, most_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``frames`` (ts_ns, wire_len, link, frame) as classic captures with nanoseconds; a row for each file: (path, frames, bytes).

    The format has one link type for a file, so frames are sorted by link type and then by ``order`` (default: time) over
    ``files`` tasks (default: the shuffle partitions), each of which writes files of its own; in the order of their names they
    have the frames of a link type in order.  A null frame is an empty one, a null length that of the frame; times that the format
    does not know (null, before 1970, after 2105) become its nearest.  The files are written when the result is read.  A file gets
    its name when it is whole, and a task that runs again replaces what it wrote: an executor may be lost.  The folder must be
    one that all nodes reach.
    """
    by = order or ["ts_ns"]
    n = files or int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root, _ = located(folder)
        system.create_dir(root, recursive=True)
        part, no, out, link, done = TaskContext.get().partitionId(), 0, None, None, []

        def finish() -> None:
            nonlocal no, out
            out.close()
            name = f"{root}/part-{part:05d}-{no:05d}.pcap"
            system.move(draft, name)
            done.append((f"{folder.rstrip('/')}/{name.rsplit('/', 1)[1]}", count, size))
            no, out = no + 1, None

        for b in batches:
            for ts, wire, kind, frame in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                frame = frame or b""
                if out is not None and (kind != link or size + 16 + len(frame) > most_bytes):
                    finish()
                if out is None:
                    draft, link, count, size = f"{root}/_{uuid.uuid4().hex}", kind, 0, 24
                    out = system.open_output_stream(draft, buffer_size=1 << 20)
                    # Head of a capture with nanoseconds, little-endian, version 2.4.
                    out.write(struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 1 << 24, kind))
                seconds, part_ns = divmod(min(max(ts or 0, 0), (1 << 32) * 1_000_000_000 - 1), 1_000_000_000)
                out.write(struct.pack("<IIII", seconds, part_ns, len(frame), len(frame) if wire is None else wire) + frame)
                count, size = count + 1, size + 16 + len(frame)
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "frames", "bytes"])

    # Frames of one time are ordered by their bytes, so that a task that runs again has the same order.
    keys = ["link", *by, "wire_len", "frame"]
    sorted_ = frames.select(*dict.fromkeys(["ts_ns", "wire_len", "link", "frame", *by])).repartitionByRange(n, "link", *by).sortWithinPartitions(*keys)
    return sorted_.select("ts_ns", "wire_len", F.coalesce("link", F.lit(1)).alias("link"), "frame").mapInArrow(run, _WRITTEN)
