"""Frames of one host or flow within a budget of packets and bytes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.order import checkpointed
from flowquarry.operators.stream import SHOWN, SLACK_NS

#: Bytes of a carved capture, of its head and of the head of a record.
MOST_BYTES, HEAD, RECORD = 64 << 20, 24, 16
_PLACES = (1 << 33) - 1


class Carved(NamedTuple):
    """``frames``: the carved rows; ``truncated``: there were more; ``skipped``: frames of another link type."""

    frames: DataFrame
    packets: int
    truncated: bool
    skipped: int


def of_host(ip: str) -> Column:
    return (F.col("src_ip") == ip) | (F.col("dst_ip") == ip)


def of_flow(src_ip: str, dst_ip: str, src_port: int, dst_port: int, transport: str) -> Column:
    """Packets of a flow, both ways."""
    way = lambda a, b, p, q: (F.col("src_ip") == a) & (F.col("dst_ip") == b) & (F.col("src_port") == p) & (F.col("dst_port") == q)
    return (F.col("transport") == transport) & (way(src_ip, dst_ip, src_port, dst_port) | way(dst_ip, src_ip, dst_port, src_port))


def carve(packets: DataFrame, target: Column, link: int, order: list[str], first_ns: int | None = None, last_ns: int | None = None, most_packets: int = SHOWN, most_bytes: int = MOST_BYTES) -> Carved:
    """The first frames of ``target`` in ``order``, as many as fit into a capture of ``most_packets`` and ``most_bytes``.

    ``packets``: decoded frames with link, cap_len, ts_ns, src_ip, dst_ip and the columns of ``order``, which should tell any two
    apart.  Frames without both addresses match nothing; those of another link type are skipped and counted, as a capture has
    one.  The first frame that does not fit ends the carving, even if later ones would.

    Matching frames are sorted by range over many tasks and written once; a sum a range tells which range has the end, and a
    running sum over the lengths of that range alone tells its place.  No task has all frames of the target.
    """
    # Fixed value: the window is widened by the tolerance of packet extraction.
    inside = F.lit(True)
    if first_ns is not None:
        inside = inside & (F.col("ts_ns") >= first_ns - SLACK_NS)
    if last_ns is not None:
        inside = inside & (F.col("ts_ns") <= last_ns + SLACK_NS)
    found = packets.filter("src_ip is not null and dst_ip is not null").filter(target & inside)
    skipped = found.filter(~F.col("link").eqNullSafe(F.lit(link))).count()
    n = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fit = found.filter(F.col("link") == link).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = checkpointed(fit.withColumn("place_", F.monotonically_increasing_id()))
    cost = F.coalesce(F.col("cap_len"), F.lit(0)).cast("long") + RECORD
    part = F.shiftright("place_", 33)
    packed, held, cut = 0, HEAD, None
    for p, rows, size in sorted(map(tuple, placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)), F.sum(cost)).collect())):
        if packed + rows > most_packets or held + size > most_bytes:
            at = placed.filter(part == p).select("place_", cost.alias("cost"))
            so_far = Window.orderBy("place_").rowsBetween(Window.unboundedPreceding, 0)
            over = at.select("place_", (F.row_number().over(so_far) + packed > most_packets).alias("many"), (F.sum("cost").over(so_far) + held > most_bytes).alias("big")).filter("many or big")
            cut = over.agg(F.min("place_")).first()[0]
            packed += cut & _PLACES
            break
        packed, held = packed + rows, held + size
    kept = placed if cut is None else placed.filter(F.col("place_") < cut)
    return Carved(kept.drop("place_"), packed, cut is not None, skipped)
