"""Payloads against content rules, and what the hits add to the findings."""

from __future__ import annotations

import uuid
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.tables import constant
from flowquarry.operators import correlate
from flowquarry.operators.detect import COLUMNS

#: Fixed value: points of a rule's severity.
SCORES = {"info": 7, "low": 25, "medium": 47, "high": 70, "critical": 90}
#: Bounds of one automaton: distinct contents and their bytes.  More contents go into further automata, each another pass.
MOST_CONTENTS, MOST_BYTES = 200_000, 16 << 20

#: Automata this Python worker has built, by key; a worker that is reused for other tasks keeps the last few.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, shared: Broadcast) -> ahocorasick.Automaton:
    if key not in _BUILT:
        built = ahocorasick.Automaton()
        for no, content in shared.value:
            # A character for each byte.
            built.add_word(content.decode("latin-1"), no)
        built.make_automaton()
        while len(_BUILT) >= 4:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = built
    return _BUILT[key]


def contents_in(payload: Column, shared: Broadcast) -> Column:
    """Numbers of the contents of ``shared`` (number, bytes) that stand in a payload, each once, in one pass over its bytes."""
    key = uuid.uuid4().hex

    @F.arrow_udf("array<int>")
    def found(payloads: pa.Array) -> pa.Array:
        automaton = _automaton(key, shared)
        return pa.array([None if p is None else sorted({no for _, no in automaton.iter(p.decode("latin-1"))}) for p in payloads.to_pylist()], pa.list_(pa.int32()))

    return found(payload)


def _blocks(usable: DataFrame, most_contents: int, most_bytes: int) -> list[DataFrame]:
    """The rules in parts whose distinct contents keep both bounds, as far as the hash of a content spreads them evenly.

    Rules of one content stay together.  Only counts come to the driver here.
    """
    size = usable.agg(F.count_distinct("content").alias("n"), F.sum(F.length("content") / 2).alias("bytes")).first()
    parts = max(1, -(-size["n"] // most_contents), -(-int(size["bytes"] or 0) // most_bytes))
    return [usable.filter(F.pmod(F.xxhash64("content"), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [usable]


def matches(packets: DataFrame, rules: DataFrame, most_contents: int = MOST_CONTENTS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Findings of the kind ``rule_match``: one for each (sid, source, target, target port), from the first packet that hits.

    ``packets``: (ts_ns, transport, src_ip, dst_ip, src_port, dst_port, payload binary); ``rules``: the usable rows of
    ``sources.rules.parsed``.  An empty content hits nothing; packets without addresses or payload are passed over.  Of two
    packets of one time, the rule of the smaller line names the finding.

    The contents become one automaton, sent to the workers within ``most_contents`` and ``most_bytes``: a payload is read
    once, however many rules there are.  Only payloads with a content in them meet the rules of that content, by an
    equal join, where protocol and ports are tested.
    """
    usable = rules.filter("reason is null and content <> ''").drop("reason")
    p = packets.filter("src_ip is not null and dst_ip is not null and octet_length(payload) > 0").select("ts_ns", "transport", "src_ip", "dst_ip", "src_port", "dst_port", "payload")
    fits = lambda rule, port: F.col(rule).isNull() | (F.col(rule) == F.col(port))
    ports = (fits("r_src_port", "src_port") & fits("r_dst_port", "dst_port")) | (F.col("r_both_ways") & fits("r_src_port", "dst_port") & fits("r_dst_port", "src_port"))
    hit = ((F.col("r_proto") == "ip") | (F.col("r_proto") == F.col("transport"))) & ports
    parts = []
    for block in _blocks(usable, most_contents, most_bytes):
        contents = sorted(r[0] for r in block.select("content").distinct().collect())
        shared = packets.sparkSession.sparkContext.broadcast([(no, bytes.fromhex(c)) for no, c in enumerate(contents)])
        numbers = constant(packets.sparkSession, list(enumerate(contents)), "r_no int, content string")
        named = block.join(numbers, "content").select("r_no", *[F.col(c).alias(f"r_{c}") for c in block.columns])
        seen = p.withColumn("r_no", F.explode(contents_in(F.col("payload"), shared))).drop("payload")
        parts.append(seen.join(named, "r_no").filter(hit))
    first = F.min(F.struct("ts_ns", "r_line", "r_severity", "r_msg", "r_attack", "r_content")).alias("m")
    g = reduce(DataFrame.unionByName, parts).groupBy("r_sid", "src_ip", "dst_ip", "dst_port").agg(first)
    sid = F.concat(F.lit("sid:"), F.col("r_sid").cast("string"))
    size = F.format_string("matched content (%d bytes)", F.expr("length(m.r_content) div 2"))
    score = F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv])[F.col("m.r_severity")]
    return g.select(
        F.lit("rule_match").alias("kind"), F.col("m.r_severity").alias("severity"), score.alias("score"), F.when(F.col("m.r_msg") != "", F.col("m.r_msg")).otherwise(sid).alias("title"), "src_ip", "dst_ip",
        F.col("dst_port").cast("int").alias("dst_port"), F.col("m.r_attack").alias("attack"), F.array(F.concat(F.lit("rule "), sid), size).alias("evidence"),
        F.lit(None).cast("long").alias("first_ns"), F.lit(None).cast("long").alias("last_ns"), F.array().cast("array<string>").alias("victims"),
    )


def folded(findings: DataFrame, hits: DataFrame) -> DataFrame:
    """Incidents of the findings and the rule hits together."""
    return correlate.incidents(findings.select(*COLUMNS).unionByName(hits.select(*COLUMNS)))
