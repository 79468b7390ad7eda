"""Findings to incidents, attack chains and campaigns; comparisons between captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.net import name_suffixes, rank, severity_at, v4_number
from flowquarry.functions.order import checkpointed
from flowquarry.schema import HANDOFF, SEVERITIES, STAGE, STAGE_NAMES

SKEW_NS, WINDOW_NS = 1_000_000_000, 3_600_000_000_000
INFRA_DEGREE = (2, 12)


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def stage(kind: Column) -> Column:
    return F.coalesce(_lookup(STAGE, kind), F.lit(4))


def incidents(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Findings per source host.  Two kinds or more raise the severity by a band and the score by 15."""
    f = findings.withColumn("stage", stage(F.col("kind")))
    g = f.groupBy(*(by or []), F.col("src_ip").alias("host")).agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("kind").alias("kinds"), F.max("score").alias("top"), F.max(rank(F.col("severity"))).alias("worst"),
        F.array_sort(F.collect_set("stage")).alias("stages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("attack")))).alias("attack"), F.array_sort(F.collect_set(F.struct("stage", "kind"))).alias("steps"),
        F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"),
    )
    many = F.col("kinds") >= 2
    names = F.array(*map(F.lit, STAGE_NAMES))
    story = F.concat(F.col("host"), F.lit(": "), F.array_join(F.transform("steps", lambda s: F.replace(s["kind"], F.lit("_"), F.lit(" "))), ", then "))
    return g.select(*(by or []), "host", severity_at(F.col("worst") + F.when(many, 1).otherwise(0)).alias("severity"), F.least(F.lit(100), F.col("top") + F.when(many, 15).otherwise(0)).alias("score"), "findings", "kinds", F.transform("stages", lambda i: F.get(names, i)).alias("stages"), "attack", story.alias("narrative"), "first_ns", "last_ns")


def progressions(findings: DataFrame, most: int = 64) -> DataFrame:
    """Steps of each host in order of time, stage and score."""
    f = findings.withColumn("stage", stage(F.col("kind"))).withColumn("t_", F.coalesce("first_ns", F.lit((1 << 63) - 1)))
    order = Window.partitionBy("src_ip").orderBy("t_", "stage", F.desc("score"), "kind", "dst_ip", "dst_port")
    return f.withColumn("step", F.row_number().over(order)).filter(F.col("step") <= most).drop("t_")


def pivot_edges(findings: DataFrame) -> DataFrame:
    """(from_host, to_host, kind, weight, dwell_ns): a victim of one finding that begins to act within an hour after it.

    What counts is the first of all times at which the victim acts: a host that acted long before was no victim.  Where
    the finding or all acts of the victim lack a time, the order is unknown and the edge stays, without a dwell.
    """
    w = _lookup(HANDOFF, F.col("kind"))
    direct = F.col("kind").isin("brute_force", "exposed_remote_access", "port_scan")
    spread = F.col("kind").isin("lateral_movement", "host_sweep")
    gone = F.array().cast("array<string>")
    victims = F.when(direct & F.col("dst_ip").isNotNull(), F.array("dst_ip")).when(spread, F.col("victims")).otherwise(gone)
    a = findings.select(F.col("src_ip").alias("from_host"), "kind", w.alias("weight"), F.col("first_ns").alias("a_ns"), F.explode(victims).alias("to_host")).filter("from_host <> to_host")
    b = findings.groupBy(F.col("src_ip").alias("to_host")).agg(F.min("first_ns").alias("start_ns"))
    gap = F.col("start_ns") - F.col("a_ns")
    j = a.join(b, "to_host").filter(gap.isNull() | gap.between(-SKEW_NS, WINDOW_NS))
    return j.select("from_host", "to_host", "kind", "weight", F.abs(gap).alias("dwell_ns"))


def parents(edges: DataFrame) -> DataFrame:
    """One edge into each host, so that the edges are a forest: the heaviest, then the quickest, then by name, that closes no cycle.

    The hosts choose in the order of their names.  All take their best edge at first; of the hosts on a cycle the last
    one to choose would have seen it closed, so it alone goes on to its next edge, until no cycle is left.
    """
    order = Window.partitionBy("to_host").orderBy(F.desc("weight"), F.asc_nulls_last("dwell_ns"), "from_host", "kind")
    # Edges of one pair of hosts beyond the best close the same cycles.
    pair = Window.partitionBy("to_host", "from_host").orderBy(F.desc("weight"), F.asc_nulls_last("dwell_ns"), "kind")
    single = edges.withColumn("i", F.row_number().over(pair)).filter("i = 1").drop("i")
    # A host that no edge leaves, or none enters, is on no cycle.
    ranked = checkpointed(single.withColumn("i", F.row_number().over(order)))
    at = checkpointed(ranked.select("to_host").distinct().withColumn("i", F.lit(1)))
    while True:
        chosen = checkpointed(ranked.join(at, ["to_host", "i"]))
        last = _last_of_cycles(chosen)
        if not last.limit(1).count():
            return chosen.drop("i").select(*edges.columns)
        at = checkpointed(at.join(last.select("to_host", F.lit(1).alias("next_")), "to_host", "left").select("to_host", (F.col("i") + F.coalesce("next_", F.lit(0))).alias("i")))


def _last_of_cycles(chosen: DataFrame) -> DataFrame:
    """(to_host): the host of the greatest name on each cycle of (from_host, to_host), which has at most one edge into a host.

    Walks up the edges double in length each turn.  A walk that has made as many steps as there are edges stands on a
    cycle, and what it has met since is that cycle's.
    """
    walk = chosen.select(F.col("to_host").alias("host"), F.col("from_host").alias("up"), F.col("from_host").alias("most"))
    walk = checkpointed(walk.join(walk.select(F.col("host").alias("up")), "up", "left_semi"))
    hosts, hops = walk.count(), 1
    while hops <= hosts:
        b = walk.select(F.col("host").alias("up"), F.col("up").alias("far"), F.col("most").alias("most_b"))
        # Walks that end at a root go.
        walk = checkpointed(walk.join(b, "up").select("host", F.col("far").alias("up"), F.greatest("most", "most_b").alias("most")))
        if not walk.limit(1).count():
            break
        hops *= 2
    # The cycle is where walks of this length end; there a walk of one round meets all of it.
    ends = walk.select(F.col("up").alias("host")).distinct()
    return walk.join(ends, "host", "left_semi").filter(F.col("host") == F.col("most")).select(F.col("host").alias("to_host"))


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (a, b) reaches."""
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    state = checkpointed(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    for _ in range(rounds):
        low = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        new = state.join(low, "node").select("node", F.least("root", "low").alias("root"), (F.col("low") < F.col("root")).alias("moved"))
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = checkpointed(new.join(jump, "root").select("node", F.least("root", "far").alias("root"), "moved"))
        if not new.filter("moved").limit(1).count():
            return new.select("node", "root")
        state = new.select("node", "root")
    raise RuntimeError("components did not settle")


def _fnv1a64(values):
    import pandas as pd

    def one(text: str) -> str:
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"chain:{h:016x}"

    return pd.Series([one(v) for v in values])


def chains(findings: DataFrame) -> DataFrame:
    """Attack chains: hosts joined by parent edges, with severity, score, confidence and a stable id."""
    edges = checkpointed(parents(pivot_edges(findings)))
    hosts = findings.select(F.col("src_ip").alias("node")).distinct()
    roots = components(edges.select(F.col("from_host").alias("a"), F.col("to_host").alias("b")))
    member = hosts.join(roots, "node", "full_outer").withColumn("root", F.coalesce("root", "node"))
    f = findings.withColumn("stage", stage(F.col("kind"))).join(member.select(F.col("node").alias("src_ip"), "root"), "src_ip")
    g = f.groupBy("root").agg(F.max("score").alias("top"), F.max(rank(F.col("severity"))).alias("worst"), F.count_distinct("stage").alias("tactics"), F.count(F.lit(1)).alias("steps"), F.bool_or(F.col("first_ns").isNull()).alias("untimed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("attack")))).alias("attack"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))
    h = member.groupBy("root").agg(F.array_sort(F.collect_set("node")).alias("hosts"))
    e = edges.join(member.select(F.col("node").alias("to_host"), "root"), "to_host").groupBy("root").agg(F.count(F.lit(1)).alias("pivots"), F.bool_or(F.col("weight") > 30).alias("strong"), F.bool_and(F.col("dwell_ns").isNotNull()).alias("timed"))
    out = g.join(h, "root").join(e, "root", "left").na.fill({"pivots": 0}).filter((F.col("pivots") > 0) | (F.col("tactics") >= 2))
    n, t = F.size("hosts"), F.col("tactics")
    band = F.col("worst") + F.when(t >= 2, 1).otherwise(0) + F.when(n >= 2, 1).otherwise(0)
    points = lambda on, v: F.when(on, v).otherwise(0)
    confidence = F.lit(40) + 10 * F.least(t, F.lit(4)) + points(F.col("strong"), 15) + points(F.col("timed"), 10) + 5 * F.least(F.lit(3), n - 1) - points(F.col("untimed"), 20) - points((F.col("pivots") > 0) & ~F.col("strong"), 10)
    ident = F.pandas_udf(_fnv1a64, "string")(F.array_join("hosts", ","))
    return out.select(ident.alias("chain_id"), "root", F.concat_ws(",", "hosts").alias("hosts"), severity_at(band).alias("severity"), F.least(F.lit(100), F.col("top") + 10 * F.least(t - 1, F.lit(2)) + 10 * F.least(n - 1, F.lit(1))).alias("score"), F.greatest(F.lit(0), F.least(F.lit(100), confidence)).alias("confidence"), "tactics", "steps", "pivots", F.concat_ws(",", "attack").alias("attack"), "first_ns", "last_ns")


def campaigns(findings: DataFrame, chain_table: DataFrame) -> DataFrame:
    """(chain_id, campaign): chains that share an outside endpoint which few other hosts use."""
    member = chain_table.select("chain_id", F.explode(F.split("hosts", ",")).alias("src_ip"))
    infra = findings.filter(F.col("kind").isin("beacon", "tls_cert_health") & F.col("dst_ip").isNotNull()).select("src_ip", "dst_ip").distinct()
    few = infra.groupBy("dst_ip").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(*INFRA_DEGREE)).select("dst_ip")
    use = infra.join(few, "dst_ip", "left_semi").join(member, "src_ip").select("chain_id", "dst_ip").distinct()
    found = components(use.select(F.col("chain_id").alias("a"), F.concat(F.lit("~"), "dst_ip").alias("b")))
    return chain_table.select("chain_id").join(found.select(F.col("node").alias("chain_id"), "root"), "chain_id", "left").select("chain_id", F.coalesce("root", "chain_id").alias("campaign"))


def diff(before: DataFrame, after: DataFrame, key: str, *values: str) -> DataFrame:
    """Full outer comparison by key: added, removed, changed or same."""
    a = before.select(F.col(key).alias("k_"), *[F.col(v).alias(f"{v}_before") for v in values], F.lit(True).alias("in_a"))
    b = after.select(F.col(key), *[F.col(v).alias(f"{v}_after") for v in values], F.lit(True).alias("in_b"))
    j = a.join(b, F.col("k_") == F.col(key), "full_outer")
    same = F.lit(True)
    for v in values:
        same &= F.col(f"{v}_before").eqNullSafe(F.col(f"{v}_after"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(same, "same").otherwise("changed")
    return j.select(F.coalesce(key, "k_").alias(key), change.alias("change"), *[c for v in values for c in (f"{v}_before", f"{v}_after")])


def local_hosts(arp: DataFrame, dhcp: DataFrame, vendors: DataFrame | None = None) -> DataFrame:
    out = arp.select("ip", "mac").join(dhcp.select("mac", "hostname", "vendor"), "mac", "full_outer")
    return out if vendors is None else out.join(F.broadcast(vendors), F.upper(F.substring("mac", 1, 8)) == F.col("oui"), "left").drop("oui")


def capture_verdict(incident_table: DataFrame, findings: DataFrame) -> DataFrame:
    """Per capture: worst severity (of incidents, else of findings), how many have it, and the sum of ranks."""
    i, f = (t.select("capture_id", rank(F.col("severity")).alias("r"), F.lit(n).alias("src")) for t, n in ((incident_table, 0), (findings, 1)))
    both = i.unionByName(f)
    first = both.groupBy("capture_id").agg(F.min("src").alias("use"))
    j = both.join(first, "capture_id").filter("src = use")
    w = j.groupBy("capture_id").agg(F.max("r").alias("worst"), F.sum("r").alias("rank_sum"))
    n = j.groupBy("capture_id", "r").agg(F.count(F.lit(1)).alias("n"))
    return w.join(n.withColumnRenamed("r", "worst"), ["capture_id", "worst"]).select("capture_id", severity_at(F.col("worst")).alias("severity"), F.col("n").alias("at_worst"), "rank_sum")


def case_rank(captures: DataFrame) -> DataFrame:
    """``captures``: (path, ok, severity, findings)."""
    return captures.orderBy(F.desc("ok"), F.desc(rank(F.col("severity"))), F.desc("findings"), "path")


def shared_indicators(index: DataFrame) -> DataFrame:
    """``index``: (capture_id, kind, value, severity): indicators of two captures or more."""
    g = index.groupBy("kind", "value").agg(F.array_sort(F.collect_set("capture_id")).alias("captures"), F.max(rank(F.col("severity"))).alias("worst"))
    return g.filter(F.size("captures") >= 2).select("kind", "value", F.size("captures").alias("n"), F.concat_ws(",", F.transform("captures", lambda c: c.cast("string"))).alias("captures"), severity_at(F.col("worst")).alias("severity"))


def capture_index(flows: DataFrame) -> DataFrame:
    """(kind, value, flagged): distinct indicators of a capture."""
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("ip", "lo_ip"), ("ip", "hi_ip"), ("domain", "sni"), ("ja3", "ja3"), ("ja4", "ja4"))])
    return flows.select("ioc", F.inline(rows)).filter("value is not null").groupBy("kind", "value").agg(F.bool_or("ioc").alias("flagged"))


def rescan(index: DataFrame, feed: DataFrame) -> DataFrame:
    """Index entries that an updated feed flags: newly, or still."""
    of = lambda k: feed.filter(F.col("kind") == k)
    exact = index.withColumn("v", F.lower("value")).join(feed.select("kind", F.lower("value").alias("v")).distinct(), ["kind", "v"], "left_semi").select("kind", "value")
    parent = index.filter("kind = 'domain'").withColumn("v", F.explode(name_suffixes(F.col("value")))).join(of("suffix").select(F.lower("value").alias("v")), "v", "left_semi").select("kind", "value")
    cidr = of("cidr").select(F.split("value", "/").alias("p")).select(v4_number(F.get("p", F.lit(0))).alias("net"), F.get("p", F.lit(1)).cast("int").alias("bits"))
    shifted = lambda n: F.call_function("shiftright", n, (F.lit(32) - F.col("bits")).cast("int"))
    ips = index.filter("kind = 'ip'").withColumn("n", v4_number(F.col("value"))).filter("n is not null")
    block = ips.join(F.broadcast(cidr.select("bits").distinct()), F.lit(True)).withColumn("m", shifted(F.col("n"))).join(cidr.select("bits", shifted(F.col("net")).alias("m")).distinct(), ["bits", "m"], "left_semi").select("kind", "value")
    hits = exact.union(parent).union(block).distinct()
    return index.join(hits, ["kind", "value"], "left_semi").select("kind", "value", F.when(F.col("flagged"), "still").otherwise("newly").alias("state"))


def workspace(captures: DataFrame, hosts: DataFrame, findings: DataFrame) -> DataFrame:
    """Figures across captures.  ``captures``: (capture_id, flows, bytes); ``hosts``: (capture_id, ip)."""
    c = captures.agg(F.count(F.lit(1)).alias("captures"), F.sum("flows").alias("flows"), F.sum("bytes").alias("bytes"))
    h = hosts.agg(F.count_distinct("ip").alias("hosts"))
    f = findings.agg(F.count_if(F.col("severity").isin("critical", "high")).alias("serious"))
    kinds = findings.groupBy("kind").agg(F.count_distinct("capture_id").alias("n")).agg(F.concat_ws(",", F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind")))["kind"], 1, 4)).alias("top_kinds"))
    return c.join(F.broadcast(h)).join(F.broadcast(f)).join(F.broadcast(kinds))


def trend(findings: DataFrame, last: int = 8) -> DataFrame:
    """Serious findings of the last captures, and whether they rise."""
    per = findings.groupBy("capture_id").agg(F.count_if(F.col("severity").isin("critical", "high")).alias("serious"))
    w = Window.orderBy(F.desc("capture_id"))
    tail = per.orderBy(F.desc("capture_id")).limit(last).withColumn("i", F.row_number().over(w))
    whole = Window.orderBy("capture_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return tail.select("capture_id", "serious", (F.last("serious").over(whole) > F.first("serious").over(whole)).alias("rising"))


def unreviewed(incident_table: DataFrame, triage: DataFrame) -> DataFrame:
    """Serious incident hosts without a triage note, per capture."""
    left = incident_table.filter(F.col("severity").isin("critical", "high")).join(triage.select("capture_id", "host").distinct(), ["capture_id", "host"], "left_anti")
    return left.groupBy("capture_id").agg(F.count(F.lit(1)).alias("hosts")).orderBy(F.desc("hosts"), "capture_id")


def with_file_verdicts(files: DataFrame, verdicts: DataFrame) -> DataFrame:
    return files.join(verdicts.select("sha256", "verdict"), "sha256", "left")


def severity_order(severity: Column) -> Column:
    """Worst first."""
    return F.array_position(F.array(*[F.lit(s) for s in reversed(SEVERITIES)]), severity)
