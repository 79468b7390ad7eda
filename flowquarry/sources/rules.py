"""Content rules from text: one row a line, read by column expressions, with the reason where a line is no usable rule.

A rule has a header of seven words (action, protocol, source, source port, direction, target, target port) and options
in brackets.  Usable are rules with exactly one ``content`` and no option that would change how it matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Options that change the match beyond a plain content (beside all that begin with http_).
UNSUPPORTED = "pcre byte_test byte_jump flowbits dsize nocase depth offset distance within flow flags app-layer-protocol".split()
# Options without a value that may stand in a rule.
BARE = "msg content sid metadata reference classtype priority threshold tag rev gid".split()
# Severities of rule classes (all others: medium) and of priorities (all others: low).
CLASS_SEVERITY = {
    "trojan-activity": "high", "attempted-admin": "high", "shellcode-detect": "high", "successful-admin": "high", "successful-dos": "high",
    "successful-recon-largescale": "high", "web-application-attack": "high", "not-suspicious": "low", "policy-violation": "low", "protocol-command-decode": "low",
}
PRIORITY_SEVERITY = {1: "critical", 2: "high", 3: "medium"}

_OPTION = r'(?s)(?:[^;"\\]|\\.|"(?:[^"\\]|\\.)*")+'
_PIECE = r'[^|\\]|\\["\\:|]|\|\s*(?:[0-9A-Fa-f]{2}(?:\s+[0-9A-Fa-f]{2})*)?\s*\|'


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r'(?s)^"(.*)"$', "$1")


def content_hex(content: Column) -> Column:
    """The bytes of a content as hex: plain characters, hex runs between bars, four escapes; null if it has anything else."""
    pieces = F.regexp_extract_all(content, F.lit(f"(?s){_PIECE}"), F.lit(0))
    run = lambda p: F.upper(F.regexp_replace(p, r"[|\s]", ""))
    each = F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("|")), run(p)).when(F.startswith(p, F.lit("\\")), F.hex(F.encode(F.substring(p, 2, 1), "UTF-8"))).otherwise(F.hex(F.encode(p, "UTF-8"))))
    return F.when(content.rlike(f"(?s)^(?:{_PIECE})*$"), F.array_join(each, ""))


def technique_ids(text: Column) -> Column:
    """Technique ids in order: ``T`` with four digits or more and perhaps a part behind a point."""
    return F.regexp_extract_all(text, F.lit(r"T[0-9]{4,}(?:\.[0-9]+)?"), F.lit(0))


def _port(word: Column) -> Column:
    return F.when(word.rlike(r"^\+?[0-9]{1,9}$") & (word.cast("int") <= 65_535), word.cast("int"))


def parsed(lines: DataFrame) -> DataFrame:
    """(line, reason, sid, action, proto, src_port, dst_port, both_ways, content, msg, attack, severity) of ``lines`` (line, text).

    ``reason`` is null for a usable rule; the other columns but ``sid`` are null where it is not.  A null port is any port.
    Empty lines, null ones and comments have no row.
    """
    text = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    out = lines.select("line", text.alias("t")).filter("t is not null and t <> '' and not startswith(t, '#')")
    head = F.trim(F.regexp_extract("t", r"(?s)^([^(]*)\((.*)\)", 1))
    out = out.withColumns({"w": F.split(head, r"\s+"), "o": F.regexp_extract_all(F.regexp_extract("t", r"(?s)^([^(]*)\((.*)\)", 2), F.lit(_OPTION), F.lit(0))})
    given = F.filter(F.transform("o", lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    named = F.transform(given, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).alias("v")))
    out = out.withColumn("o", named)
    of = lambda *names: F.transform(F.filter("o", lambda x: x["k"].isin(*names)), lambda x: x["v"])
    number = lambda v: F.when(v.rlike(r"^\+?[0-9]+$"), v.try_cast("long"))  # noqa: E731  any number that a long holds
    last = lambda a: F.element_at(F.when(F.size(a) > 0, a), -1)

    def fault(x: Column) -> Column:
        odd = x["k"].isin(*UNSUPPORTED) | F.startswith(x["k"], F.lit("http_")) | (~x["k"].isin(*BARE) & (x["v"] == ""))
        return F.when(odd, F.concat(F.lit("unsupported option: "), x["k"])).when((x["k"] == "sid") & number(x["v"]).isNull(), F.concat(F.lit("bad sid: "), x["v"]))

    def weight(x: Column) -> Column:
        listed = F.create_map(*[F.lit(y) for kv in CLASS_SEVERITY.items() for y in kv])[x["v"]]
        level = F.when(x["v"].rlike(r"^\+?[0-9]{1,3}$") & (x["v"].cast("int") < 256), x["v"].cast("int"))
        ranked = F.when(level.isNotNull(), F.coalesce(F.create_map(*[F.lit(y) for kv in PRIORITY_SEVERITY.items() for y in kv])[level], F.lit("low")))
        return F.when(x["k"] == "classtype", F.coalesce(listed, F.lit("medium"))).when(x["k"] == "priority", ranked)

    contents = of("content")
    raw = _unquoted(F.get(contents, F.lit(0)))
    severities = F.filter(F.transform("o", weight), lambda s: s.isNotNull())
    faults = F.filter(F.transform("o", fault), lambda s: s.isNotNull())
    w = lambda i: F.get(F.col("w"), F.lit(i))
    bad_port = lambda i: (w(i) != "any") & _port(w(i)).isNull()
    out = out.withColumns({
        "sid": last(F.transform(of("sid"), number)), "action": w(0), "proto": w(1), "src_port": _port(w(3)), "dst_port": _port(w(6)), "both_ways": w(4) == "<>",
        "content": content_hex(raw), "msg": F.coalesce(_unquoted(last(of("msg"))), F.lit("")), "attack": F.array_distinct(F.flatten(F.transform(of("metadata", "reference"), technique_ids))),
        "severity": F.coalesce(last(severities), F.lit("medium")), "reason": (
            F.when(~F.col("t").rlike(r"(?s)^[^(]*\(.*\)"), "malformed: no options block").when(F.size("w") < 7, "malformed: too few header tokens")
            .when(~w(1).isin("tcp", "udp", "ip"), F.concat(F.lit("unsupported proto: "), w(1))).when(~w(4).isin("->", "<>"), F.concat(F.lit("unsupported direction: "), w(4)))
            .when(bad_port(3), F.concat(F.lit("bad port: "), w(3))).when(bad_port(6), F.concat(F.lit("bad port: "), w(6))).when(F.size(faults) > 0, F.get(faults, F.lit(0)))
            .when(F.size(of("sid")) == 0, "missing sid").when(F.size(contents) == 0, "no content")
            .when(F.size(contents) > 1, F.concat(F.lit("unsupported: not exactly one content (found "), F.size(contents).cast("string"), F.lit(")")))
            .when(content_hex(raw).isNull(), F.concat(F.lit("bad content: "), raw))
        ),
    })
    # A line that is no rule still gives its number, if it has one.
    salvaged = F.regexp_extract("t", r"sid:\s*([0-9]+)", 1)
    sid = F.when(F.col("reason").isNull(), F.col("sid")).otherwise(number(F.when(salvaged != "", salvaged)))
    kept = [F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("action", "proto", "src_port", "dst_port", "both_ways", "content", "msg", "attack", "severity")]
    return out.select("line", "reason", sid.alias("sid"), *kept)
