"""Frames to packets, as column expressions over the bytes: link, network, transport and application fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Link types of captures, EtherTypes and IP protocol numbers.
ETHERNET, RAW, NULL_LOOP, SLL = 1, 101, 0, 113
TAGS, IPV4, IPV6, ARP = (0x8100, 0x88A8), 0x0800, 0x86DD, 0x0806
TRANSPORTS = {6: "tcp", 17: "udp", 132: "sctp", 1: "icmp", 58: "icmpv6"}
# Methods of HTTP requests, and function codes of Modbus that write.
METHODS = "GET POST PUT HEAD DELETE OPTIONS PATCH CONNECT TRACE".split()
MODBUS_WRITES = (5, 6, 15, 16, 22, 23)
MOST_LABELS, MOST_NAME = 128, 255


def _at(data: Column, at: Column | int, size: int) -> Column:
    """Unsigned big-endian number of ``size`` bytes from byte ``at`` (0 is the first); null beyond the end."""
    at = at if isinstance(at, Column) else F.lit(at)
    inside = F.octet_length(data) >= at + size
    return F.when(inside, F.conv(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(size))), 16, 10).cast("long"))


def _hex(data: Column, at: Column, size: int) -> Column:
    return F.lower(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(size))))


def _dotted(data: Column, at: Column) -> Column:
    return F.concat_ws(".", *[_at(data, at + i, 1).cast("string") for i in range(4)])


def _mac(data: Column, at: Column) -> Column:
    return F.concat_ws(":", *[_hex(data, at + i, 1) for i in range(6)])


def v6_text(groups: Column) -> Column:
    """Address text of eight 4-digit hex groups: leading zeros dropped, the first longest run of zero groups as ``::``."""
    joined = F.concat_ws(":", F.transform(groups, lambda g: F.regexp_replace(g, "^0{1,3}", "")))
    out = joined
    for n in range(2, 9):  # the longest run wins, so shorter ones are tried first and overwritten
        run = ":".join(["0"] * n)
        pattern = rf"(?:^|(?<=:)){run}(?=:|$)"
        cut = F.regexp_replace(F.regexp_replace(joined, f"^(.*?){pattern}", "$1:"), ":{2,}", "::")
        cut = F.when(F.startswith(cut, F.lit(":")) & ~F.startswith(cut, F.lit("::")), F.concat(F.lit(":"), cut)).otherwise(cut)
        cut = F.when(F.endswith(cut, F.lit(":")) & ~F.endswith(cut, F.lit("::")), F.concat(cut, F.lit(":"))).otherwise(cut)
        out = F.when(joined.rlike(pattern), cut).otherwise(out)
    return out


def layers(frames: DataFrame) -> DataFrame:
    """Adds l3, transport, src_ip, dst_ip, src_port, dst_port, tcp_flags, ttl, payload, icmp_type, arp_ip and arp_mac.

    Up to two VLAN tags are skipped.  Later fragments have ports 0 and no payload; frames that end early keep what they have.
    """
    f = F.col("frame")
    start = F.when(F.col("link") == ETHERNET, 14).when(F.col("link") == SLL, 16).when(F.col("link") == NULL_LOOP, 4).otherwise(0)
    kind = F.when(F.col("link") == ETHERNET, _at(f, 12, 2)).when(F.col("link") == SLL, _at(f, 14, 2))
    out = frames.withColumns({"o_": start, "et_": kind})
    for _ in range(2):
        tagged = F.col("et_").isin(*TAGS) & (F.col("link") == ETHERNET)
        out = out.withColumns({"et_": F.when(tagged, _at(f, F.col("o_") + 2, 2)).otherwise(F.col("et_")), "o_": F.when(tagged, F.col("o_") + 4).otherwise(F.col("o_"))})
    o = F.col("o_")
    version = F.shiftright(_at(f, o, 1), 4)
    bare = F.col("et_").isNull()
    out = out.withColumn("l3", F.when((F.col("et_") == ARP), "arp").when(((F.col("et_") == IPV4) | bare) & (version == 4), "ipv4").when(((F.col("et_") == IPV6) | bare) & (version == 6), "ipv6"))
    v4, v6, arp = (F.col("l3") == x for x in ("ipv4", "ipv6", "arp"))
    head = _at(f, o, 1).bitwiseAND(F.lit(15)) * 4
    groups = lambda at: F.array(*[_hex(f, at + 2 * i, 2) for i in range(8)])
    proto = F.when(v4, _at(f, o + 9, 1)).when(v6, _at(f, o + 6, 1))
    out = out.withColumns({
        "transport": reduce(lambda c, kv: c.when(proto == kv[0], kv[1]), TRANSPORTS.items(), F.when(F.lit(False), "")),
        "src_ip": F.when(v4, _dotted(f, o + 12)).when(v6, v6_text(groups(o + 8))),
        "dst_ip": F.when(v4, _dotted(f, o + 16)).when(v6, v6_text(groups(o + 24))),
        "ttl": F.when(v4, _at(f, o + 8, 1)).when(v6, _at(f, o + 7, 1)).cast("int"),
        "later_": F.coalesce(v4 & (_at(f, o + 6, 2).bitwiseAND(F.lit(0x1FFF)) > 0), F.lit(False)),
        "t_": F.when(v4, o + head).when(v6, o + 40).cast("int"),
        "end_": F.when(v4, o + _at(f, o + 2, 2)).when(v6, o + 40 + _at(f, o + 4, 2)).cast("int"),
        "arp_ip": F.when(arp, _dotted(f, o + 14)),
        "arp_mac": F.when(arp, _mac(f, o + 8)),
    })
    t, later = F.col("t_"), F.col("later_")
    ported = F.col("transport").isin("tcp", "udp", "sctp")
    port = lambda at: F.when(ported & later, 0).when(ported, _at(f, t + at, 2)).when(F.col("transport").isNotNull(), 0).cast("int")
    tcp = F.col("transport") == "tcp"
    size = F.when(tcp, F.shiftright(_at(f, t + 12, 1), 4) * 4).when(F.col("transport") == "udp", 8).when(F.col("transport") == "sctp", 12).otherwise(0)
    body = (F.least(F.col("end_"), F.octet_length(f)) - t - size).cast("int")
    return out.withColumns({
        "src_port": port(0), "dst_port": port(2), "tcp_flags": F.when(tcp & ~later, _at(f, t + 13, 1)).cast("int"),
        "icmp_type": F.when(F.col("transport").isin("icmp", "icmpv6") & ~later, _at(f, t, 1)).cast("int"),
        "payload": F.when(F.col("transport").isNotNull() & ~later & (body > 0), F.substring(f, (t + size + 1).cast("int"), body)),
    }).drop("o_", "et_", "later_", "t_", "end_")


def text_of(payload: Column) -> Column:
    """The bytes as characters of the same numbers."""
    return F.decode(payload, "ISO-8859-1")


def is_text(payload: Column) -> Column:
    """At most a tenth of the first 64 bytes are controls below the blank other than tab, line feed and carriage return; nothing is no text."""
    start = text_of(F.substring(payload, 1, 64))
    return (F.length(start) > 0) & (F.length(F.regexp_replace(start, r"[^\x00-\x08\x0b\x0c\x0e-\x1f]", "")) * 10 <= F.length(start))


def http_method(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"^({'|'.join(METHODS)}) ", 1), F.lit(""))


def http_header(text: Column, name: str) -> Column:
    """Value of a header in the header block, at most 256 printable characters."""
    block = F.concat(F.lit("\n"), F.regexp_extract(text, r"(?s)^(.*?)(?:\r?\n\r?\n|$)", 1))
    return F.nullif(F.rtrim(F.regexp_extract(block, rf"(?i)\n{name}:[ \t]*([\x20-\x7e]{{1,256}})", 1)), F.lit(""))


def http_auth(text: Column) -> Column:
    """Scheme of an Authorization or Proxy-Authorization header."""
    value = F.lower(F.coalesce(http_header(text, "Authorization"), http_header(text, "Proxy-Authorization")))
    return F.when(F.startswith(value, F.lit("basic")), "HTTP Basic").when(F.startswith(value, F.lit("digest")), "HTTP Digest")


def cleartext_credential(text: Column, dst_port: Column, transport: Column) -> Column:
    """Log-in over FTP, or the scheme of an HTTP request's authorization, within the first 1,024 bytes of a TCP payload."""
    start = F.substring(text, 1, 1024)
    ftp = (dst_port == 21) & start.rlike(r"(?i)^(USER|PASS) ")
    return F.when(transport == "tcp", F.when(ftp, "FTP").when(http_method(text).isNotNull(), http_auth(start)))


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right counts double, its digits summed."""
    ds = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(F.transform(ds, lambda d: F.when(d > 9, d - 9).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10 == 0


# Numbers of digits and first digits of payment cards, and how many bytes before a number its name may stand.
ISSUERS = r"^(?:4(?:\d{12}|\d{15}|\d{18})|3[47]\d{13}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|6(?:011|5\d\d)\d{12})$"
WINDOW = 40


def card_number(text: Column) -> Column:
    """Whether the text has a payment card number: a run of up to 19 digits with single separators, of a known issuer, with a right check digit, a keyword within the bytes before."""
    run = r"\d(?:[ -]?\d){0,18}"
    pairs = F.arrays_zip(F.split(text, run, -1).alias("gap"), F.regexp_extract_all(text, F.lit(f"({run})"), 1).alias("run"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,digits:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = (acc["at"] + F.length(x["gap"])).cast("int")
        here = F.struct(at.alias("at"), F.regexp_replace(x["run"], "[ -]", "").alias("digits"))
        return F.struct((at + F.coalesce(F.length(x["run"]), F.lit(0))).cast("int").alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    runs = F.aggregate(pairs, start, step)["out"]
    before = lambda at: F.substring(text, F.greatest(F.lit(1), at - WINDOW + 1), F.least(at, F.lit(WINDOW)))
    card = lambda r: r["digits"].rlike(ISSUERS) & before(r["at"]).rlike("(?i)card|pan|credit") & F.when(r["digits"].rlike(ISSUERS), _luhn(r["digits"]))
    return F.when(text.rlike("(?i)card|pan|credit"), F.coalesce(F.exists(runs, card), F.lit(False))).otherwise(False)


def social_number(text: Column) -> Column:
    """Whether the text has a social security number that can exist, a keyword within the bytes before."""
    named = rf"(?:(?<=ssn[\s\S]{{0,{WINDOW - 3}}})|(?<=social[\s\S]{{0,{WINDOW - 6}}}))"
    return F.coalesce(text.rlike(rf"(?i){named}(?<!\d)(?!000|666|9\d\d)\d{{3}}-(?!00)\d{{2}}-(?!0000)\d{{4}}(?!\d)"), F.lit(False))


def stratum_role(text: Column, transport: Column) -> Column:
    """Role in a mining session by a method named in the first 512 bytes of a TCP payload, in any case."""
    start = F.lower(F.substring(text, 1, 512))
    role = F.when(start.rlike(r"mining\.(subscribe|authorize|submit)"), "miner").when(start.rlike(r"mining\.(notify|set_difficulty)"), "pool")
    return F.when(transport == "tcp", role)


def dns_question(payload: Column) -> Column:
    """First question's name; null for a pointer, over 128 labels or 255 characters, or a cut."""
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(12).alias("at"), F.array().cast("array<string>").alias("labels"), F.lit("on").alias("state"))

    def step(acc: Column, _: Column) -> Column:
        n = _at(payload, acc["at"], 1)
        stop = F.when(n == 0, "end").when(n.isNull() | (n > 63) | (F.octet_length(payload) < acc["at"] + 1 + n), "bad").otherwise("on")
        label = text_of(F.substring(payload, (acc["at"] + 2).cast("int"), n.cast("int")))
        moved = F.struct((acc["at"] + 1 + n).cast("int").alias("at"), F.concat(acc["labels"], F.array(label)).alias("labels"), F.lit("on").alias("state"))
        ended = F.struct(acc["at"].alias("at"), acc["labels"].alias("labels"), stop.alias("state"))
        return F.when(acc["state"] != "on", acc).when(stop == "on", moved).otherwise(ended)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_LABELS + 1)), start, step)
    name = F.array_join(walked["labels"], ".")
    ok = (_at(payload, 4, 2) >= 1) & (walked["state"] == "end") & (F.size(walked["labels"]) > 0) & (F.length(name) <= MOST_NAME)
    return F.when(ok, name).otherwise(none)


def modbus_write(payload: Column, dst_port: Column) -> Column:
    """Function code of a Modbus command that writes."""
    code = _at(payload, 7, 1)
    return F.when((dst_port == 502) & (_at(payload, 2, 2) == 0) & code.isin(*MODBUS_WRITES), code).cast("int")


def file_class(body: Column) -> Column:
    """Class of a file by its first bytes, of which there must be two; a program that begins with two letters must look binary."""
    start = F.hex(F.substring(body, 1, 8))
    is_ = lambda *heads: reduce(lambda a, b: a | b, [F.startswith(start, F.lit(h)) for h in heads])
    binary = text_of(F.substring(body, 1, 16)).rlike(r"[\x00-\x08\x0e-\x1f]")
    program = is_("7F454C46", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE") | (is_("4D5A") & binary)
    archive = is_("504B0304", "504B0506", "526172211A07", "377ABCAF271C", "1F8B", "FD377A585A00", "425A68")
    found = F.when(program, "executable").when(is_("2321"), "script").when(is_("4D534346", "213C617263683E"), "installer").when(archive, "archive")
    return F.when(F.octet_length(body) >= 2, found)


def l7_hint(payload: Column, transport: Column, src_port: Column, dst_port: Column) -> Column:
    """Application protocol: a TLS client hello and an HTTP request by their first bytes over TCP, QUIC over UDP, Modbus, DNS by port over either."""
    text = text_of(payload)
    tcp, udp = transport == "tcp", transport == "udp"
    on = lambda p: (src_port == p) | (dst_port == p)
    tls = tcp & (_at(payload, 0, 1) == 22) & (_at(payload, 5, 1) == 1)
    http = tcp & http_method(text).isNotNull()
    quic = udp & (_at(payload, 0, 1) >= 0xC0) & _at(payload, 1, 4).isin(1, 0x6B3343CF)
    modbus = tcp & on(502) & (_at(payload, 2, 2) == 0) & (F.octet_length(payload) >= 8)
    return F.when(tls, "tls").when(http, "http").when(quic, "quic").when(modbus, "modbus").when((udp | tcp) & on(53), "dns")
