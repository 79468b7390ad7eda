"""Queries of readers and decoders: the packets are written as frames and capture files, read back and compared with themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.operators import decode as D
from flowquarry.plans.queries import Capture, query
from flowquarry.sources import capture

FILE_FRAMES = 500


def _be(x: Column | int, size: int) -> Column:
    """Big-endian hex of a number."""
    x = x if isinstance(x, Column) else F.lit(x)
    return F.lpad(F.hex(x.cast("long")), 2 * size, "0")


def _le(x: Column | int, size: int) -> Column:
    h = _be(x, size)
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])


def _text(x: Column) -> Column:
    return F.hex(F.encode(x, "ISO-8859-1"))


def _payload() -> Column:
    host, agent = F.concat(F.lit("Host: "), F.col("http_host"), F.lit("\r\n")), F.concat(F.lit("User-Agent: "), F.col("http_ua"), F.lit("\r\n"))
    auth = F.when(F.col("cleartext_cred") == "HTTP Basic", "authorization:  Basic dTpw\r\n").otherwise("")
    body = F.when(F.col("pii") == "card", "id=9 card: 4111 1111-1111 1111;").when(F.col("pii") == "ssn", "Social no. 123-45-6789").when(F.col("idx") % 3 == 0, "card 4111 1111 1111 1112, ssn 666-45-6789").otherwise("a=1\r\nHost: other")
    labels = F.array_join(F.transform(F.split("dns_qname", r"\."), lambda x: F.concat(_be(F.length(x), 1), _text(x))), "")
    code = F.regexp_extract("ot_control", r"(\d+)", 1).cast("int")
    return (
        F.when(F.col("stratum") == "miner", _text(F.lit('{"id": 1, "method": "mining.submit"}'))).when(F.col("stratum") == "pool", _text(F.lit('{"method":"mining.notify", "id": null}')))
        .when(F.col("cleartext_cred") == "FTP", _text(F.lit("USER bob\r\n")))
        .when(F.col("http_host").isNotNull(), _text(F.concat(F.lit("GET /x HTTP/1.1\r\n"), host, agent, auth, F.lit("\r\n"), body)))
        .when(F.col("download").isNotNull(), F.concat(_text(F.lit("HTTP/1.1 200 OK\r\nServer: x\r\n\r\n")), F.when(F.col("download") == "executable", F.lit("4D5A9000")).otherwise(F.lit("504B0304"))))
        .when(F.col("dns_qname").isNotNull(), F.concat(F.lit("123401000001000000000000"), labels, F.lit("0000010001")))
        .when(F.col("ot_control").isNotNull(), F.concat(F.lit("00010000000601"), _be(code, 1), F.lit("0000FF00")))
        .when((F.col("app_proto") == "tls") & (F.col("transport") == "tcp"), F.lit("160303000401000000")).otherwise(F.lit(""))
    )


def frames(packets: DataFrame, payload: Column | None = None) -> DataFrame:
    """(idx, link, frame) beside the packets' columns: Ethernet, every seventh frame with a VLAN tag, every eleventh with two, every thirteenth bare IP.

    ``payload``: hexadecimal text, by default made from the packets' columns.
    """
    four = lambda ip: F.array_join(F.transform(F.split(ip, r"\."), lambda x: _be(x.cast("int"), 1)), "")
    pay = _payload() if payload is None else payload
    size = F.length("pay") / 2
    tcp = F.concat(_be(F.col("src_port"), 2), _be(F.col("dst_port"), 2), F.lit("0000000100000002"), F.lit("50"), _be(F.coalesce("tcp_flags", F.lit(0)), 1), F.lit("200000000000"), F.col("pay"))
    udp = F.concat(_be(F.col("src_port"), 2), _be(F.col("dst_port"), 2), _be(size + 8, 2), F.lit("0000"), F.col("pay"))
    icmp = F.concat(_be(F.coalesce("icmp_type", F.lit(0)), 1), F.lit("00000000000000"), F.col("pay"))
    inner = F.when(F.col("transport") == "tcp", tcp).when(F.col("transport") == "udp", udp).otherwise(icmp)
    number = F.when(F.col("transport") == "tcp", 6).when(F.col("transport") == "udp", 17).otherwise(1)
    ip = F.concat(F.lit("4500"), _be(F.length("inner") / 2 + 20, 2), F.lit("0001"), F.lit("4000"), _be(F.col("ttl"), 1), _be(number, 1), F.lit("0000"), four(F.col("src_ip")), four(F.col("dst_ip")), F.col("inner"))
    arp = F.concat(F.lit("0001080006040002"), F.replace("arp_mac", F.lit(":"), F.lit("")), four(F.col("arp_ip")), F.lit("0000000000000A000001"))
    is_arp = F.col("arp_ip").isNotNull()
    bare = ~is_arp & (F.col("idx") % 13 == 0)
    tags = F.when(F.col("idx") % 11 == 0, "88A8006481000065").when(F.col("idx") % 7 == 0, "81000064").otherwise("")
    link = F.concat(F.lit("020000000001020000000002"), tags, F.when(is_arp, "0806").otherwise("0800"))
    out = packets.withColumn("pay", pay).withColumn("inner", inner).withColumn("net", F.when(is_arp, arp).otherwise(ip))
    # Padding of short Ethernet frames is no payload.
    hexed = F.when(bare, F.col("net")).otherwise(F.rpad(F.concat(link, F.col("net")), F.greatest(F.lit(120), F.length(link) + F.length("net")), "0"))
    return out.select("*", F.when(bare, D.RAW).otherwise(D.ETHERNET).alias("link"), F.unhex(hexed).alias("frame")).drop("pay", "inner", "net")


def files(packets: DataFrame, kind: str) -> DataFrame:
    """(path, content): capture files of ``FILE_FRAMES`` frames each, all of one link type, as the format has one for a file."""
    f = frames(packets).withColumn("size", F.octet_length("frame"))
    ns = F.col("ts_ns")
    second, rest = F.expr("ts_ns div 1000000000"), ns % 1_000_000_000
    if kind == "pcapng":
        start = F.concat(F.lit("0A0D0D0A1C0000004D3C2B1A01000000FFFFFFFFFFFFFFFF1C000000"), F.lit("0100000020000000"), _le(F.col("link"), 2), F.lit("0000"), F.lit("00000400"), F.lit("0900010009000000"), F.lit("00000000"), F.lit("20000000"))
        padded = F.rpad(F.hex("frame"), (F.ceil(F.col("size") / 4) * 8).cast("int"), "0")
        total = F.ceil(F.col("size") / 4) * 4 + 32
        rec = F.concat(F.lit("06000000"), _le(total, 4), F.lit("00000000"), _le(F.shiftright(ns, 32), 4), _le(ns.bitwiseAND(F.lit(0xFFFFFFFF)), 4), _le(F.col("size"), 4), _le(F.col("wire_len"), 4), padded, _le(total, 4))
    elif kind == "big":  # the other byte order, nanoseconds
        start = F.concat(F.lit("A1B23C4D00020004"), F.lit("0000000000000000"), F.lit("00040000"), _be(F.col("link"), 4))
        rec = F.concat(_be(second, 4), _be(rest, 4), _be(F.col("size"), 4), _be(F.col("wire_len"), 4), F.hex("frame"))
    else:
        start = F.concat(F.lit("D4C3B2A102000400"), F.lit("0000000000000000"), F.lit("00000400"), _le(F.col("link"), 4))
        rec = F.concat(_le(second, 4), _le(F.floor(rest / 1000), 4), _le(F.col("size"), 4), _le(F.col("wire_len"), 4), F.hex("frame"))
    named = f.select("idx", F.concat_ws("-", F.lit(kind), F.col("link"), F.expr(f"idx div {FILE_FRAMES}")).alias("path"), start.alias("start"), rec.alias("rec"))
    whole = named.groupBy("path").agg(F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("idx", "rec"))).alias("rs"))
    return whole.select("path", F.unhex(F.concat("start", F.array_join("rs.rec", ""))).alias("content"), F.transform("rs", lambda r: r["idx"]).alias("idx"))


def read_back(c: Capture, kind: str) -> DataFrame:
    """Frames of the files with the packets' numbers."""
    made = files(c.packets, kind)
    if kind == "gzip":
        packed = F.pandas_udf(lambda s: s.map(__import__("gzip").compress), "binary")
        made = made.withColumn("content", packed("content"))
    number = made.select("path", F.posexplode("idx").alias("no", "idx"))
    return D.layers(capture.frames(made)).join(number.withColumn("no", F.col("no").cast("long")), ["path", "no"])


_SHOWN = ["idx", "ts_ns", "ts_known", "wire_len", "src_ip", "dst_port"]
for _name, _kind, _ts in (("src_pcap", "little", "ts_ns // 1000 * 1000"), ("src_pcap_big_endian", "big", "ts_ns"), ("src_pcapng", "pcapng", "ts_ns"), ("src_gzip", "gzip", "ts_ns // 1000 * 1000")):
    query(_name, f"SELECT idx, {_ts} AS ts_ns, TRUE AS ts_known, wire_len, src_ip, dst_port FROM packet")(lambda c, k=_kind: read_back(c, k).select(*_SHOWN))
query("src_sniff", "SELECT kind, COUNT(*) AS files FROM (SELECT DISTINCT idx // 500 AS f, arp_ip IS NULL AND idx % 13 = 0 AS bare FROM packet), (VALUES ('pcap'), ('pcapng')) v(kind) GROUP BY 1")(
    lambda c: files(c.packets, "little").unionByName(files(c.packets, "pcapng")).groupBy(capture.sniff(F.col("content")).alias("kind")).agg(F.count(F.lit(1)).alias("files"))
)


def decoded(c: Capture) -> DataFrame:
    return c._get("decoded", lambda: D.layers(frames(c.packets).select("idx", "link", "frame")).withColumn("text", D.text_of(F.col("payload"))))


def _dec(name: str, tail: str, columns: Callable[[], dict[str, Column]]) -> None:
    query(name, tail)(lambda c: decoded(c).select("idx", *[x.alias(n) for n, x in columns().items()]))


_HTTP = "http_host IS NOT NULL AND stratum IS NULL AND COALESCE(cleartext_cred, '') <> 'FTP'"
_ = F.col
_dec("dec_l2", "SELECT idx, l3 FROM packet", lambda: dict(l3=_("l3")))
_dec("dec_l3", "SELECT idx, src_ip, dst_ip, CAST(ttl AS INT) AS ttl FROM packet", lambda: dict(src_ip=_("src_ip"), dst_ip=_("dst_ip"), ttl=_("ttl")))
_dec("dec_l4", "SELECT idx, transport, src_port, dst_port, tcp_flags FROM packet", lambda: dict(transport=_("transport"), src_port=_("src_port"), dst_port=_("dst_port"), tcp_flags=_("tcp_flags")))
_dec("dec_arp", "SELECT idx, arp_ip, arp_mac FROM packet", lambda: dict(arp_ip=_("arp_ip"), arp_mac=_("arp_mac")))
_dec("dec_icmp_type", "SELECT idx, icmp_type FROM packet", lambda: dict(icmp_type=_("icmp_type")))
_dec("dec_dns_qname", "SELECT idx, dns_qname FROM packet", lambda: dict(dns_qname=F.when((_("src_port") == 53) | (_("dst_port") == 53), D.dns_question(_("payload")))))
_dec("dec_http_method", f"SELECT idx, CASE WHEN {_HTTP} THEN 'GET' END AS method FROM packet", lambda: dict(method=D.http_method(_("text"))))
_dec("dec_http_header", f"SELECT idx, CASE WHEN {_HTTP} THEN http_host END AS host, CASE WHEN {_HTTP} THEN http_ua END AS ua FROM packet", lambda: dict(host=D.http_header(_("text"), "Host"), ua=D.http_header(_("text"), "user-agent")))
_dec("dec_http_auth", "SELECT idx, CASE WHEN cleartext_cred = 'HTTP Basic' THEN cleartext_cred END AS scheme FROM packet", lambda: dict(scheme=D.http_auth(_("text"))))
_dec("dec_cred", "SELECT idx, cleartext_cred FROM packet", lambda: dict(cleartext_cred=D.cleartext_credential(_("text"), _("dst_port"), _("transport"))))
_dec("dec_pii_card", f"SELECT idx, COALESCE(pii = 'card' AND {_HTTP}, FALSE) AS card FROM packet", lambda: dict(card=D.card_number(_("text"))))
_dec("dec_pii_ssn", f"SELECT idx, COALESCE(pii = 'ssn' AND {_HTTP}, FALSE) AS ssn FROM packet", lambda: dict(ssn=D.social_number(_("text"))))
_dec("dec_text_gate", f"SELECT idx, CASE WHEN {_HTTP} OR stratum IS NOT NULL OR cleartext_cred = 'FTP' OR download IS NOT NULL THEN TRUE WHEN dns_qname IS NOT NULL OR ot_control IS NOT NULL OR icmp_type IS NOT NULL OR (app_proto = 'tls' AND transport = 'tcp') THEN FALSE END AS is_text FROM packet", lambda: dict(is_text=D.is_text(_("payload"))))
_dec("dec_stratum", "SELECT idx, stratum FROM packet", lambda: dict(stratum=D.stratum_role(_("text"), _("transport"))))
_dec("dec_modbus_ctl", "SELECT idx, CAST(regexp_extract(ot_control, '[0-9]+') AS INT) AS code FROM packet WHERE ot_control IS NOT NULL UNION ALL SELECT idx, NULL FROM packet WHERE ot_control IS NULL", lambda: dict(code=D.modbus_write(_("payload"), _("dst_port"))))
_dec("dec_download", "SELECT idx, download FROM packet", lambda: dict(download=F.when(F.startswith(_("text"), F.lit("HTTP/1.")), D.file_class(F.encode(F.regexp_extract(_("text"), r"(?s)\r\n\r\n(.*)$", 1), "ISO-8859-1")))))
_dec("dec_l7_hint", f"SELECT idx, CASE WHEN {_HTTP} THEN 'http' WHEN dns_qname IS NOT NULL THEN 'dns' WHEN ot_control IS NOT NULL THEN 'modbus' WHEN app_proto = 'tls' AND transport = 'tcp' AND stratum IS NULL THEN 'tls' END AS hint FROM packet", lambda: dict(hint=F.when(_("payload").isNotNull(), D.l7_hint(_("payload"), _("transport"), _("src_port"), _("dst_port")))))
