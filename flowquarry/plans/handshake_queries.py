"""Queries of handshake fingerprints: hellos and key exchanges are written byte by byte from the packets' columns, framed, and decoded.

What each kind of message must give is written out in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.operators import decode as D
from flowquarry.operators import handshake
from flowquarry.plans.capture_queries import _be, _text, frames
from flowquarry.plans.queries import Capture, query


def _sized(x: Column, size: int) -> Column:
    return F.concat(_be(F.length(x) / 2, size), x)


def _ext(kind: str, body: Column | str) -> Column:
    return F.concat(F.lit(kind), _sized(F.lit(body) if isinstance(body, str) else body, 2))


def _hello(kind: str, body: Column, version: str) -> Column:
    return F.concat(F.lit(f"16{version}"), _sized(F.concat(F.lit(kind), _sized(body, 3)), 2))


def _client(number: Column) -> Column:
    """One of four hellos: all extensions and reserved values; no name; few ciphers and no list of signatures; cut within the ciphers."""
    name = _ext("0000", _sized(F.concat(F.lit("00"), _sized(_text(F.col("sni")), 2)), 2))
    groups, points, signatures = _ext("000A", "00062A2A001D0017"), _ext("000B", "0100"), _ext("000D", "000404030804")
    alpn, versions = _ext("0010", "000C02683208687474702F312E31"), _ext("002B", "061A1A03040303")
    start = lambda session, ciphers: F.concat(F.lit("0303" + "AB" * 32 + session), _sized(F.lit(ciphers), 2), F.lit("0100"))
    whole = F.concat(start("20" + "CD" * 32, "0A0A13011302C02F"), _sized(F.concat(F.lit("3A3A0000"), name, groups, points, alpn, signatures, versions), 2))
    bare = F.concat(start("00", "13011302C02F"), _sized(F.concat(groups, points, signatures, versions), 2))
    few = F.concat(start("00", "C02F009C"), _sized(F.concat(name, F.lit("00170000")), 2))
    kind = number % 4
    made = _hello("01", F.when(kind == 0, whole).when(kind == 1, bare).otherwise(few), "0301")
    return F.when(kind == 3, F.substring(made, 1, 94)).otherwise(made)


def _server(number: Column) -> Column:
    """One of three answers: TLS 1.3 by an extension, TLS 1.0 without extensions, an unregistered cipher beside a reserved extension."""
    start = lambda version, cipher: version + "AB" * 32 + "00" + cipher + "00"
    bodies = [start("0303", "1301") + "000C" + "002B00020304" + "003300020017", start("0301", "0005"), start("0303", "FEFE") + "0009" + "1A1A0000" + "FF01000100"]
    return F.when(number % 3 == 0, _hello("02", F.lit(bodies[0]), "0303")).when(number % 3 == 1, _hello("02", F.lit(bodies[1]), "0301")).otherwise(_hello("02", F.lit(bodies[2]), "0303"))


def _ssh(number: Column) -> Column:
    lists = ["curve25519-sha256,ecdh-sha2-nistp256", "ssh-ed25519", "aes128-ctr", "aes256-ctr", "hmac-sha2-256", "hmac-sha2-512", "none", "zlib", "", ""]
    message = "14" + "EF" * 16 + "".join(f"{len(x):08X}{x.encode().hex().upper()}" for x in lists) + "0000000000"
    packet = f"{len(message) // 2 + 5:08X}04" + message + "00000000"
    return F.when(number % 2 == 0, F.concat(_text(F.lit("SSH-2.0-x\r\n")), F.lit(packet))).otherwise(F.lit(packet))


def _decoded(c: Capture) -> DataFrame:
    """(idx, transport, src_port, dst_port, payload) of frames whose payloads are the messages."""
    number = F.col("idx")
    made = F.when(F.col("sni").isNotNull(), _client(number)).when(F.col("tls_version").isNotNull(), _server(number)).when(F.col("hassh").isNotNull() | F.col("hassh_server").isNotNull(), _ssh(number)).otherwise("")
    # Written before, so that the tests of first bytes do not decode the frames anew.
    return c._keep("handshakes", lambda: D.layers(frames(c.packets, made).select("idx", "link", "frame")).select("idx", "transport", "src_port", "dst_port", "payload"))


_SERVER_KIND = "idx % 3"
query("dec_tls_sni", "SELECT idx, sni FROM packet WHERE sni IS NOT NULL AND idx % 4 IN (0, 2)")(lambda c: handshake.handshakes(_decoded(c), ["idx"]).filter("sni is not null").select("idx", "sni"))
_JA3 = {0: "771,4865-4866-49199,0-10-11-16-13-43,29-23,0", 1: "771,4865-4866-49199,10-11-13-43,29-23,0", 2: "771,49199-156,0-23,,"}
_JA4 = {0: ("t13d0306h2", "1301,1302,c02f", "000a,000b,000d,002b_0403,0804"), 1: ("t13i030400", "1301,1302,c02f", "000a,000b,000d,002b_0403,0804"), 2: ("t12d020200", "009c,c02f", "0017")}
_case = lambda f: "CASE idx % 4 " + " ".join(f"WHEN {k} THEN {f(k)}" for k in (0, 1, 2)) + " END"
query(
    "dec_ja3_ja4",
    f"""SELECT idx, {_case(lambda k: f"md5('{_JA3[k]}')")} AS ja3, {_case(lambda k: f"'{_JA4[k][0]}_' || sha256('{_JA4[k][1]}')[:12] || '_' || sha256('{_JA4[k][2]}')[:12]")} AS ja4, CASE WHEN idx % 4 = 0 THEN 'h2,http/1.1' ELSE '' END AS alpn
      FROM packet WHERE sni IS NOT NULL AND idx % 4 < 3""",
)(lambda c: handshake.handshakes(_decoded(c), ["idx"]).filter("ja3 is not null").select("idx", "ja3", "ja4", "alpn"))
query(
    "dec_server_hello",
    f"""SELECT idx, CASE {_SERVER_KIND} WHEN 0 THEN 'TLS 1.3' WHEN 1 THEN 'TLS 1.0' ELSE 'TLS 1.2' END AS tls_version, CASE {_SERVER_KIND} WHEN 0 THEN 'TLS_AES_128_GCM_SHA256' WHEN 1 THEN 'TLS_RSA_WITH_RC4_128_SHA' ELSE '0xfefe' END AS tls_cipher,
      md5(CASE {_SERVER_KIND} WHEN 0 THEN '771,4865,43-51' WHEN 1 THEN '769,5,' ELSE '771,65278,65281' END) AS ja3s FROM packet WHERE tls_version IS NOT NULL""",
)(lambda c: handshake.handshakes(_decoded(c), ["idx"]).filter("ja3s is not null").select("idx", "tls_version", "tls_cipher", "ja3s"))
_KEX = "curve25519-sha256,ecdh-sha2-nistp256"
query(
    "dec_hassh",
    f"""SELECT idx, CASE WHEN src_port > dst_port THEN md5('{_KEX};aes128-ctr;hmac-sha2-256;none') END AS hassh, CASE WHEN src_port < dst_port THEN md5('{_KEX};aes256-ctr;hmac-sha2-512;zlib') END AS hassh_server
      FROM packet WHERE (hassh IS NOT NULL OR hassh_server IS NOT NULL) AND src_port <> dst_port""",
)(lambda c: handshake.handshakes(_decoded(c), ["idx"]).filter("hassh is not null or hassh_server is not null").select("idx", "hassh", "hassh_server"))
