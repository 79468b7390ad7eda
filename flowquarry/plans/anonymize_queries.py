"""Queries of pseudonyms, over all addresses and names of the packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.operators import anonymize
from flowquarry.plans.oracle import num, within
from flowquarry.plans.queries import Capture, query

KEY = "test key"


def _addresses(c: Capture) -> DataFrame:
    return c.packets.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).filter("ip is not null").distinct()


_IPS = f", ips AS (SELECT ip, {num('ip')} AS n, lpad(bin({num('ip')}), 32, '0') AS bits FROM (SELECT src_ip AS ip FROM packet UNION SELECT dst_ip FROM packet) WHERE ip IS NOT NULL)"
_SAME = f"(n IN (0, 4294967295) OR {within('n', '127.0.0.0/8')} OR {within('n', '224.0.0.0/4')})"
_PINNED = f"CASE WHEN {within('n', '10.0.0.0/8')} THEN 8 WHEN {within('n', '172.16.0.0/12')} THEN 12 WHEN {within('n', '192.168.0.0/16')} THEN 16 WHEN {within('n', '100.64.0.0/10')} THEN 10 WHEN {within('n', '169.254.0.0/16')} THEN 16 ELSE 0 END"
_DOTTED = "concat_ws('.', " + ", ".join("CAST(" + " + ".join(f"{1 << (7 - j)} * CAST(substr(o, {8 * i + j + 1}, 1) AS INT)" for j in range(8)) + " AS VARCHAR)" for i in range(4)) + ")"
_ODD = "(ascii(right({}, 1)) % 2 = CASE WHEN right({}, 1) >= 'a' THEN 0 ELSE 1 END)"
_FLIP = _ODD.format(*[f"sha256('{KEY}|v4|' || substr(bits, 1, i))"] * 2)
query(
    "an_ip",
    f"{_IPS}, w AS (SELECT *, {_PINNED} AS f FROM ips), b AS (SELECT ip, i, CASE WHEN (substr(bits, i + 1, 1) = '1') <> ({_FLIP} AND i >= f AND NOT {_SAME}) THEN '1' ELSE '0' END AS x FROM w, (SELECT CAST(UNNEST(range(0, 32)) AS INT) AS i)) SELECT ip, {_DOTTED} AS pseudonym FROM (SELECT ip, string_agg(x, '' ORDER BY i) AS o FROM b GROUP BY ip)",
)(lambda c: _addresses(c).select("ip", anonymize.ip(F.col("ip"), KEY).alias("pseudonym")))


def _feistel() -> str:
    """Four rounds as four subqueries; x: the exclusive or of two texts of bits, through numbers of at most 32 bits."""
    q = f"SELECT ip, bits, f, {_SAME} AS same, substr(bits, f + 1, (32 - f) // 2) AS l, substr(bits, f + 1 + (32 - f) // 2) AS r FROM (SELECT *, {_PINNED} AS f FROM ips)"
    number = lambda t: f"list_sum(list_transform(range(1, length({t}) + 1), lambda i: CAST(substr({t}, i, 1) AS BIGINT) << (length({t}) - i)))"
    for n in range(4):
        # The first digits of the digest are enough, as a half has at most 16 bits.
        m = f"SELECT *, CAST('0x' || substr(sha256('{KEY}|v4flat|{n}|' || r), 1, 4) AS BIGINT) >> (16 - length(l)) AS mask, CAST({number('l')} AS BIGINT) AS ln FROM ({q})"
        q = f"SELECT ip, bits, f, same, r AS l, lpad(bin(xor(ln, mask)), CAST(length(l) AS INT), '0') AS r FROM ({m})"
    return q


query("an_ip_flat", f"{_IPS} SELECT ip, {_DOTTED} AS pseudonym FROM (SELECT ip, CASE WHEN same THEN bits ELSE substr(bits, 1, f) || l || r END AS o FROM ({_feistel()}))")(lambda c: _addresses(c).select("ip", anonymize.ip(F.col("ip"), KEY, keep_prefixes=False).alias("pseudonym")))

_D = f"sha256('{KEY}|mac|' || replace(m, ':', ''))"
_PAIRS = lambda h: " || ':' || ".join(f"substr({h}, {2 * i + 1}, 2)" for i in range(6))
query(
    "an_mac",
    f", macs AS (SELECT idx, arp_mac AS m, {_D} AS d, replace(arp_mac, ':', '') AS h FROM packet WHERE arp_mac IS NOT NULL), made AS (SELECT idx, m, substr(h, 1, 6) || substr(d, 1, 6) AS kept, lpad(lower(to_hex((CAST('0x' || substr(d, 1, 2) AS INT) & 252) | 2)), 2, '0') || substr(d, 3, 10) AS other FROM macs) SELECT idx, m AS mac, {_PAIRS('other')} AS pseudonym, {_PAIRS('kept')} AS vendor_kept FROM made",
)(lambda c: c.packets.filter("arp_mac is not null").select("idx", F.col("arp_mac").alias("mac"), anonymize.mac(F.col("arp_mac"), KEY).alias("pseudonym"), anonymize.mac(F.col("arp_mac"), KEY, keep_vendor=True).alias("vendor_kept")))

_CHAR = f"substr('{anonymize.CHARACTERS}', (CAST('0x' || substr(sha256('{KEY}|{{label}}|' || CAST(j // 32 AS VARCHAR) || '|' || {{v}}), 2 * (j % 32) + 1, 2) AS INT) % 36) + 1, 1)"
_TOKEN = "array_to_string(list_transform(range(0, length({v})), lambda j: " + _CHAR + "), '')"
query(
    "an_token",
    f"SELECT idx, array_to_string(list_transform(string_split(lower(dns_qname), '.'), lambda v: {_TOKEN.format(v='v', label='label')}), '.') AS name, {_TOKEN.format(v='http_ua', label='value')} AS agent FROM packet WHERE dns_qname IS NOT NULL OR http_ua IS NOT NULL",
)(lambda c: c.packets.filter("dns_qname is not null or http_ua is not null").select("idx", anonymize.name(F.col("dns_qname"), KEY).alias("name"), anonymize.token(F.col("http_ua"), KEY).alias("agent")))
