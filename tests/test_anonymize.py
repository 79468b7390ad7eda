"""Pseudonyms: prefixes, permutations, what stays."""

from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from flowquarry.operators import anonymize

STAY = ["0.0.0.0", "127.0.0.1", "127.9.9.9", "224.0.0.251", "239.255.255.250", "255.255.255.255", "::", "::1", "ff02::1"]
BLOCKS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "169.254.0.0/16", "fc00::/7", "fe80::/10"]


def _addresses():
    rng = random.Random(5)
    out = set(STAY)
    for block in [*BLOCKS, "0.0.0.0/0", "8.8.0.0/16", "2000::/3", "2001:db8::/48"]:
        net = ipaddress.ip_network(block)
        out |= {str(net[rng.randrange(min(net.num_addresses, 1 << 100))]) for _ in range(40)}
        near = int(net[rng.randrange(min(net.num_addresses, 1 << 100))])
        out |= {str(type(net.network_address)(near ^ (1 << b))) for b in range(6)}
    return sorted(out)


def _made(spark, values, column):
    return {r.v: r.p for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", column.alias("p")).collect()}


def _common(a, b):
    a, b = ipaddress.ip_address(a), ipaddress.ip_address(b)
    return a.max_prefixlen - (int(a) ^ int(b)).bit_length()


@pytest.mark.parametrize("keep", [True, False])
def test_addresses(spark, keep):
    values = _addresses()
    got = _made(spark, values, anonymize.ip(F.col("v"), "k", keep))
    assert all(got[x] == x for x in STAY)
    # Permutations: no two of a block alike, families and blocks kept, texts canonical.
    block_of = {v: next((b for b in BLOCKS if ipaddress.ip_address(v) in ipaddress.ip_network(b)), "public") for v in values}
    assert len({(block_of[v], p) for v, p in got.items()}) == len(values)
    assert all(str(ipaddress.ip_address(p)) == p and ipaddress.ip_address(p).version == ipaddress.ip_address(v).version for v, p in got.items())
    for block in map(ipaddress.ip_network, BLOCKS):
        inside = [v for v in values if ipaddress.ip_address(v) in block]
        assert len(inside) > 20 and all(ipaddress.ip_address(got[v]) in block for v in inside)
    assert sum(got[v] != v for v in values) > 0.9 * len(values)
    moved = [v for v in values if block_of[v] == "public" and v not in STAY and not ipaddress.ip_address(v).is_multicast and not ipaddress.ip_address(v).is_loopback]
    for version in (4, 6):
        same = [v for v in moved if ipaddress.ip_address(v).version == version]
        kept = [_common(a, b) == _common(got[a], got[b]) for i, a in enumerate(same) for b in same[:i]]
        assert all(kept) if keep else not all(kept)
    other = _made(spark, values, anonymize.ip(F.col("v"), "another", keep))
    assert other != got and _made(spark, values, anonymize.ip(F.col("v"), "k", keep)) == got


def test_flat_is_a_permutation_of_a_block(spark):
    values = [f"192.168.{a}.{b}" for a in range(256) for b in range(256)]
    got = _made(spark, values, anonymize.ip(F.col("v"), "k", False))
    assert set(got.values()) == set(values)


def test_no_addresses(spark):
    for column in (anonymize.ip(F.col("v"), "k"), anonymize.ip(F.col("v"), "k", False), anonymize.mac(F.col("v"), "k")):
        assert set(_made(spark, ["", "host", "1.2.3", "1.2.3.456", "x:y", "12:34", None], column).values()) == {None}


def test_hardware_addresses(spark):
    values = ["00:00:00:00:00:00", "ff:ff:ff:ff:ff:ff", "01:00:5e:00:00:fb", "00:1A:2b:00:00:01", "00:1a:2b:00:00:02"]
    got, kept = (_made(spark, values, anonymize.mac(F.col("v"), "k", k)) for k in (False, True))
    assert all(got[v] == v == kept[v] for v in values[:3])
    assert all(kept[v].startswith("00:1a:2b:") and int(got[v][:2], 16) & 3 == 2 for v in values[3:])
    assert len({*got.values(), *kept.values()}) == 7
    assert _made(spark, ["00:1a:2b:00:00:01"], anonymize.mac(F.col("v"), "k"))["00:1a:2b:00:00:01"] == got["00:1A:2b:00:00:01"]


def test_tokens(spark):
    values = ["", "a", "Mail.Example.COM", "mail.example.com", "www.example.com", "x" * 31, "x" * 32, "x" * 33, "y" * 100, "é", None]
    token, name = _made(spark, values, anonymize.token(F.col("v"), "k")), _made(spark, values, anonymize.name(F.col("v"), "k"))
    assert all(len(token[v]) == len(v) == len(name[v]) and set(token[v]) <= set(anonymize.CHARACTERS) for v in values if v is not None)
    assert token[None] is None and name[None] is None
    assert name["Mail.Example.COM"] == name["mail.example.com"] != token["mail.example.com"]
    assert name["www.example.com"].split(".")[1:] == name["mail.example.com"].split(".")[1:]
    assert name["www.example.com"].split(".")[0] != "www"
