"""Keyed pseudonyms of addresses, hardware addresses, names and values, as column expressions.

All come from SHA-256 over the key, a label of the kind and the value, so equal values have equal pseudonyms in every task and
run, and no table of them is kept or joined.  The key stands in the plan of a query: keep plans and event logs as secret as the key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowquarry.functions.net import let, v4_number, v6_hex
from flowquarry.operators.decode import v6_text

#: Blocks whose prefix is kept, so that a pseudonym stays in the same block, as leading bits.
PINNED4 = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "169.254.0.0/16")
PINNED6 = ("1111110", "1111111010")
#: Characters of tokens.
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _digest(key: str, label: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{label}|"), value), 256)


def bits4(ip: Column) -> Column:
    """The 32 bits of an IPv4 address as text; null for other text, numbers beyond 255 in it included."""
    octets = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    return F.when(F.forall(octets, lambda x: x < 256), F.lpad(F.bin(v4_number(ip)), 32, "0"))


def bits6(ip: Column) -> Column:
    """The 128 bits of an IPv6 address as text; null for other text."""
    digits = v6_hex(ip)
    return F.when(digits.rlike("^[0-9a-f]{32}$"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.conv(F.substr(digits, i * 4 + 1, F.lit(4)), 16, 2), 16, "0")), ""))


def _prefix(cidr: str) -> str:
    ip, size = cidr.split("/")
    return "".join(f"{int(x):08b}" for x in ip.split("."))[: int(size)]


def _fixed(bits: Column, prefixes: tuple[str, ...]) -> Column:
    """How many leading bits stay."""
    out = F.lit(0)
    for p in prefixes:
        out = F.when(F.startswith(bits, F.lit(p)), len(p)).otherwise(out)
    return out


def _walked(bits: Column, fixed: Column, key: str, label: str, width: int) -> Column:
    """Bit by bit: each flips or not by the digest of the bits before it, so a common prefix stays common and no two become one."""

    def bit(i: Column) -> Column:
        flips = F.right(_digest(key, label, F.substr(bits, F.lit(1), i)), F.lit(1)).isin(*"13579bdf") & (i >= fixed)
        return F.when((F.substr(bits, i + 1, F.lit(1)) == "1") != flips, "1").otherwise("0")

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), bit), "")


def _mixed(bits: Column, fixed: Column, key: str, label: str) -> Column:
    """A Feistel network of four rounds over the bits behind the fixed ones: a permutation that keeps no common prefix."""

    def rounds(suffix: Column) -> Column:
        half = F.floor(F.length(suffix) / 2).cast("int")

        def turn(state: Column, n: Column) -> Column:
            left, right = state["l"], state["r"]
            digest = _digest(key, label, F.concat(n.cast("string"), F.lit("|"), right))
            mask = F.substr(F.lpad(F.conv(F.substr(digest, F.lit(1), F.lit(16)), 16, 2), 64, "0"), F.lit(1), F.length(left))
            pairs = F.zip_with(F.split(left, ""), F.split(mask, ""), lambda a, b: F.when(a == b, "0").otherwise("1"))
            return F.struct(right.alias("l"), F.array_join(pairs, "").alias("r"))

        start = F.struct(F.substr(suffix, F.lit(1), half).alias("l"), F.substr(suffix, half + 1, F.length(suffix)).alias("r"))
        return let(F.aggregate(F.array(*map(F.lit, range(4))), start, turn), lambda s: F.concat(s["l"], s["r"]))

    return F.concat(F.substr(bits, F.lit(1), fixed), let(F.substr(bits, fixed + 1, F.length(bits)), rounds))


def ip(address: Column, key: str, keep_prefixes: bool = True) -> Column:
    """Pseudonym of an IPv4 or IPv6 address; null for other text.

    With ``keep_prefixes`` two public addresses, or two of one block, have as many leading bits in common as their pseudonyms have.
    Unspecified, loopback and multicast addresses and the limited broadcast stay; private, shared and link-local ones keep
    their block.  Within a block, and among the public addresses of a family, no two become one; as all bits of a public address
    change, its pseudonym may look private.
    """
    change = (lambda b, f, label, width: _walked(b, f, key, label, width)) if keep_prefixes else (lambda b, f, label, width: _mixed(b, f, key, label + "flat"))

    def of4(bits: Column) -> Column:
        same = bits.isin("0" * 32, "1" * 32) | F.startswith(bits, F.lit("01111111")) | F.startswith(bits, F.lit("1110"))
        out = F.when(same, bits).otherwise(change(bits, _fixed(bits, tuple(map(_prefix, PINNED4))), "v4", 32))
        return let(out, lambda b: F.concat_ws(".", *[F.conv(F.substring(b, 8 * i + 1, 8), 2, 10) for i in range(4)]))

    def of6(bits: Column) -> Column:
        same = bits.isin("0" * 128, "0" * 127 + "1") | F.startswith(bits, F.lit("1" * 8))
        out = F.when(same, bits).otherwise(change(bits, _fixed(bits, PINNED6), "v6", 128))
        return let(out, lambda b: v6_text(F.array(*[F.lower(F.lpad(F.conv(F.substring(b, 16 * i + 1, 16), 2, 16), 4, "0")) for i in range(8)])))

    return F.when(address.contains(":"), let(bits6(address), lambda b: F.when(b.isNotNull(), of6(b)))).otherwise(let(bits4(address), lambda b: F.when(b.isNotNull(), of4(b))))


def mac(address: Column, key: str, keep_vendor: bool = False) -> Column:
    """Pseudonym of a hardware address ``xx:xx:xx:xx:xx:xx``; null for other text.

    Group addresses and the one of zeros stay.  With ``keep_vendor`` the first three bytes do; otherwise the pseudonym is marked
    as locally administered, so it is no vendor's.  Two addresses may get one pseudonym, with the odds of 24 or 46 bits.
    """
    digits = F.lower(F.replace(address, F.lit(":"), F.lit("")))
    digest = _digest(key, "mac", digits)
    first = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(0xFC)).bitwiseOR(F.lit(2))
    made = F.concat(F.substring(digits, 1, 6), F.substring(digest, 1, 6)) if keep_vendor else F.concat(F.lower(F.lpad(F.hex(first.cast("long")), 2, "0")), F.substring(digest, 3, 10))
    group = F.substring(digits, 2, 1).isin(*"13579bdf") | (digits == "0" * 12)
    out = F.when(group, digits).otherwise(made)
    return F.when(address.rlike("^[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}$"), F.concat_ws(":", *[F.substring(out, 2 * i + 1, 2) for i in range(6)]))


def token(value: Column, key: str, label: str = "value") -> Column:
    """A token of letters and digits with as many characters as the value; equal values of one ``label`` have equal tokens."""

    def block(n: Column) -> Column:
        digest = _digest(key, label, F.concat(n.cast("string"), F.lit("|"), value))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substr(F.lit(CHARACTERS), (F.conv(F.substr(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int") % len(CHARACTERS)) + 1, F.lit(1))), "")

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 32).cast("int")), block)
    return F.substr(F.array_join(blocks, ""), F.lit(1), F.length(value))


def name(host: Column, key: str) -> Column:
    """A host name label by label, case aside: names of one domain stay names of one domain, in whatever protocol they are seen."""
    return F.array_join(F.transform(F.split(F.lower(host), r"\."), lambda x: token(x, key, "label")), ".")
