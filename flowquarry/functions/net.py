"""Column functions on addresses, names and labels.  All run inside the JVM."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowquarry.schema import BANDS, CLOUD_BLOCKS, SEVERITIES


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def v4_number(ip: Column) -> Column:
    """IPv4 text as an integer; null for other text."""
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda n, x: n * 256 + x.cast("long")))


def v6_hex(ip: Column) -> Column:
    """32 hex digits of IPv6 text; null for other text."""

    def groups(side: Column) -> Column:
        return F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")

    def plain(text: Column) -> Column:
        """An embedded IPv4 tail becomes two groups."""
        four = r"(\d+\.\d+\.\d+\.\d+)$"
        return F.when(text.contains("."), let(v4_number(F.regexp_extract(text, four, 1)), lambda n: F.concat(F.regexp_replace(text, four, ""), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF))))))).otherwise(text)

    def whole(sides: Column) -> Column:
        left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
        return F.when(F.size(sides) > 1, F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)).otherwise(left)

    return F.when(ip.contains(":"), F.array_join(F.transform(let(F.split(plain(F.lower(ip)), "::"), whole), lambda g: F.lpad(g, 4, "0")), ""))


def ip_key(ip: Column) -> Column:
    """Sort key of an address: IPv4 before IPv6, then by bytes."""
    return F.coalesce(F.concat(F.lit("4"), F.lpad(F.hex(v4_number(ip)), 8, "0")), F.concat(F.lit("6"), F.upper(v6_hex(ip))))


def _within(n: Column, cidr: str) -> Column:
    net = ipaddress.ip_network(cidr)
    return n.between(int(net.network_address), int(net.broadcast_address))


def _class4(n: Column) -> Column:
    return (
        F.when(_within(n, "127.0.0.0/8"), "loopback")
        .when(_within(n, "169.254.0.0/16"), "link-local")
        .when(_within(n, "10.0.0.0/8") | _within(n, "172.16.0.0/12") | _within(n, "192.168.0.0/16"), "private")
        .when(_within(n, "100.64.0.0/10"), "cgnat")
        .when(_within(n, "224.0.0.0/4"), "multicast")
        .when(_within(n, "192.0.2.0/24") | _within(n, "198.51.100.0/24") | _within(n, "203.0.113.0/24"), "documentation")
        .when(_within(n, "0.0.0.0/8") | _within(n, "240.0.0.0/4") | _within(n, "192.0.0.0/24"), "reserved")
        .when(n.isNotNull(), "public")
    )


def _class6(hex6: Column) -> Column:
    def by_first(first: Column) -> Column:
        return F.when(first.bitwiseAND(F.lit(0xFFC0)) == 0xFE80, "link-local").when(first.bitwiseAND(F.lit(0xFE00)) == 0xFC00, "private").when(F.shiftright(first, 8) == 0xFF, "multicast").when(first.isNotNull(), "public")

    mapped = F.when(hex6.startswith("0" * 20 + "ffff"), let(F.conv(F.substring(hex6, 25, 8), 16, 10).cast("long"), _class4))
    return F.coalesce(mapped, F.when(hex6 == "0" * 31 + "1", "loopback").when(hex6 == "0" * 32, "reserved").when(hex6.startswith("20010db8"), "documentation"), let(F.conv(F.substring(hex6, 1, 4), 16, 10).cast("int"), by_first))


def ip_class(ip: Column) -> Column:
    """Address class: loopback, link-local, private, cgnat, multicast, documentation, reserved or public."""
    return F.coalesce(let(v4_number(ip), _class4), F.when(ip.contains(":"), let(v6_hex(ip), _class6)))


def is_external(ip: Column) -> Column:
    return F.coalesce(ip_class(ip).isin("public", "cgnat"), F.lit(False))


def cloud_provider(ip: Column) -> Column:
    """Name of the large host that holds a public IPv4 address; null for others."""

    def block(n: Column) -> Column:
        out = F.when(_class4(n) != "public", F.lit(None).cast("string"))
        for net, bits, name in CLOUD_BLOCKS:
            out = out.when(_within(n, f"{net}/{bits}"), name)
        return out

    return let(v4_number(ip), block)


def severity_of(score: Column) -> Column:
    out = F.lit(None)
    for name, least in reversed(BANDS):
        out = F.when(score >= least, F.lit(name)).otherwise(out) if least else F.lit(name)
    return out


def rank(severity: Column) -> Column:
    """Place of a severity, 0 for info to 4 for critical."""
    return (F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1).cast("int")


def severity_at(place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.least(place, F.lit(4)).cast("int") + 1)


def escalate(severity: Column, bands: Column | int = 1) -> Column:
    return severity_at(rank(severity) + bands)


def labels(name: Column) -> Column:
    return F.filter(F.split(F.rtrim(F.lower(F.trim(name)), F.lit(".")), r"\."), lambda x: x != "")


def registered_domain(name: Column) -> Column:
    """Last two labels of a name; null for single labels, reverse lookups and numbers."""
    ls = labels(name)
    tld, label = F.try_element_at(ls, F.lit(-1)), F.try_element_at(ls, F.lit(-2))
    numeric = tld.rlike(r"^\d+$") & label.rlike(r"^\d+$")
    return F.when((F.size(ls) >= 2) & (tld != "arpa") & ~numeric, F.concat(label, F.lit("."), tld))


def longest_label(name: Column) -> Column:
    ls = labels(name)
    return F.aggregate(ls, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))


def is_generated_label(label: Column) -> Column:
    """Whether a label of a domain looks generated: few vowels, a long run of consonants, or many digits."""
    n = F.length(label)
    letters = F.length(F.regexp_replace(label, "[^a-zA-Z]", ""))
    vowels = F.length(F.regexp_replace(label, "[^aeiou]", ""))
    digits = F.length(F.regexp_replace(label, "[^0-9]", ""))
    few_vowels = (letters >= 6) & (vowels / letters < 0.26)
    run = label.rlike("[b-df-hj-np-tv-zB-DF-HJ-NP-TV-ZAEIOU]{5}")
    heavy = (digits >= 3) & (digits / n >= 0.30)
    return n.between(8, 40) & ~label.startswith("xn--") & label.rlike("^[A-Za-z0-9-]+$") & (few_vowels | run | heavy)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters of a text, in bits; exact for one-byte characters."""
    chars = F.split(text, "")
    n = F.length(text)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def human_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {unit}", n / float(1024**i))).otherwise(out)
    return out


def name_suffixes(name: Column) -> Column:
    """A host name and all its parents, for equi-joins with suffix lists."""
    ls = F.split(F.lower(name), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(ls)), lambda i: F.array_join(F.slice(ls, i, F.size(ls)), "."))
