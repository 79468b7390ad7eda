"""Indicators of compromise from free text, one to a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
IPV6 = r"^(?=.*:.*:)[0-9a-f:]+(?:%[\w]+)?$"
DOMAIN = r"^(?=.{4,253}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"


def refanged(word: Column) -> Column:
    """A word as it was before it was made harmless to click."""
    plain = F.regexp_replace(F.lower(word), r"\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)", ".")
    return F.regexp_replace(F.regexp_replace(plain, r"^hxxp", "http"), r"\[:\]|\[://\]", ":")


def host_of(word: Column) -> Column:
    """The host of a URL, or the word itself; the port goes if there is just one colon."""
    host = F.regexp_replace(F.regexp_replace(word, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?", ""), r"[/?#].*$", "")
    return F.when(F.length(F.regexp_replace(host, "[^:]", "")) == 1, F.regexp_replace(host, r":\d+$", "")).otherwise(host)


def kind_of(value: Column) -> Column:
    digest = value.rlike("^[0-9a-f]+$")
    out = F.when(value.rlike(IPV4), "ipv4").when(value.rlike(IPV6), "ipv6")
    for name, size in (("md5", 32), ("sha1", 40), ("sha256", 64)):
        out = out.when(digest & (F.length(value) == size), name)
    return out.when(value.rlike(DOMAIN), "domain")


def indicators(lines: DataFrame, text: str = "value") -> DataFrame:
    """(kind, value): distinct indicators in the lines; what follows ``#`` or ``//`` at a word's start is a comment.

    Null lines and words that are no indicator give none.
    """
    bare = F.regexp_replace(F.col(text), r"(?:^|\s)(?:#|//).*$", "")
    words = lines.select(F.explode(F.split(bare, r"[\s,;|\"'<>]+")).alias("word")).filter("word <> ''")
    found = words.select(host_of(refanged(F.col("word"))).alias("value"))
    return found.select(kind_of(F.col("value")).alias("kind"), "value").filter("kind is not null").distinct()
