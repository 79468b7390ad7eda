"""Payload rules on written-out bytes that tell them from looser ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowquarry.operators import decode as D

CARD = "4111111111111111"
CARDS = [
    (f"card: {CARD}", True), (f"card\nnumber:\r\n {CARD}", True), ("PAN=4111-1111 1111-1111", True), (CARD, False), (f"card{'.' * 36}{CARD}", True), (f"card{'.' * 37}{CARD}", False), (f"credit{'.' * 34}{CARD}", True), (f"pan{'.' * 38}{CARD}", False),
    (f"{CARD} card", False), ("card 4111111111111112", False), ("card 5018000000000009", False), ("card 5555555555554444", True), ("card 5600000000000003", False), ("card 378282246310005", True), ("card 30569309025904", False), ("card 2221000000000009", True),
    ("card 2720990000000007", True), ("card 2721000000000004", False), ("card 6011111111111117", True), ("card 6500000000000002", True), ("card 6000000000000007", False), ("card 4222222222222", True), ("card 41111111111111", False), (f"card 12 x {CARD}", True), (f"card 99{CARD}", False), ("card 4111  1111 1111 1111", False),
]
SOCIAL = [
    ("ssn 123-45-6789", True), ("Social\nno: 123-45-6789", True), (f"ssn{'.' * 37}123-45-6789", True), (f"ssn{'.' * 38}123-45-6789", False), (f"social{'.' * 35}123-45-6789", False), ("123-45-6789 ssn", False), ("ssn 000-45-6789", False), ("ssn 666-45-6789", False),
    ("ssn 900-45-6789", False), ("ssn 123-00-6789", False), ("ssn 123-45-0000", False), ("ssn 1123-45-6789", False), ("ssn 123-45-67890", False), ("ssn 666-45-6789 then 123-45-6789", True),
]
STRATUM = [
    ('{"method":"mining.subscribe"}', "tcp", "miner"), ("MINING.SUBMIT", "tcp", "miner"), ("x mining.notify", "tcp", "pool"), ("mining.set_difficulty", "tcp", "pool"), ('{"method":"login"}', "tcp", None), ('{"method":"job"}', "tcp", None), ("mining.set_extranonce", "tcp", None),
    ("mining.submit", "udp", None), ("." * 499 + "mining.submit", "tcp", "miner"), ("." * 500 + "mining.submit", "tcp", None),
]
LOGINS = [
    ("USER bob", "tcp", 21, "FTP"), ("pass x", "tcp", 21, "FTP"), ("USER bob", "tcp", 2121, None), ("USER bob", "udp", 21, None), ("GET / HTTP/1.1\r\nAuthorization: Basic dTpw\r\n\r\n", "tcp", 80, "HTTP Basic"), ("GET / HTTP/1.1\r\nAuthorization: digest\r\n\r\n", "tcp", 80, "HTTP Digest"),
    ("HTTP/1.1 200 OK\r\nAuthorization: Basic dTpw\r\n\r\n", "tcp", 80, None), ("Authorization: Basic dTpw\r\n\r\n", "tcp", 80, None), ("GET / HTTP/1.1\r\nAuthorization: Basic dTpw\r\n\r\n", "udp", 80, None),
]
FILES = [
    ("7f454c46", "executable"), ("feedface00", "executable"), ("feedfacf00", "executable"), ("cefaedfe00", "executable"), ("cffaedfe00", "executable"), ("cafebabe00", None), ("4d5a9000", "executable"), (b"MZ is text".hex(), None), ("4d5ac3a9c3a9", None), (b"#!/bin/sh".hex(), "script"), (b"MSCF".hex(), "installer"),
    (b"!<arch>".hex(), "installer"), ("504b0304", "archive"), ("504b0506", "archive"), (b"Rar!\x1a\x07".hex(), "archive"), (b"Rar!x".hex(), None), ("377abcaf271c", "archive"), ("1f8b", "archive"), ("fd377a585a00", "archive"), (b"BZh9".hex(), "archive"), (b"%PDF".hex(), None), ("1f", None), ("", None),
]
TEXTS = [(b"", False), (b"plain", True), (b"\x7f" * 10, True), ("é".encode() * 20, True), (b"\x00" + b"a" * 9, True), (b"\x00\x01" + b"a" * 8, False), (b"\t\r\n" * 5, True), (b"a" * 64 + b"\x00" * 64, True)]
HINTS = [
    (b"\x16\x03\x01\x00\x05\x01\x00", "tcp", 443, "tls"), (b"\x16\x03\x01\x00\x05\x02\x00", "tcp", 443, None), (b"\x17\x03\x03\x00\x05\x01\x00", "tcp", 443, None), (b"GET / HTTP/1.1", "tcp", 80, "http"), (b"HTTP/1.1 200 OK", "tcp", 80, None), (b"\x00\x10xx", "tcp", 53, "dns"), (b"xx", "udp", 53, "dns"), (b"xx", "udp", 54, None),
]


def results(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", column.alias("got"))
    return [r["got"] for r in sorted(df.collect())]


@pytest.mark.parametrize(("cases", "rule"), [(CARDS, lambda t: D.card_number(t)), (SOCIAL, lambda t: D.social_number(t))])
def test_numbers_of_people(spark, cases, rule):
    assert results(spark, [(t,) for t, _ in cases], "t string", rule(F.col("t"))) == [w for _, w in cases]


def test_mining_and_logins(spark):
    assert results(spark, [c[:2] for c in STRATUM], "t string, p string", D.stratum_role(F.col("t"), F.col("p"))) == [c[2] for c in STRATUM]
    assert results(spark, [c[:3] for c in LOGINS], "t string, p string, d int", D.cleartext_credential(F.col("t"), F.col("d"), F.col("p"))) == [c[3] for c in LOGINS]


def test_files_texts_and_protocols(spark):
    assert results(spark, [(bytearray.fromhex(h),) for h, _ in FILES], "b binary", D.file_class(F.col("b"))) == [w for _, w in FILES]
    assert results(spark, [(bytearray(b),) for b, _ in TEXTS], "b binary", D.is_text(F.col("b"))) == [w for _, w in TEXTS]
    assert results(spark, [(bytearray(b), p, d) for b, p, d, _ in HINTS], "b binary, p string, d int", D.l7_hint(F.col("b"), F.col("p"), F.lit(40_000), F.col("d"))) == [h for *_, h in HINTS]
