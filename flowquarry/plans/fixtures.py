"""Packets, flows and feeds projected from the test tables by SQL that means the same in Spark and DuckDB.

Every event becomes one packet.  ``event_id mod 16`` gives its part in one of several scenes (an ordinary
exchange of four packets, a beacon, log-ins, scans, an upload, DNS and ICMP tunnels, plain-text
services, a flood; the host that scans is one of those that were logged in to), ``event_id div 16`` its place in the scene.  The first 1,000 events come once more in scenes that need a
fixed number of packets: a flood from 270 sources, 40 log-ins at one server, a megabyte of echo requests.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.tables import constant

BASE_NS = 1_704_067_200_000_000_000

def packet_sql(dialect: str, events: str = "events") -> str:
    """The packet projection in the SQL of ``spark`` or ``duckdb``."""
    spark = dialect == "spark"
    text = "string" if spark else "VARCHAR"
    us = "unix_micros(CAST(ts AS timestamp))" if spark else "epoch_us(ts)"

    def div(a: str, b: int) -> str:
        return f"({a} div {b})" if spark else f"({a} // {b})"

    def hx(first: str, *factors: int) -> str:
        """Hex of a product: in Spark of the whole one, which is beyond 64 bits from event 7,342,443 on, where the other SQL raises an error.

        The last 16 bits of ``first`` are multiplied apart.  ``ts_ns`` is beyond a long sooner than these steps are.
        """
        if not spark:
            return f"'' || lower(hex(CAST({' * '.join([first, *map(str, factors)])} AS BIGINT)))"
        p, low = math.prod(factors), f"({first} & 65535)"
        return f"'' || lower(hex(shiftright({first}, 16) * {p} + shiftright({low} * {p}, 16))) || lpad(lower(hex({low} * {p % 65536} & 65535)), 4, '0')"

    def cat(*parts: str) -> str:
        return "concat(" + ", ".join(p if p.startswith("'") else f"CAST({p} AS {text})" for p in parts) + ")"

    J = div("event_id", 16)
    again = [(300, "(event_id + 1000000) * 16 + 15"), (40, "(event_id + 100000) * 24 * 16 + 6"), (1000, "(event_id + 2000000) * 16 + 13")]
    ids = ", ".join(["event_id", *(f"CASE WHEN event_id < {n} THEN {x} END" for n, x in again)])
    each = (f"explode(array({ids}))" if spark else f"unnest([{ids}])") + " AS event_id"
    return f"""
SELECT e AS idx,
  CASE WHEN c IN (4, 5) THEN {BASE_NS} + j * 30000000000 + (c - 4) * 1000000
       WHEN c IN (6, 7) THEN {BASE_NS} + j * 2000000000 + (c - 6) * 1000000
       ELSE us * 1000 END AS ts_ns,
  NOT (c = 15 AND j % 97 = 5) AS ts_known,
  CASE WHEN c = 10 THEN 60000 WHEN c = 13 THEN 1066 WHEN c IN (6, 7) THEN 654 WHEN c IN (8, 9, 15) THEN 60 ELSE 64 + (e * 31) % 1400 END AS wire_len,
  CASE WHEN c = 10 THEN 1500 WHEN c = 13 THEN 1066 WHEN c IN (6, 7) THEN 654 WHEN c IN (8, 9, 15) THEN 60 ELSE 64 + (e * 31) % 1400 END AS cap_len,
  CASE WHEN c = 15 AND j % 10 = 0 THEN 'arp' ELSE 'ipv4' END AS l3,
  CASE WHEN c = 15 AND j % 10 = 0 THEN NULL WHEN c = 13 THEN 'icmp' WHEN c IN (11, 12) THEN 'udp' WHEN c < 4 AND j % 10 = 4 THEN 'udp' WHEN c = 14 AND j % 11 = 0 THEN 'udp' ELSE 'tcp' END AS transport,
  CASE WHEN c = 15 AND j % 10 = 0 THEN NULL WHEN c IN (1, 3) THEN server WHEN c = 5 THEN '45.77.1.9' WHEN c = 7 THEN {cat("'10.0.9.'", 'j % 8 + 1')}
       WHEN c IN (0, 2) THEN client WHEN c = 4 THEN '10.0.1.5' WHEN c = 6 THEN {cat("'10.0.2.'", 'j % 3 + 1')} WHEN c = 8 THEN '10.0.9.3' WHEN c = 9 THEN '10.0.3.8'
       WHEN c = 10 THEN '10.0.4.4' WHEN c = 11 THEN '10.0.5.5' WHEN c = 12 THEN '10.0.5.6' WHEN c = 13 THEN '10.0.6.6' WHEN c = 14 THEN {cat("'10.0.8.'", 'j % 6 + 1')} ELSE {cat("'10.1.'", 'j % 250', "'.'", 'j % 241')} END AS src_ip,
  CASE WHEN c = 15 AND j % 10 = 0 THEN NULL WHEN c IN (1, 3) THEN client WHEN c = 5 THEN '10.0.1.5' WHEN c = 7 THEN {cat("'10.0.2.'", 'j % 3 + 1')}
       WHEN c IN (0, 2) THEN server WHEN c = 4 THEN '45.77.1.9' WHEN c = 6 THEN {cat("'10.0.9.'", 'j % 8 + 1')} WHEN c = 8 THEN '10.0.9.50' WHEN c = 9 THEN {cat("'10.0.12.'", 'j % 200 + 1')}
       WHEN c = 10 THEN '185.10.10.10' WHEN c IN (11, 12) THEN '10.0.9.53' WHEN c = 13 THEN '203.0.114.5' WHEN c = 14 THEN '10.0.9.80' ELSE '10.0.9.99' END AS dst_ip,
  CASE WHEN c = 15 AND j % 10 = 0 THEN NULL WHEN c = 13 THEN 0 WHEN c IN (1, 3) THEN sport WHEN c = 5 THEN 8081 WHEN c = 7 THEN 22 WHEN c = 10 THEN 40000
       WHEN c IN (0, 2) THEN 1024 + (j * 7919) % 60000 WHEN c = 4 THEN 49152 + j % 16000 WHEN c = 14 AND j % 11 = 0 THEN 68 ELSE 1024 + (e * 7919) % 60000 END AS src_port,
  CASE WHEN c = 15 AND j % 10 = 0 THEN NULL WHEN c = 13 THEN 0 WHEN c IN (1, 3) THEN 1024 + (j * 7919) % 60000 WHEN c = 5 THEN 49152 + j % 16000 WHEN c = 7 THEN 1024 + ((e - 1) * 7919) % 60000
       WHEN c IN (0, 2) THEN sport WHEN c = 4 THEN 8081 WHEN c = 6 THEN 22 WHEN c = 8 THEN 1000 + j % 400 WHEN c = 9 THEN 445 WHEN c = 10 THEN 443 WHEN c IN (11, 12) THEN 53
       WHEN c = 14 AND j % 11 = 0 THEN 67 WHEN c = 14 AND j % 11 = 1 THEN 502 WHEN c = 14 AND j % 11 = 2 THEN 21 ELSE 80 END AS dst_port,
  CASE WHEN c = 15 AND j % 10 = 0 THEN NULL WHEN c IN (11, 12, 13) THEN NULL WHEN c < 4 AND j % 10 = 4 THEN NULL WHEN c = 14 AND j % 11 = 0 THEN NULL
       WHEN c = 0 THEN 2 WHEN c = 1 THEN CASE WHEN j % 10 = 9 THEN 4 ELSE 18 END WHEN c IN (8, 9, 15) THEN 2 WHEN c = 6 THEN 2 WHEN c = 7 THEN 18 ELSE 24 END AS tcp_flags,
  CASE WHEN c = 15 AND j % 10 = 0 THEN NULL ELSE 32 + 32 * (e % 4) END AS ttl,
  CASE WHEN c = 13 THEN 1032 WHEN c IN (6, 7) THEN 600 WHEN c IN (0, 1, 8, 9, 15) THEN 0 ELSE 10 + (e * 31) % 1400 END AS payload_len,
  CASE WHEN c IN (2, 3) AND j % 10 < 3 THEN 'tls' WHEN c IN (2, 3) AND j % 10 = 5 THEN 'http' WHEN c IN (11, 12) OR (c < 4 AND j % 10 = 4) THEN 'dns' WHEN c = 14 AND j % 11 = 1 THEN 'modbus' WHEN c = 14 AND j % 11 > 2 THEN 'http' END AS app_proto,
  CASE WHEN c = 2 AND j % 10 < 3 THEN CASE j % 30 WHEN 1 THEN 'dns.google' WHEN 11 THEN 'login.bad-site.example' ELSE {cat("'host'", 'j % 17', "'.example.org'")} END END AS sni,
  CASE WHEN c = 2 AND j % 10 < 3 THEN {cat("'ja3-'", 'j % 6')} END AS ja3,
  CASE WHEN c = 2 AND j % 10 < 3 THEN {cat("'ja4-'", 'j % 5')} END AS ja4,
  CASE WHEN c = 3 AND j % 10 < 3 THEN {cat("'ja3s-'", 'j % 4')} END AS ja3s,
  CASE WHEN c = 11 THEN {cat(hx('(j + 1)', 7919, 104729, 3571), hx('(j + 7)', 15485863, 6151, 211), hx('(j + 3)', 32452843, 9973, 17), "'.t.tunnel.example'")}
       WHEN c = 12 THEN {cat(hx('(j + 11)', 7919, 104729, 3571), "'.net'")} WHEN c = 0 AND j % 10 = 4 THEN {cat("'host'", 'j % 17', "'.example.org'")} END AS dns_qname,
  CASE WHEN c = 1 AND j % 10 = 4 THEN {cat("'93.184.216.'", 'j % 20')} END AS dns_answer,
  CASE WHEN c = 2 AND j % 10 = 5 THEN {cat("'www'", 'j % 5', "'.example.com'")} WHEN c = 14 AND j % 11 > 2 THEN 'intranet.local' END AS http_host,
  CASE WHEN c = 2 AND j % 10 = 5 THEN 'Mozilla/5.0' WHEN c = 14 AND j % 11 = 3 THEN 'sqlmap/1.7 (https://sqlmap.org)' WHEN c = 14 AND j % 11 = 4 THEN 'Nikto/2.5' WHEN c = 14 AND j % 11 > 4 THEN 'curl/8.0' END AS http_ua,
  CASE WHEN c = 14 AND j % 11 = 2 THEN 'FTP' WHEN c = 14 AND j % 11 = 5 THEN 'HTTP Basic' END AS cleartext_cred,
  CASE WHEN c = 14 AND j % 11 = 6 THEN 'card' WHEN c = 14 AND j % 11 = 7 THEN 'ssn' END AS pii,
  CASE WHEN c = 13 THEN 8 END AS icmp_type,
  CASE WHEN c = 15 AND j % 10 = 0 THEN {cat("'10.0.7.'", 'j % 3 + 1')} END AS arp_ip,
  CASE WHEN c = 15 AND j % 10 = 0 THEN {cat("'02:00:00:00:00:0'", 'j % 4')} END AS arp_mac,
  CASE WHEN c = 3 AND j % 10 < 3 THEN CASE j % 7 WHEN 0 THEN 'TLS 1.0' WHEN 1 THEN 'TLS 1.2' ELSE 'TLS 1.3' END END AS tls_version,
  CASE WHEN c = 3 AND j % 10 < 3 THEN CASE j % 5 WHEN 0 THEN 'TLS_RSA_WITH_RC4_128_SHA' ELSE 'TLS_AES_128_GCM_SHA256' END END AS tls_cipher,
  CASE WHEN c = 6 THEN {cat("'hassh-'", 'j % 3')} END AS hassh,
  CASE WHEN c = 7 THEN {cat("'hasshs-'", 'j % 2')} END AS hassh_server,
  CASE WHEN c = 3 AND j % 10 = 5 THEN CASE j % 4 WHEN 1 THEN 'executable' ELSE 'archive' END END AS download,
  c = 3 AND j % 10 = 5 AND j % 4 = 1 AS download_disguised,
  CASE WHEN c = 14 AND j % 11 = 8 THEN 'miner' WHEN c = 14 AND j % 11 = 9 THEN 'pool' END AS stratum,
  CASE WHEN c = 14 AND j % 11 = 0 THEN {cat("'02:00:00:00:00:0'", 'j % 4')} END AS dhcp_mac,
  CASE WHEN c = 14 AND j % 11 = 0 AND j % 2 = 0 THEN {cat("'laptop-'", 'j % 4')} END AS dhcp_hostname,
  CASE WHEN c = 14 AND j % 11 = 0 THEN 'MSFT 5.0' END AS dhcp_vendor,
  CASE WHEN c = 14 AND j % 11 = 1 THEN {cat("'write '", '5 + j % 2')} END AS ot_control
FROM (SELECT event_id AS e, event_id % 16 AS c, {div('event_id', 16)} AS j, {us} AS us,
    {cat("'10.0.'", f'{J} % 7', "'.'", f'{J} % 50 + 1')} AS client,
    CASE {J} % 10 WHEN 4 THEN '8.8.8.8' WHEN 5 THEN {cat("'10.0.9.'", f'{J} % 5 + 1')} WHEN 6 THEN {cat("'203.0.113.'", f'{J} % 9')} WHEN 7 THEN CASE WHEN {J} % 20 = 17 THEN '93.184.217.9' ELSE {cat("'10.0.9.'", f'{J} % 5 + 1')} END WHEN 8 THEN '52.1.2.3' WHEN 9 THEN '10.0.20.1' ELSE {cat("'93.184.216.'", f'{J} % 20')} END AS server,
    CASE {J} % 10 WHEN 4 THEN 53 WHEN 5 THEN 80 WHEN 6 THEN 4444 WHEN 7 THEN 3389 WHEN 8 THEN 8443 WHEN 9 THEN 10000 + {J} % 2000 ELSE 443 END AS sport
  FROM (SELECT {each}, ts FROM {events}) AS source WHERE event_id IS NOT NULL) AS scene
"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(packet_sql("spark", "{events}"), events=events).withColumn("dns_answers", F.when(F.col("dns_answer").isNotNull(), F.array("dns_answer"))).drop("dns_answer")


#: A threat feed that the packets meet in each of its dimensions.
FEED = [("ip", "45.77.1.9"), ("cidr", "203.0.113.0/29"), ("cidr", "185.10.0.0/16"), ("domain", "host3.example.org"), ("suffix", "bad-site.example"), ("ja3", "ja3-4"), ("ja4", "ja4-9")]


def feed(spark: SparkSession) -> DataFrame:
    return constant(spark, FEED, "kind string, value string")
