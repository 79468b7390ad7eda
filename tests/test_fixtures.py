"""The packet projection on events of large numbers, whose generated names are beyond 64 bits."""

from __future__ import annotations

import datetime

import duckdb

from flowquarry.plans import fixtures
from flowquarry.plans.queries import QUERIES

FACTORS = {1: 7919 * 104729 * 3571, 7: 15485863 * 6151 * 211, 3: 32452843 * 9973 * 17}


def _events(spark, folder, ids):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=n)) for n, i in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def _names(spark, folder):
    return {r.idx: r.dns_qname for r in fixtures.packets(spark, folder).filter("idx % 16 in (11, 12)").select("idx", "dns_qname").collect()}


def test_names_of_large_events_are_whole(spark, tmp_path):
    # The last and the first event of each product within and beyond a long, and some far beyond.
    ids = [11, 12, 7342427, 7342443, 26821403, 26821419, 49828876, 49828892, 49829035, 49829051, 35_999_995, 35_999_996, 4_000_000_011, 16 * 10**10 + 11, 16 * 10**10 + 12]
    want = {e: "".join(f"{(e // 16 + plus) * f:x}" for plus, f in FACTORS.items()) + ".t.tunnel.example" if e % 16 == 11 else f"{(e // 16 + 11) * FACTORS[1]:x}.net" for e in ids}
    assert _names(spark, _events(spark, tmp_path, ids)) == want


def test_names_are_those_of_the_sql_where_it_has_some(spark, tmp_path):
    ids = [*range(0, 4000, 7), *range(7_340_000, 7_342_443), 49828876]
    folder = _events(spark, tmp_path, ids)
    sql = fixtures.packet_sql("duckdb", f"read_parquet('{folder}/events.parquet/*.parquet')")
    assert _names(spark, folder) == dict(duckdb.sql(f"SELECT idx, dns_qname FROM ({sql}) WHERE idx % 16 IN (11, 12)").fetchall())


def test_rule_fold_of_large_events(spark, tmp_path):
    folder = _events(spark, tmp_path, range(35_998_000, 36_000_000))
    told = {r.host: r.narrative for r in QUERIES["det_rule_fold"](spark, folder).select("host", "narrative").collect()}
    assert "dns tunnel" in told["10.0.5.5"] and "dga" in told["10.0.5.6"]
    assert any("rule match" in x for x in told.values())
