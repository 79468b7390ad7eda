"""The console admits statements over its views, and nothing that reaches files, catalogs or the host."""

from __future__ import annotations

import pytest

from flowquarry.operators import console

DENIED = [
    "SELECT reflect('java.lang.System','getenv','HOME')", "select java_method('java.util.UUID', 'randomUUID')", "select try_reflect ('a', 'b')", "select `reflect`('a','b')", "SELECT * FROM text.`/etc/hostname`", "select * from csv.`hostname`", "SELECT * FROM `parquet`.`x`",
    "select * from org.apache.spark.sql.text.`x`", "select * from flow join json . `a` on true", "select * from spark_catalog.default.flow", "select * from global_temp.flow", "select * from x.`s3://b/k`", "with a as (select * from text.`/x`) select * from a", "select /* */ reflect /* */ ('a')",
]
ADMITTED = ["select f.src_ip, f.text from flow f", "select 'text.`/etc/hostname`' as x from flow", "select a.b.c from flow a", "select text from flow", "select reflect from flow -- reflect('a')", "with json as (select 1 as x) select x from json"]


@pytest.mark.parametrize("sql", DENIED)
def test_denied(sql):
    verdict = console.guard(sql)
    assert not verdict.ok and "not allowed" in verdict.reason


@pytest.mark.parametrize("sql", ADMITTED)
def test_admitted(sql):
    assert console.guard(sql).ok


def test_shipped_queries_pass():
    assert all(console.guard(q if isinstance(q, str) else q.sql).ok for q in console.QUERIES.values() if isinstance(q, str) or hasattr(q, "sql"))
