"""The operators that SQL can express, against their SQL."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from flowquarry.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert Counter(map(tuple, QUERIES[name](spark, SF).select(*names).collect())) == Counter(want.fetchall())
