"""The queries against their SQL on the driver's table of 1000 documents."""

from __future__ import annotations

import duckdb
import pytest

from weftline.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = duck.execute(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(c[0] for c in rel.description)
    want = rel.fetchall()
    found = [tuple(r) for r in df.select(*[c[0] for c in rel.description]).collect()]
    assert len(found) == len(want) and set(found) == set(want)
