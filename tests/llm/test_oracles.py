"""The operators that SQL can express against their oracle SQL."""

import duckdb
import pytest

from tessera.llm.queries import ORACLES, QUERIES
from tessera.tables import TABLES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_oracle(spark, name, size):
    path = f"/root/testdata/{size}"
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from '{path}/{t}.parquet'")
    got = QUERIES[name](spark, path)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
