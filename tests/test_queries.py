"""Every registered query against its oracle, at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.tables import TABLES

NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    return value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, small, name):
    got = entry.queries()[name](spark, small)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    rows = lambda data: sorted((tuple(map(plain, r)) for r in data), key=repr)
    assert rows(got.collect()) == rows([tuple(r[i] for i in at) for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_csv_copies_the_whole_table(spark, small, monkeypatch):
    from tessera.sources import csv

    copied = []
    monkeypatch.setattr(csv, "copy_to", lambda rows, *a, f=csv.copy_to, **b: copied.append(f(rows, *a, **b)))
    entry.queries()["csv_round_trip"](spark, small).count()
    big = small.replace("sf0.001", "sf0.01")
    entry.queries()["csv_round_trip"](spark, big).count()
    assert copied == [spark.read.parquet(f"{d}/supplier.parquet").count() for d in (small, big)]


def test_casts_and_set_operations_have_whole_forms(spark, small):
    queries = entry.queries()
    table = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    assert queries["cast_forms_whole"](spark, small).count() == table("lineitem").count()
    assert queries["set_union_all_whole"](spark, small).count() == table("customer").count() + table("supplier").count()
    for op in ("union", "except", "except_all", "intersect", "intersect_all"):
        assert f"set_{op}_whole" in queries


def test_time_values_in_a_session_without_the_type(spark, duck, small):
    spark.conf.set("spark.sql.timeType.enabled", "false")
    try:
        got = entry.queries()["time_values"](spark, small)
        assert got.dtypes == [("event_id", "bigint"), ("late", "boolean"), ("clock", "string")]
        assert sorted(map(tuple, got.collect())) == sorted(duck.sql(entry.oracle_sql()["time_values"]).fetchall())
        assert got.join(got.select("event_id"), "event_id").count() == got.count()
    finally:
        spark.conf.set("spark.sql.timeType.enabled", "true")
