"""A fluent query builder: each step is a DataFrame step, Catalyst does the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import subqueries


class Query:
    """Immutable; every method returns a new query over a DataFrame."""

    def __init__(self, df: DataFrame, keys: tuple = ()):
        self._df, self._keys = df, keys

    def build(self) -> DataFrame:
        return self._df

    def alias(self, name: str) -> Query:
        return Query(self._df.alias(name))

    def filter(self, condition: Column) -> Query:
        return Query(self._df.where(condition))

    having = filter

    def _join(self, other: Query | DataFrame, on, how: str) -> Query:
        return Query(self._df.join(other.build() if isinstance(other, Query) else other, on, how))

    def inner_join(self, other, on: Column) -> Query:
        return self._join(other, on, "inner")

    def left_join(self, other, on: Column) -> Query:
        return self._join(other, on, "left")

    def right_join(self, other, on: Column) -> Query:
        return self._join(other, on, "right")

    def full_join(self, other, on: Column) -> Query:
        return self._join(other, on, "full")

    def inner_join_using(self, other, *columns: str) -> Query:
        return self._join(other, list(columns), "inner")

    def left_join_using(self, other, *columns: str) -> Query:
        return self._join(other, list(columns), "left")

    def right_join_using(self, other, *columns: str) -> Query:
        return self._join(other, list(columns), "right")

    def full_join_using(self, other, *columns: str) -> Query:
        return self._join(other, list(columns), "full")

    def cross_join(self, other) -> Query:
        return Query(self._df.crossJoin(other.build() if isinstance(other, Query) else other))

    def project(self, *columns: str | Column) -> Query:
        return Query(self._df.select(*columns))

    def group_by(self, *keys: str | Column) -> Query:
        return Query(self._df, keys)

    def aggregate(self, **values: Column) -> Query:
        made = [v.alias(k) for k, v in values.items()]
        return Query(self._df.groupBy(*self._keys).agg(*made) if self._keys else self._df.agg(*made))

    def order_by(self, *keys: str | Column) -> Query:
        """Names sort ascending, names after `-` descending; nulls last in both."""
        return Query(self._df.orderBy(*(k if isinstance(k, Column) else F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys)))

    def distinct(self) -> Query:
        return Query(self._df.distinct())

    def limit(self, n: int) -> Query:
        return Query(self._df.limit(n))

    def offset(self, n: int) -> Query:
        return Query(self._df.offset(n))

    def union(self, other: Query, all: bool = False) -> Query:  # noqa: A002
        both = self._df.union(other._df)
        return Query(both if all else both.distinct())

    def except_(self, other: Query, all: bool = False) -> Query:  # noqa: A002
        return Query(self._df.exceptAll(other._df) if all else self._df.subtract(other._df))

    def intersect(self, other: Query, all: bool = False) -> Query:  # noqa: A002
        return Query(self._df.intersectAll(other._df) if all else self._df.intersect(other._df))

    def where_exists(self, other: Query, on: Column) -> Query:
        return self._join(other, on, "left_semi")

    def where_not_exists(self, other: Query, on: Column) -> Query:
        return self._join(other, on, "left_anti")

    def where_any(self, left: Column, op: str, other: Query) -> Query:
        return Query(subqueries.where_any(self._df, left, op, other.build()))

    def where_all(self, left: Column, op: str, other: Query) -> Query:
        return Query(subqueries.where_all(self._df, left, op, other.build()))

    def scalar(self) -> Column:
        """This query of one column and one row at most as a value of another: null without a row, an error for more."""
        return self._df.scalar()

    def insert_into(self, db, name: str) -> int:
        """INSERT .. SELECT into a table of a Database or Transaction."""
        return db.insert(name, self._df)

    def overwrite_into(self, db, name: str) -> int:
        """INSERT OVERWRITE .. SELECT: rows replace those of the same primary key."""
        return db.upsert(name, self._df)

    def count(self) -> int:
        return self._df.count()

    def exists(self) -> bool:
        return bool(self._df.take(1))


def table(df: DataFrame) -> Query:
    return Query(df)


class Change:
    """UPDATE and DELETE on a table of a Database, a condition or join at a time."""

    def __init__(self, db, name: str, condition: Column | None = None, source: tuple = ()):
        self._db, self._name, self._condition, self._source = db, name, condition, source

    def filter(self, condition: Column) -> Change:
        return Change(self._db, self._name, condition if self._condition is None else self._condition & condition, self._source)

    def join(self, source: Query | DataFrame, on: Column, how: str = "inner") -> Change:
        return Change(self._db, self._name, self._condition, (source.build() if isinstance(source, Query) else source, on, how))

    def update(self, **values: Column | str) -> int:
        return self._db.update(self._name, values, self._condition, *self._source)

    def delete(self) -> int:
        return self._db.delete(self._name, self._condition, *self._source)


def change(db, name: str) -> Change:
    return Change(db, name)
