"""Typed models: dataclasses as tables of a Database."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal
from typing import Any, get_args, get_type_hints

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.builder import Query, table

TYPES = {int: "bigint", float: "double", str: "varchar", bool: "boolean", date: "date", datetime: "datetime", Decimal: "decimal(28, 10)"}


def column(type: str | None = None, primary: bool = False, unique: bool = False, default: str | None = None, index: bool = False, **options) -> Any:  # noqa: A002
    """A field of a model: its SQL type if it isn't that of the annotation, and constraints."""
    return dataclasses.field(metadata={"type": type, "primary": primary, "unique": unique, "default": default, "index": index}, **options)


class Model:
    """The table of the dataclass `cls`, named in lower case or by `__table__`.
    A field of `T | None` may be null."""

    def __init__(self, db, cls: type):
        self.db, self.cls, self.name = db, cls, getattr(cls, "__table__", cls.__name__.lower())

    def columns(self) -> list[dict]:
        out, hints = [], get_type_hints(self.cls)
        for f in dataclasses.fields(self.cls):
            kinds = [x for x in get_args(hints[f.name]) or (hints[f.name],) if x is not type(None)]
            m = f.metadata
            out.append({"name": f.name.lower(), "type": m.get("type") or TYPES[kinds[0]], "primary": m.get("primary", False), "unique": m.get("unique", False), "nullable": type(None) in get_args(hints[f.name]), "default": m.get("default")})
        return out

    def create(self, if_not_exists: bool = False) -> None:
        self.db.create_table(self.name, self.columns(), if_not_exists)
        for f in dataclasses.fields(self.cls):
            if f.metadata.get("index"):
                self.db.create_index(f"{self.name}_{f.name}_index", self.name, [f.name], if_not_exists=if_not_exists)

    def migrate(self) -> None:
        """Create the table, or add, drop and retype its columns until it is as the model says."""
        there = {c["name"]: c for c in self.db.begin().state["tables"].get(self.name, {"columns": []})["columns"]}
        if not there:
            return self.create()
        wanted = {c["name"]: c for c in self.columns()}
        for name in there.keys() - wanted.keys():
            self.db.drop_column(self.name, name)
        for name, c in wanted.items():
            if name not in there:
                self.db.add_column(self.name, c)
            elif there[name]["type"] != c["type"]:
                self.db.change_column(self.name, name, type=c["type"])

    def drop(self, if_exists: bool = False) -> None:
        self.db.drop_table(self.name, if_exists)

    def _rows(self, items):
        return self.db.spark.createDataFrame([dataclasses.astuple(x) for x in items], self.db.table(self.name).schema)

    def insert(self, *items) -> int:
        return self.db.insert(self.name, self._rows(items))

    def save(self, *items) -> int:
        """Insert, or replace what has the same key."""
        return self.db.upsert(self.name, self._rows(items))

    def query(self) -> Query:
        return table(self.db.table(self.name))

    def fetch(self, condition: Column | None = None) -> Iterator:
        """Objects of the rows that match, a partition on the driver at a time."""
        rows = self.db.table(self.name)
        return (self.cls(*r) for r in (rows if condition is None else rows.where(condition)).toLocalIterator())

    def get(self, *key):
        """The object of a primary key, or None."""
        names = [c["name"] for c in self.columns() if c["primary"]]
        condition = F.lit(True)
        for name, value in zip(names, key, strict=True):
            condition &= F.col(name) == value
        return next(self.fetch(condition), None)

    def update(self, condition: Column | None, **values) -> int:
        return self.db.update(self.name, {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}, condition)

    def delete(self, condition: Column | None = None) -> int:
        return self.db.delete(self.name, condition)
