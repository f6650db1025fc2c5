"""Database: tables with constraints, DML, DDL and transactions over snapshots."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tessera import dialect
from tessera.dialect import closing, tokens
from tessera.functions.table_functions import register_scalar, register_table
from tessera.sources.csv import copy_from, copy_to
from tessera.store import TableStore, scratch_folder
from tessera.types import LogicalType, parse_type

NAME = r"(?:[A-Za-z_]\w*|`\w+`|\"\w+\")"
#: Buckets of a histogram, and frequent values of a column.
HISTOGRAM, TOP = 32, 10


class ConstraintError(ValueError):
    pass


class Database:
    """`run` takes queries and DML, `ddl` schema changes, `analyze` statistics.

    Every statement is a transaction of its own, unless it is one of a
    `Transaction` from `begin`, whose statements see the version it began with
    (repeatable read; or the latest at each statement, read committed) and its
    own changes.
    """

    def __init__(self, spark: SparkSession, folder: str, compat: bool = False):
        """compat: functions of null and division by zero as in `dialect.compat_forms`."""
        self.spark, self.store, self.compat = spark, TableStore(spark, folder), compat

    @classmethod
    def scratch(cls, spark: SparkSession) -> Database:
        return cls(spark, scratch_folder(spark))

    in_memory = scratch

    def begin(self, isolation: str = "repeatable read") -> Transaction:
        return Transaction(self, isolation)

    def load(self, name: str, f, returns: str) -> None:
        """A function for this session's SQL: a class with `eval` is a table function,
        which `TABLE(name(..))` reads; any other callable gets and gives pandas series."""
        (register_table if isinstance(f, type) else register_scalar)(self.spark, name, f, returns)

    def checkpoint(self, folder: str) -> None:
        self.store.copy_to(folder)

    def __getattr__(self, name: str):
        """Any operation of a transaction, committed at once."""
        if name.startswith("_") or not hasattr(Transaction, name):
            raise AttributeError(name)

        def once(*args, **kwargs):
            txn = self.begin()
            out = getattr(txn, name)(*args, **kwargs)
            txn.commit()
            return out

        return once


class Transaction:
    def __init__(self, db: Database, isolation: str):
        if isolation not in ("repeatable read", "read committed"):
            raise ValueError(f"isolation {isolation!r}")
        self.db, self.spark, self.store, self.isolation = db, db.spark, db.store, isolation
        self.base = self.store.latest()
        self.state = self.store.state(self.base)
        self.touched: set[str] = set()

    # Transactions

    def commit(self) -> None:
        if self.touched:
            self.base = self.store.commit(self.base, self.state, self.touched)
            self.touched = set()

    def rollback(self) -> None:
        self.touched = set()
        self.state = self.store.state(self.base)

    def _refresh(self) -> None:
        if self.isolation == "read committed" and not self.touched:
            self.base = self.store.latest()
            self.state = self.store.state(self.base)

    # Reading

    def _entry(self, name: str) -> dict:
        self._refresh()
        try:
            return self.state["tables"][name.lower()]
        except KeyError:
            raise ValueError(f"table {name} not found") from None

    def table(self, name: str) -> DataFrame:
        entry = self._entry(name)
        ddl = ", ".join(f"`{c['name']}` {parse_type(c['type']).spark}" for c in entry["columns"])
        return self.spark.read.schema(ddl).parquet(entry["path"])

    def query(self, text: str, *args, **params) -> DataFrame:
        """SELECT text in this package's dialect; `$1` is the first of `args`, `:name`
        or `$name` a parameter of `params`. Tables and views are names of this
        transaction alone: they are taken back from the session once the query is
        resolved."""
        self._refresh()
        named = {x.lower().strip('`"') for x in tokens(text)}
        # A view may name others, and those tables.
        wanted, todo = set(), list(named)
        while todo:
            if (name := todo.pop()) not in wanted:
                wanted.add(name)
                if name in self.state["views"]:
                    todo += [x.lower().strip('`"') for x in tokens(self.state["views"][name]["sql"])]
        made = [name for name in self.state["tables"] if name in wanted]
        try:
            for name in made:
                self.table(name).createOrReplaceTempView(name)
            for name, view in self.state["views"].items():
                if name not in wanted:
                    continue
                rows = dialect.run(self.spark, view["sql"], compat=self.db.compat)
                if view["columns"]:
                    rows = rows.select(*rows.columns[: len(view["columns"])]).toDF(*view["columns"])
                made.append(name)
                rows.createOrReplaceTempView(name)
            return dialect.run(self.spark, text, params | {f"_{i}": x for i, x in enumerate(args, 1)}, self.db.compat)
        finally:
            for name in made:
                self.spark.catalog.dropTempView(name)

    def show_tables(self) -> DataFrame:
        return self._strings("TABLE", sorted(self.state["tables"]))

    def show_views(self) -> DataFrame:
        return self._strings("VIEW", sorted(self.state["views"]))

    def _strings(self, column: str, values: Iterable) -> DataFrame:
        return self.spark.createDataFrame([(str(v),) for v in values], f"`{column}` string")

    def describe(self, name: str) -> DataFrame:
        rows = []
        for c in self._entry(name)["columns"]:
            kind = parse_type(c["type"])
            key = "PRIMARY" if c["primary"] else "UNIQUE" if c["unique"] else "EMPTY"
            rows.append((c["name"], c["type"].upper(), str(kind.length or ""), str(c["nullable"]).lower(), key, c["default"] or "null", f"{name.lower()}.{c['name']}"))
        return self.spark.createDataFrame(rows, "FIELD string, TYPE string, LEN string, `NULL` string, Key string, DEFAULT string, COLUMN_REF string")

    def explain(self, text: str) -> DataFrame:
        plan = self.query(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self._strings("PLAN", [plan])

    def analyze(self, name: str) -> DataFrame:
        """For each column: rows, nulls, distinct values (HyperLogLog), least, largest, an
        equi-depth histogram of numbers (Greenwald and Khanna's quantiles), the most
        frequent values, and a count-min sketch. One pass, and one more for the
        frequent values; kept in the catalog, as `statistics` tells."""
        rows = self.table(name)
        out = []
        for c, kind in rows.dtypes:
            number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
            x = F.col(f"`{c}`")
            histogram = F.percentile_approx(x.cast("double"), [i / HISTOGRAM for i in range(1, HISTOGRAM)]) if number else F.lit(None).cast("array<double>")
            sketch = F.base64(F.count_min_sketch(x.cast("string"), F.lit(0.001), F.lit(0.99), F.lit(7)))
            out.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(x.isNull()).alias("nulls"), F.approx_count_distinct(x).alias("distinct"), F.min(x).cast("string").alias("least"), F.max(x).cast("string").alias("most"), histogram.alias("histogram"), sketch.alias("sketch")))
        found = [r.s.asDict() for r in rows.agg(F.array(*out).alias("s")).select(F.explode("s").alias("s")).collect()]
        values = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in rows.columns)))
        counted = rows.select(values.alias("v")).where("v.value is not null").groupBy("v.column", "v.value").agg(F.count("*").alias("n"))
        # Each task keeps TOP of a column's values, then one for all: never all of a column's.
        rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "value"))
        most: dict[str, list] = {}
        for r in counted.withColumn("rank", rank).where(F.col("rank") <= TOP).orderBy("column", "rank").collect():
            most.setdefault(r["column"], []).append([r.value, r.n])
        for x in found:
            x["frequent"] = most.get(x["column"], [])
        self.state["tables"][name.lower()] = self._entry(name) | {"statistics": found}
        self.touched.add(name.lower())
        return self.statistics(name)

    def statistics(self, name: str) -> DataFrame:
        """What the last ANALYZE of the table found; no rows before."""
        kept = self._entry(name).get("statistics", [])
        rows = [(x["column"], x["rows"], x["nulls"], x["distinct"], x["least"], x["most"], x["histogram"], [tuple(y) for y in x["frequent"]], x["sketch"]) for x in kept]
        return self.spark.createDataFrame(rows, "column string, rows long, nulls long, distinct long, least string, most string, histogram array<double>, frequent array<struct<value:string,n:long>>, sketch string")

    def estimate(self, name: str, column: str, value) -> int:
        """How often `column` holds `value`, at least, by the sketch of the last ANALYZE: too many by 0.1 % of the rows at most, in 99 of 100 cases."""
        (sketch,) = (x["sketch"] for x in self._entry(name)["statistics"] if x["column"] == column.lower())
        stream = self.spark._jvm.java.io.ByteArrayInputStream(base64.b64decode(sketch))
        return self.spark._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(stream).estimateCount(str(value))

    # Writing

    def _checked(self, entry: dict, rows: DataFrame, report: bool = True) -> DataFrame:
        """`rows` with the table's columns and types; a value that doesn't fit is an error."""
        given = {c.lower(): c for c in rows.columns}
        made = []
        for c in entry["columns"]:
            kind: LogicalType = parse_type(c["type"])
            if c["name"] in given:
                value = F.col(f"`{given[c['name']]}`")
            else:
                value = F.expr(c["default"]) if c["default"] else F.lit(None)
            value = value.cast(kind.spark)
            made.append(value.alias(c["name"]))
        out = rows.select(*made)
        if report:
            self._report(entry, out)
        return out

    def _report(self, entry: dict, out: DataFrame) -> None:
        bad = []
        for c in entry["columns"]:
            if not c["nullable"]:
                bad.append((F.col(f"`{c['name']}`").isNull(), f"{c['name']} is null"))
            if (wrong := parse_type(c["type"]).violation(F.col(f"`{c['name']}`"))) is not None:
                bad.append((wrong, f"{c['name']} does not fit {c['type']}"))
        if bad:
            counts = out.agg(*(F.count_if(F.coalesce(b, F.lit(False))).alias(f"b{i}") for i, (b, _) in enumerate(bad))).first()
            for n, (_, what) in zip(counts, bad, strict=True):
                if n:
                    raise ConstraintError(f"{n} rows: {what}")

    def _unique(self, entry: dict, rows: DataFrame) -> None:
        keys = [[c["name"] for c in entry["columns"] if c["primary"]]] + [[c["name"]] for c in entry["columns"] if c["unique"]] + [i["columns"] for i in entry["indexes"].values() if i["unique"]]
        for key in filter(None, keys):
            known = rows.where(" and ".join(f"`{k}` is not null" for k in key))
            if known.groupBy(*key).count().where("count > 1").take(1):
                raise ConstraintError(f"duplicate key ({', '.join(key)})")

    def _replace(self, name: str, rows: DataFrame, check: bool = True, unique: bool = False) -> None:
        entry = self._entry(name)
        if check:
            rows = self._checked(entry, rows)
        path = self.store.write(rows, name.lower())
        written = self.spark.read.schema(rows.schema).parquet(path)
        if check or unique:
            self._unique(entry, written)
        self.state["tables"][name.lower()] = entry | {"path": path}
        self.touched.add(name.lower())

    def _key(self, name: str) -> list[str]:
        return [c["name"] for c in self._entry(name)["columns"] if c["primary"]]

    def insert(self, name: str, rows: DataFrame) -> int:
        new = self._stored(name, rows)
        self._replace(name, self.table(name).unionByName(new), check=False, unique=True)
        return new.count()

    def upsert(self, name: str, rows: DataFrame) -> int:
        """Rows replace those of the same primary key (INSERT OVERWRITE)."""
        new = self._stored(name, rows)
        self._replace(name, self.table(name).join(new, self._key(name), "left_anti").select(*new.columns).unionByName(new), check=False, unique=True)
        return new.count()

    def _stored(self, name: str, rows: DataFrame) -> DataFrame:
        """`rows` written once: what is checked, counted and added is the same, whatever made them."""
        path = self.store.write(self._checked(self._entry(name), rows, report=False), name.lower())
        written = self.spark.read.parquet(path)
        self._report(self._entry(name), written)
        return written

    def update(self, name: str, values: dict[str, str | Column], where: str | Column | None = None, source: DataFrame | None = None, on: Column | None = None, how: str = "inner") -> int:
        """Set `values` in rows that match; with a `source`, in rows that join with it
        under `on`, from the joined row: in a left join, rows of the table without
        a partner too, from nulls. Of several partners the one that gives the least
        values counts. The old alias of the table is its name."""
        old = self.table(name).alias(name)
        expr = lambda v: v if isinstance(v, Column) else F.expr(v)
        condition = F.lit(True) if where is None else expr(where)
        key = self._key(name)
        if source is None:
            hit = F.coalesce(condition, F.lit(False))
            count = old.where(hit).count()
            self._replace(name, old.select(*(F.when(hit, expr(values[c]).cast(t)).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c, t in old.dtypes)))
            return count
        joined = old.join(source, on, "left" if how in ("left", "full") else "inner").where(condition)
        made = joined.select(*(F.col(f"{name}.{k}").alias(k) for k in key), F.struct(*(expr(v).alias(f"__new_{c}") for c, v in values.items())).alias("__new"))
        changed = made.groupBy(*key).agg(F.min("__new").alias("__new")).select(*key, "__new.*").withColumn("__hit", F.lit(True))
        count = changed.count()
        both = self.table(name).join(changed, key, "left")
        self._replace(name, both.select(*(F.when(F.col("__hit"), F.col(f"__new_{c}").cast(t)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c, t in old.dtypes)))
        return count

    def delete(self, name: str, where: str | Column | None = None, source: DataFrame | None = None, on: Column | None = None, how: str = "inner") -> int:
        """Remove rows that match; with a `source`, joined rows, as `update` joins them."""
        old = self.table(name).alias(name)
        condition = F.lit(True) if where is None else where if isinstance(where, Column) else F.expr(where)
        if source is None:
            kept = old.where(~F.coalesce(condition, F.lit(False)))
        else:
            key = self._key(name)
            gone = old.join(source, on, "left" if how in ("left", "full") else "inner").where(condition).select(*(F.col(f"{name}.{k}").alias(k) for k in key)).distinct()
            kept = self.table(name).join(gone, key, "left_anti").select(*old.columns)
        before = old.count()
        self._replace(name, kept, check=False)
        return before - self.table(name).count()

    def truncate(self, name: str) -> None:
        self._replace(name, self.table(name).limit(0), check=False)

    # Schema

    def create_table(self, name: str, columns: list[dict], if_not_exists: bool = False) -> None:
        name = name.lower()
        if name in self.state["tables"] or name in self.state["views"]:
            if if_not_exists:
                return
            raise ValueError(f"{name} exists")
        if not any(c["primary"] for c in columns):
            raise ValueError("a table needs a primary key")
        for c in columns:
            c["nullable"] = c["nullable"] and not c["primary"]
            if c["primary"] and re.match("float|double|decimal|boolean|real|num", c["type"]):
                raise ValueError(f"{c['type']} can't be a primary key")
        ddl = ", ".join(f"`{c['name']}` {parse_type(c['type']).spark}" for c in columns)
        path = self.store.write(self.spark.createDataFrame([], ddl), name)
        self.state["tables"][name] = {"columns": columns, "indexes": {}, "path": path}
        self.touched.add(name)

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if self.state["tables"].pop(name.lower(), None) is None and not if_exists:
            raise ValueError(f"table {name} not found")
        self.touched.add(name.lower())

    def create_view(self, name: str, text: str, columns: list[str] | None = None, replace: bool = False) -> None:
        name = name.lower()
        if name in self.state["tables"] or (name in self.state["views"] and not replace):
            raise ValueError(f"{name} exists")
        rows = self.query(text)
        if columns and len(columns) > len(rows.columns):
            raise ValueError("more names than columns")
        self.state["views"][name] = {"sql": text, "columns": columns or []}
        self.touched.add(name)

    def drop_view(self, name: str, if_exists: bool = False) -> None:
        if self.state["views"].pop(name.lower(), None) is None and not if_exists:
            raise ValueError(f"view {name} not found")
        self.touched.add(name.lower())

    def create_index(self, name: str, table: str, columns: list[str], unique: bool = False, if_not_exists: bool = False) -> None:
        entry = self._entry(table)
        if name in entry["indexes"]:
            if if_not_exists:
                return
            raise ValueError(f"index {name} exists")
        new = entry | {"indexes": entry["indexes"] | {name: {"columns": columns, "unique": unique}}}
        self._unique(new, self.table(table))
        self.state["tables"][table.lower()] = new
        self.touched.add(table.lower())

    def drop_index(self, table: str, name: str, if_exists: bool = False) -> None:
        if self._entry(table)["indexes"].pop(name, None) is None and not if_exists:
            raise ValueError(f"index {name} not found")
        self.touched.add(table.lower())

    def _column(self, table: str, name: str) -> dict:
        for c in self._entry(table)["columns"]:
            if c["name"] == name.lower():
                return c
        raise ValueError(f"column {name} not found")

    def add_column(self, table: str, column: dict, if_not_exists: bool = False) -> None:
        entry, rows = self._entry(table), self.table(table)
        if column["name"] in rows.columns:
            if if_not_exists:
                return
            raise ValueError(f"column {column['name']} exists")
        entry["columns"].append(column)
        self._replace(table, rows)

    def drop_column(self, table: str, name: str, if_exists: bool = False) -> None:
        entry, rows = self._entry(table), self.table(table)
        if name.lower() not in rows.columns:
            if if_exists:
                return
            raise ValueError(f"column {name} not found")
        if self._column(table, name)["primary"]:
            raise ValueError("a primary key column can't go")
        entry["columns"] = [c for c in entry["columns"] if c["name"] != name.lower()]
        self._replace(table, rows.drop(name))

    def change_column(self, table: str, name: str, new_name: str | None = None, type: str | None = None, **attributes) -> None:  # noqa: A002
        """Rename, cast, and set `default` or `nullable`; existing rows are checked."""
        entry, rows = self._entry(table), self.table(table)
        c = self._column(table, name)
        if type and (c["primary"] or c["unique"] or any(c["name"] in i["columns"] for i in entry["indexes"].values())):
            raise ValueError("the type of an indexed column can't change")
        if new_name:
            rows = rows.withColumnRenamed(c["name"], new_name.lower())
            for i in entry["indexes"].values():
                i["columns"] = [new_name.lower() if x == c["name"] else x for x in i["columns"]]
        c.update({k: v for k, v in (("name", new_name and new_name.lower()), ("type", type)) if v}, **attributes)
        self._replace(table, rows)

    # Statements

    def ddl(self, text: str) -> DataFrame:
        text = text.strip().rstrip(";").strip()
        for pattern, act in DDL:
            if m := re.fullmatch(pattern, text, re.I | re.S):
                title, value = act(self, bare(m.groupdict()))
                return self._strings(title, [value])
        raise ValueError(f"not a schema statement: {text[:60]}")

    def run(self, text: str, *args, **params) -> DataFrame:
        *first, text = statements(text)
        for x in first:
            self._run(x, args, params)
        return self._run(text, args, params)

    def rows(self, text: str, *args, **params) -> Iterator[Row]:
        """The rows of a query one after the other, a partition on the driver at a time."""
        return self.run(text, *args, **params).toLocalIterator()

    execute = run

    def _run(self, text: str, args: tuple, params: dict) -> DataFrame:
        for pattern, _ in DDL:
            if re.fullmatch(pattern, text, re.I | re.S):
                raise ValueError("schema statements go through ddl()")
        for pattern, act in DML:
            if m := re.fullmatch(pattern, text, re.I | re.S):
                out = act(self, bare(m.groupdict()))
                return out if isinstance(out, DataFrame) else self._strings(*[out[0], [out[1]]])
        return self.query(text, *args, **params)

    def _insert(self, g: dict) -> tuple[str, int]:
        names = [c["name"] for c in self._entry(g["t"])["columns"]]
        given = split(g["cols"]) if g["cols"] else names
        body = g["body"].strip()
        if re.match(r"values\b", body, re.I):
            defaults = [self._column(g["t"], c)["default"] or "null" for c in given]
            made = [[d if v.lower() == "default" else v for d, v in zip(defaults, split(row), strict=True)] for row in rows_of(body[6:])]
            text = "select * from values " + ", ".join(f"({', '.join(r)})" for r in made)
            rows = self.query(text).toDF(*given)
        else:
            rows = self.query(body)
            if not g["cols"] and {c.lower() for c in rows.columns} <= set(names):
                given = [c.lower() for c in rows.columns]
            rows = rows.toDF(*given)
        return "INSERTED", (self.upsert if g["over"] else self.insert)(g["t"], rows)

    def _update(self, g: dict) -> tuple[str, int]:
        values = {}
        for part in split(g["sets"]):
            if m := re.fullmatch(r"\((?P<n>.*?)\)\s*=\s*\((?P<v>.*)\)", part, re.S):
                values |= dict(zip((x.lower() for x in split(m["n"])), split(m["v"]), strict=True))
            else:
                k, _, v = part.partition("=")
                values[k.strip().rpartition(".")[2].lower()] = v.strip()
        values = {k: self._column(g["t"], k)["default"] or "null" if v.lower() == "default" else v for k, v in values.items()}
        source = self.table(g["src"]).alias(g["src"]) if g["src"] else None
        return "UPDATED", self.update(g["t"], values, g["where"], source, F.expr(g["on"]) if g["on"] else None, (g["how"] or "inner").lower())

    def _delete(self, g: dict) -> tuple[str, int]:
        source = self.table(g["src"]).alias(g["src"]) if g["src"] else None
        return "DELETED", self.delete(g["t"], g["where"], source, F.expr(g["on"]) if g["on"] else None, (g["how"] or "inner").lower())

    def _copy(self, g: dict) -> tuple[str, str]:
        options = {}
        for key, value in re.findall(r"(delimiter|quote|escape|header)\s*(?:'(.)'|)", g["opts"] or "", re.I):
            options[key.lower()] = True if key.lower() == "header" else value
        if g["dir"].lower() == "from":
            table = self.table(g["what"])
            return "COPY FROM SOURCE", str(self.insert(g["what"], copy_from(self.spark, g["path"], table.schema, **options)))
        rows = self.query(g["what"].strip("() ")) if g["what"].startswith("(") else self.table(g["what"])
        copy_to(rows, g["path"], **options)
        return "COPY TO TARGET", f"Copy To {g['path']} [{', '.join(rows.columns)}]"


def bare(groups: dict) -> dict:
    """Names without their quotes."""
    return {k: v.strip('`"') if k in ("t", "n", "c", "src") and v else v for k, v in groups.items()}


def split(text: str) -> list[str]:
    """Parts between commas that stand outside parentheses and quotes."""
    out, depth, now = [], 0, []
    for x in tokens(text):
        if x == "," and not depth:
            out.append("".join(now).strip())
            now = []
            continue
        depth += (x == "(") - (x == ")")
        now.append(x)
    return [*out, "".join(now).strip()]


def rows_of(text: str) -> list[str]:
    parts, out, i = tokens(text), [], 0
    while i < len(parts):
        if parts[i] == "(":
            close = closing(parts, i)
            out.append("".join(parts[i + 1 : close]))
            i = close
        i += 1
    return out


def statements(text: str) -> list[str]:
    out, now = [], []
    for x in tokens(text):
        if x == ";":
            out.append("".join(now).strip())
            now = []
        else:
            now.append(x)
    return [x for x in [*out, "".join(now).strip()] if x]


def column_of(text: str) -> dict:
    m = re.fullmatch(rf"(?P<name>{NAME})\s+(?P<type>.+?)(?P<rest>(\s+(primary\s+key|unique|not\s+null|null|default\s+.+))*)", text.strip(), re.I | re.S)
    if not m:
        raise ValueError(f"not a column: {text}")
    rest = m["rest"].lower()
    default = re.search(r"default\s+('(?:[^']|'')*'|\S+)", m["rest"], re.I)
    return {"name": m["name"].strip('`"').lower(), "type": parse_type(m["type"]).sql, "primary": "primary" in rest, "unique": "unique" in rest, "nullable": "not null" not in re.sub(r"\s+", " ", rest), "default": default[1] if default else None}


def _create(t: Transaction, g: dict) -> tuple[str, str]:
    columns, keys = [], []
    for part in split(g["cols"]):
        if m := re.fullmatch(r"(primary\s+key|unique)\s*\((.*)\)", part, re.I | re.S):
            keys.append((m[1].lower()[0] == "p", [x.lower() for x in split(m[2])]))
        elif re.match(r"(foreign|check|constraint)\b", part, re.I):
            raise ValueError("only PRIMARY KEY and UNIQUE constraints are offered")
        else:
            columns.append(column_of(part))
    for primary, names in keys:
        for c in columns:
            if c["name"] in names:
                c["primary" if primary else "unique"] = True
    t.create_table(g["t"], columns, bool(g["ine"]))
    return "CREATE TABLE SUCCESS", g["t"]


def _alter(t: Transaction, g: dict) -> tuple[str, str]:
    what = g["what"].strip()
    rules = [
        (r"add\s+(?:column\s+)?(?P<ine>if\s+not\s+exists\s+)?(?P<def>.+)", lambda m: t.add_column(g["t"], column_of(m["def"]), bool(m["ine"]))),
        (rf"drop\s+(?:column\s+)?(?P<ie>if\s+exists\s+)?(?P<c>{NAME})", lambda m: t.drop_column(g["t"], m["c"].strip('`"'), bool(m["ie"]))),
        (rf"rename\s+(?:column\s+)?(?P<c>{NAME})\s+to\s+(?P<n>{NAME})", lambda m: t.change_column(g["t"], m["c"], m["n"])),
        (rf"alter\s+(?:column\s+)?(?P<c>{NAME})\s+(?:set\s+data\s+)?type\s+(?P<k>.+)", lambda m: t.change_column(g["t"], m["c"], type=parse_type(m["k"]).sql)),
        (rf"alter\s+(?:column\s+)?(?P<c>{NAME})\s+set\s+default\s+(?P<v>.+)", lambda m: t.change_column(g["t"], m["c"], default=m["v"])),
        (rf"alter\s+(?:column\s+)?(?P<c>{NAME})\s+drop\s+default", lambda m: t.change_column(g["t"], m["c"], default=None)),
        (rf"alter\s+(?:column\s+)?(?P<c>{NAME})\s+(?P<s>set|drop)\s+not\s+null", lambda m: t.change_column(g["t"], m["c"], nullable=m["s"].lower() == "drop")),
        (r"modify\s+(?:column\s+)?(?P<def>.+)", lambda m: (lambda c: t.change_column(g["t"], c["name"], type=c["type"], nullable=c["nullable"], default=c["default"]))(column_of(m["def"]))),
        (rf"change\s+(?:column\s+)?(?P<c>{NAME})\s+(?P<def>.+)", lambda m: (lambda c: t.change_column(g["t"], m["c"], c["name"], c["type"], nullable=c["nullable"], default=c["default"]))(column_of(m["def"]))),
    ]
    for pattern, act in rules:
        if m := re.fullmatch(pattern, what, re.I | re.S):
            act(bare(m.groupdict()))
            return "ALTER TABLE SUCCESS", g["t"]
    raise ValueError(f"ALTER TABLE {what[:40]}")


def _done(title: str, act):
    return lambda t, g: (act(t, g), (title, next(v for v in (g.get("n"), g.get("t")) if v)))[1]


DDL = [
    (rf"create\s+table\s+(?P<ine>if\s+not\s+exists\s+)?(?P<t>{NAME})\s*\((?P<cols>.*)\)", _create),
    (rf"drop\s+table\s+(?P<ie>if\s+exists\s+)?(?P<t>{NAME})", _done("DROP TABLE SUCCESS", lambda t, g: t.drop_table(g["t"], bool(g["ie"])))),
    (rf"create\s+(?P<r>or\s+replace\s+)?view\s+(?P<t>{NAME})\s*(?:\((?P<cols>[^)]*)\))?\s+as\s+(?P<q>.*)", _done("CREATE VIEW SUCCESS", lambda t, g: t.create_view(g["t"], g["q"], [x.lower() for x in split(g["cols"])] if g["cols"] else None, bool(g["r"])))),
    (rf"drop\s+view\s+(?P<ie>if\s+exists\s+)?(?P<t>{NAME})", _done("DROP VIEW SUCCESS", lambda t, g: t.drop_view(g["t"], bool(g["ie"])))),
    (rf"create\s+(?P<u>unique\s+)?index\s+(?P<ine>if\s+not\s+exists\s+)?(?P<n>{NAME})\s+on\s+(?P<t>{NAME})\s*\((?P<cols>.*)\)", _done("CREATE INDEX SUCCESS", lambda t, g: t.create_index(g["n"], g["t"], [x.lower() for x in split(g["cols"])], bool(g["u"]), bool(g["ine"])))),
    (rf"drop\s+index\s+(?P<ie>if\s+exists\s+)?(?P<t>{NAME})\.(?P<n>{NAME})", _done("DROP INDEX SUCCESS", lambda t, g: t.drop_index(g["t"], g["n"], bool(g["ie"])))),
    (rf"alter\s+table\s+(?P<t>{NAME})\s+(?P<what>.*)", _alter),
]
DML = [
    (rf"insert\s+(?P<over>overwrite\s+)?(?:into\s+)?(?P<t>{NAME})\s*(?:\((?P<cols>[^()]*)\))?\s*(?P<body>(?:values|select|with|\().*)", Transaction._insert),
    (rf"update\s+(?P<t>{NAME})\s+(?:(?:(?P<how>inner|left|right|full)\s+(?:outer\s+)?)?join\s+(?P<src>{NAME})\s+on\s+(?P<on>.+?)\s+)?set\s+(?P<sets>.+?)(?:\s+where\s+(?P<where>.+))?", Transaction._update),
    (rf"delete\s+from\s+(?P<t>{NAME})(?:\s+(?:(?P<how>inner|left|right|full)\s+(?:outer\s+)?)?join\s+(?P<src>{NAME})\s+on\s+(?P<on>.+?))?(?:\s+where\s+(?P<where>.+))?", Transaction._delete),
    (rf"truncate\s+(?:table\s+)?(?P<t>{NAME})", lambda t, g: (t.truncate(g["t"]), ("TRUNCATE TABLE SUCCESS", g["t"]))[1]),
    (rf"analyze\s+table\s+(?P<t>{NAME})", lambda t, g: t.analyze(g["t"])),
    (r"show\s+tables", lambda t, g: t.show_tables()),
    (r"show\s+views", lambda t, g: t.show_views()),
    (rf"(?:describe|desc)\s+(?:table\s+)?(?P<t>{NAME})", lambda t, g: t.describe(g["t"])),
    (r"explain\s+(?P<q>.*)", lambda t, g: t.explain(g["q"])),
    (rf"copy\s+(?P<what>{NAME}|\(.*\))\s+(?P<dir>from|to)\s+'(?P<path>[^']*)'\s*(?P<opts>\(.*\))?", Transaction._copy),
    (rf"select\s+(?P<list>.*?)\s+into\s+(?P<t>{NAME})\s+(?P<rest>from\s.*)", lambda t, g: ("INSERTED", t.insert(g["t"], t.query(f"select {g['list']} {g['rest']}")))),
]
