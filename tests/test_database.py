"""DDL, DML, constraints and transactions; dialect and compat functions."""

import pytest
from pyspark.sql import functions as F

from tessera import dialect
from tessera.api import ConstraintError, Database
from tessera.dialect import rewrite
from tessera.functions import scalars, table_functions
from tessera.operators import subqueries
from tessera.store import Conflict
from tessera.types import common_type, parse_type


@pytest.fixture
def db(spark):
    out = Database.scratch(spark)
    out.ddl("create table t (id int primary key, v bigint default 233, s varchar(5))")
    out.run("insert into t (id, s) values (1, 'a'), (2, 'b')")
    out.run("insert into t values (3, null, 'c,d'), (4, default, null)")
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_insert_and_constraints(db):
    assert rows(db.query("select * from t")) == [(1, 233, "a"), (2, 233, "b"), (3, None, "c,d"), (4, 233, None)]
    for bad in ("insert into t values (1, 1, 'x')", "insert into t values (null, 1, 'x')", "insert into t values (9, 1, 'toolong')"):
        with pytest.raises(ConstraintError):
            db.run(bad)
    assert db.table("t").count() == 4
    assert db.run("insert overwrite t values (1, 5, 'z')").first()["INSERTED"] == "1"
    assert rows(db.query("select v from t where id = 1")) == [(5,)]
    with pytest.raises(ValueError):
        db.run("create table u (id int primary key)")
    with pytest.raises(ValueError):
        db.ddl("create table u (id int)")


def test_update_delete_and_joins(db):
    assert db.run("update t set v = v + 1, s = 'q' where id < 3").first()["UPDATED"] == "2"
    assert rows(db.query("select id, v, s from t where id < 3")) == [(1, 234, "q"), (2, 234, "q")]
    db.ddl("create table src (id int primary key, w int)")
    db.run("insert into src values (2, 50), (4, 60)")
    assert db.run("update t join src on t.id = src.id set v = src.w where src.w > 55").first()["UPDATED"] == "1"
    assert rows(db.query("select v from t where id = 4")) == [(60,)]
    assert db.run("delete from t join src on t.id = src.id").first()["DELETED"] == "2"
    assert db.run("delete from t where id = 1").first()["DELETED"] == "1"
    db.run("truncate table t")
    assert db.table("t").count() == 0


def test_schema_changes(db):
    db.ddl("alter table t add column w int default 7")
    db.ddl("alter table t rename column s to name")
    db.ddl("alter table t alter column v type double")
    assert dict(db.table("t").dtypes) == {"id": "int", "v": "double", "name": "string", "w": "int"}
    assert rows(db.query("select distinct w from t")) == [(7,)]
    with pytest.raises(ConstraintError):
        db.ddl("alter table t alter column name set not null")
    with pytest.raises(ValueError):
        db.ddl("alter table t drop column id")
    db.ddl("alter table t drop column w")
    db.ddl("create unique index by_name on t (name)")
    with pytest.raises(ConstraintError):
        db.run("insert into t values (10, 1, 'a')")
    db.ddl("drop index t.by_name")
    db.ddl("create view v (k) as select id, v from t where id > 2")
    assert rows(db.query("select * from v")) == [(3,), (4,)]
    assert rows(db.run("show tables")) == [("t",)] and rows(db.run("show views")) == [("v",)]
    assert db.run("describe t").first().Key == "PRIMARY"
    assert "Scan parquet" in db.run("explain select * from t").first().PLAN
    assert db.analyze("t").where("column = 'id'").first()["rows"] == 4
    db.ddl("drop view v")
    db.ddl("drop table if exists t")
    assert db.run("show tables").count() == 0


def test_transactions(db):
    first, second, reader = db.begin(), db.begin(), db.begin()
    first.run("update t set v = 0")
    second.run("delete from t where id = 1")
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    assert reader.query("select sum(v) from t").first()[0] == 699  # its own version
    assert db.query("select sum(v) from t").first()[0] == 0
    undone = db.begin()
    undone.run("truncate t")
    undone.rollback()
    undone.commit()
    assert db.table("t").count() == 4
    fresh = db.begin("read committed")
    db.run("delete from t where id = 4")
    assert fresh.table("t").count() == 3


def test_copy_and_checkpoint(db, spark, tmp_path):
    db.run(f"copy t to '{tmp_path}/out' (delimiter '|' header)")
    db.ddl("create table back (id int primary key, v bigint, s varchar)")
    db.run(f"copy back from '{tmp_path}/out' (delimiter '|' header)")
    assert rows(db.table("back")) == rows(db.table("t"))
    (tmp_path / "trailing.tbl").write_text("7|1.5|one|\n8|2.5|two|\n")
    db.ddl("create table c (a int primary key, b float, c varchar(10))")
    db.run(f"copy c from '{tmp_path}/trailing.tbl' (delimiter '|')")
    assert rows(db.table("c")) == [(7, 1.5, "one"), (8, 2.5, "two")]
    db.checkpoint(f"file://{tmp_path}/copy")
    db.run("truncate t")
    assert Database(spark, f"file://{tmp_path}/copy").table("t").count() == 4


def test_dialect():
    assert "exists" in rewrite("select 1 from t where a > any (select b from u)")
    assert rewrite("select a from t order by a desc, b nulls first limit 3") == "select a from t order by a desc nulls last, b nulls first limit 3"
    assert rewrite("select 'order by x > any (select 1)'") == "select 'order by x > any (select 1)'"


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("inner", [[], [None], [2], [2, 3], [2, None], [1, 2, 3, None]])
def test_quantifiers(spark, op, inner):
    import operator

    f = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    left = [1, 2, 3, 4, None]
    t = spark.createDataFrame([(x,) for x in left], "a int")
    u = spark.createDataFrame([(x,) for x in inner], "b int")
    t.createOrReplaceTempView("qt")
    u.createOrReplaceTempView("qu")
    marks = {x: [None if x is None or y is None else f(x, y) for y in inner] for x in left}
    every = {x: False if False in m else None if None in m else True for x, m in marks.items()}
    some = {x: True if True in m else None if None in m else False for x, m in marks.items()}
    got = lambda df: sorted((r.a for r in df.collect()), key=repr)
    want = lambda d, v: sorted((x for x in left if d[x] is v), key=repr)
    assert got(subqueries.where_any(t, F.col("a"), op, u)) == want(some, True)
    assert got(subqueries.where_all(t, F.col("a"), op, u)) == want(every, True)
    for word, d in (("any", some), ("all", every)):
        assert got(spark.sql(rewrite(f"select a from qt where a {op} {word} (select b from qu)"))) == want(d, True)
        assert got(spark.sql(rewrite(f"select a from qt where not (a {op} {word} (select b from qu))"))) == want(d, False)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("substring('marigold' from 5)", "gold"), ("substring('marigold' from -4 for 9)", "gold"), ("substring('marigold', -13, 2)", "go"), ("substring('marigold' for 4)", "mari"),
        ("substring('marigold' from 9)", ""), ("substring('marigold' from 10)", None), ("substring('marigold' from 0)", ""), ("substring('marigold' from 5 for -1)", "gold"),
        ("substring('marigold' from null)", None), ("substring('marigold' for null)", None), ("substring(null for 2)", None), ("substring('éa' from 3)", "a"), ("substring('éa' from 2)", "\ufffda"),
        ("substring(substring('marigold' from 5) from 2 for 2)", "ol"), ("char_length(substring(null from 2))", 0),
        ("trim('  a b ')", "a b"), ("trim(both 'xy' from 'xyxyzyxxy')", "zyx"), ("trim(leading 'xy' from 'xyzxy')", "zxy"), ("trim(trailing 'zz' from 'azzz')", "az"), ("trim(trailing from 'a  ')", "a"), ("trim(Leading\n'xy' -- from here\nfrom 'xyz')", "z"),
        ("trim('.\\E' from '.\\E.\\Ea.\\E')", "a"), ("trim('x' from 'axx\n')", "axx\n"), ("trim('' from 'abc')", "abc"), ("trim(cast(null as string) from 'abc')", "abc"), ("trim('x' from null)", None), ("trim(concat('x', 'y') from 'xyz')", "z"),
    ],
)
def test_substring_and_trim_in_sql(spark, text, expected):
    assert dialect.run(spark, f"select {text} as v", compat=True).first().v == expected


def test_substring_in_group_and_join(spark):
    rows = "values ('abc'), ('abd'), ('xy') as t(v)"
    grouped = dialect.run(spark, f"select substring(v, 1, 2) as k, count(*) as n from {rows} group by substring(v, 1, 2) order by k", compat=True)
    assert [tuple(r) for r in grouped.collect()] == [("ab", 2), ("xy", 1)]
    joined = dialect.run(spark, f"select v from {rows} join values ('ab') as u(w) on substring(v from 1 for 2) = w where trim(v) <> 'abd'", compat=True)
    assert [r.v for r in joined.collect()] == ["abc"]


def test_compat_functions(spark):
    one = spark.createDataFrame([("abcabcx", None)], "s string, n string")
    got = one.select(
        scalars.trim_compat(F.col("s"), "abc").alias("a"), scalars.char_length_compat(F.col("n")).alias("b"), scalars.position_compat(F.lit("x"), F.col("s")).alias("c"),
        scalars.substring_compat(F.col("s"), F.lit(99)).alias("d"), scalars.safe_div(F.lit(1), F.lit(0)).alias("e"), scalars.like(F.lit("a\\b"), "a\\b").alias("f"),
    ).first()
    assert tuple(got) == ("x", 0, 7, None, float("inf"), True)
    table_functions.register_scalar(spark, "twice", lambda s: s * 2, "long")
    assert spark.sql("select twice(21L)").first()[0] == 42

    class Pairs:
        def eval(self, n: int):
            for i in range(n):
                yield i, i * i

    table_functions.register_table(spark, "pairs", Pairs, "a int, b int")
    assert rows(spark.sql("select * from pairs(3)")) == [(0, 0), (1, 1), (2, 4)]


def test_types():
    assert parse_type("INT UNSIGNED").spark == "bigint" and parse_type("char(5 octets)").octets
    assert parse_type("float").spark == "float" and parse_type("timestamp(6) with time zone").spark == "timestamp"
    assert common_type("utinyint", "tinyint") == "smallint" and common_type("ubigint", "int") == "double"
    with pytest.raises(ValueError):
        parse_type("interval")


def test_views_and_tables_are_gone_when_dropped(db, spark):
    from pyspark.errors import PySparkException

    db.ddl("create table `Quoted` (\"id\" int primary key, v int)")
    db.run("insert into quoted values (1, 5)")
    db.ddl("create view seen as select id + v as s from quoted")
    assert [r.s for r in db.run("select s from seen").collect()] == [6]
    # The session itself knows none of these names.
    assert not {"quoted", "seen"} & {t.name for t in spark.catalog.listTables()}
    db.ddl("drop view seen")
    db.ddl("drop table quoted")
    for name in ("seen", "quoted"):
        with pytest.raises(PySparkException):
            db.run(f"select * from {name}").collect()


def test_what_is_checked_is_what_is_added(db, spark):
    db.ddl("create table drawn (id bigint primary key, r double not null)")
    db.insert("drawn", spark.range(500).selectExpr("id", "rand() r"))
    kept = {r.id: r.r for r in db.table("drawn").collect()}
    assert kept == {r.id: r.r for r in db.table("drawn").collect()} and len(set(kept.values())) > 400


def test_trailing_field_with_a_header_and_one_file(spark, tmp_path):
    from tessera.sources.csv import copy_from, copy_to

    (tmp_path / "t.tbl").write_text("a|b|\n4|x|\n6|null|\n")
    got = copy_from(spark, f"{tmp_path}/t.tbl", "a int, b string", delimiter="|", header=True)
    assert sorted(map(tuple, got.collect())) == [(4, "x"), (6, None)]
    out = tmp_path / "one.csv"
    assert copy_to(got.repartition(3), str(out), header=True) == 2
    assert out.is_file() and sorted(out.read_text().split()) == ["4,x", "6,null", "a,b"]
    assert copy_to(got.limit(0), str(out)) == 0 and out.is_file()


def test_several_partners_and_outer_joins(db):
    db.ddl("create table target (id int primary key, v int)")
    db.ddl("create table source (k int primary key, id int, v int)")
    db.run("insert into target values (1, 10), (2, 20), (3, 30)")
    db.run("insert into source values (1, 1, 7), (2, 1, 5), (3, 9, 9)")
    db.run("update target left join source on target.id = source.id set v = source.v where target.id < 3")
    assert sorted(map(tuple, db.table("target").collect())) == [(1, 5), (2, None), (3, 30)]
    db.run("delete from target full outer join source on target.id = source.id where source.id is null")
    assert [r.id for r in db.table("target").collect()] == [1]


def test_two_writers_of_one_version(spark, tmp_path):
    from tessera.store import Conflict, TableStore

    store = TableStore(spark, f"file://{tmp_path}/s")
    store._put(1, {"tables": {}, "views": {}})
    with pytest.raises(Conflict):
        store._put(1, {"tables": {"x": {}}, "views": {}})
    assert store.state(1)["tables"] == {} and store.latest() == 1


def test_shell(db):
    import io

    from tessera.shell import repl

    out = io.StringIO()
    repl(db, io.StringIO("create table s (id int primary key, n varchar);\ninsert into s\nvalues (1, 'x'), (2, null);\nselect * from s order by id;\nselect nothing;\nshow tables;\nquit\nselect 1;\n"), out)
    said = out.getvalue()
    assert "1 | x" in said and "2 | null" in said and "error:" in said and "\ns\n" in said and not said.endswith("1\n1\n")
