"""Registered queries over the database layer, the dialect and user functions."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.api import ConstraintError, Database
from tessera.models import Model, column
from tessera.operators.builder import change, table
from tessera.plans.catalog_queries import code, sql
from tessera.tables import load


def copies(spark: SparkSession, sf_dir: str, *names: str, compat: bool = False) -> Database:
    """A scratch database with whole copies of tables, their first column the key."""
    db = Database.scratch(spark)
    db.compat = compat
    kinds = {"string": "varchar", "timestamp_ntz": "datetime"}
    for name in names:
        rows = load(spark, sf_dir, name)
        columns = ", ".join(f"{c} {kinds.get(k, k)}{' primary key' if i == 0 else ''}" for i, (c, k) in enumerate(rows.dtypes))
        db.ddl(f"create table {name} ({columns})")
        db.insert(name, rows)
    return db


# The dialect.
sql("any_in_select", "select n_nationkey, n_nationkey > any (select nullif(r_regionkey, 2) from region) as beaten, n_nationkey = any (select nullif(r_regionkey, 2) from region) as met from nation")
sql("all_in_select", "select n_nationkey, n_nationkey >= all (select r_regionkey from region) as top, n_nationkey <> all (select nullif(r_regionkey, 2) from region) as apart, case when n_nationkey < all (select r_regionkey + 3 from region) then 'low' else 'high' end as sized from nation")
sql("any_correlated", "select s_suppkey from supplier where s_acctbal > any (select c_acctbal from customer where c_nationkey = s_nationkey)")
sql("all_equal", "select n_nationkey from nation where n_regionkey = all (select r_regionkey from region where r_name = 'ASIA')")
sql("limit_comma", "select o_orderkey from orders order by o_orderkey limit 5, 10", "select o_orderkey from orders order by o_orderkey limit 10 offset 5")
sql("block_comment", "select /* order by n_name */ n_nationkey, n_name from nation /* where x > any (select 1) */ order by n_nationkey limit 4")
sql("alias_in_where", "select p_partkey, p_size * 2 as doubled from part where doubled > 80 and p_size < 48", "select p_partkey, p_size * 2 as doubled from part where p_size * 2 > 80 and p_size < 48")
sql("table_function_sql", "select number, r_name from table(numbers(4)) join region on number = r_regionkey", "select cast(range as integer) as number, r_name from range(4) join region on range = r_regionkey")
sql("divide_by_zero", "select p_partkey, p_size / (p_size - 10) as ratio, (p_size - 10) / 2 * 3 as scaled from part", "select p_partkey, case when p_size = 10 then cast('inf' as double) else p_size::double / (p_size - 10) end as ratio, (p_size - 10)::double / 2 * 3 as scaled from part", compat=True)
sql("lengths_of_null", "select p_partkey, char_length(nullif(p_brand, 'Brand#11')) as n, octet_length(nullif(p_brand, 'Brand#12')) as o, position('#' in nullif(p_brand, 'Brand#13')) as at from part", "select p_partkey, cast(coalesce(length(nullif(p_brand, 'Brand#11')), 0) as int) as n, cast(coalesce(octet_length(encode(nullif(p_brand, 'Brand#12'))), 0) as int) as o, cast(coalesce(position('#' in nullif(p_brand, 'Brand#13')), 0) as int) as at from part", compat=True)
sql("substring_bytes", "select p_partkey, substring(p_brand from -3) as wrapped, substring(p_brand, 2, 3) as middle, substring(nullif(p_brand, 'Brand#11') for 5) as head, substring(concat('é', p_brand) from 3) as behind_two_bytes, substring(p_brand from p_size) as perhaps_beyond from part", "select p_partkey, substr(p_brand, length(p_brand) - 2) as wrapped, substr(p_brand, 2, 3) as middle, substr(nullif(p_brand, 'Brand#11'), 1, 5) as head, p_brand as behind_two_bytes, case when p_size <= length(p_brand) + 1 then substr(p_brand, p_size) end as perhaps_beyond from part", compat=True)
sql("trim_whole_string", "select p_partkey, trim(both 'ab' from concat('ababb', p_brand, 'bab')) as both_ends, trim(leading 'Bra' from p_brand) as head, trim(trailing '1' from p_brand) as tail, trim(concat(' ', p_brand, '  ')) as plain from part", "select p_partkey, 'b' || p_brand || 'b' as both_ends, substr(p_brand, 4) as head, regexp_replace(p_brand, '1+$', '') as tail, p_brand as plain from part", compat=True)
sql("like_rows", "select c_custkey, c_name like '%7' as ends, c_name like 'Customer#_0%' as shaped, c_name not like '%!_%' escape '!' as plain, c_name like '%\\\\%' as slashed from customer", "select c_custkey, c_name like '%7' as ends, c_name like 'Customer#_0%' as shaped, c_name not like '%!_%' escape '!' as plain, contains(c_name, '\\\\') as slashed from customer")
sql("scalar_in_where_rows", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.2 from orders)")
sql("set_except_rows", "select n_nationkey as k from nation except select r_regionkey from region")
sql("not_exists_rows", "select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)")
sql("decimal_arithmetic", "select l_orderkey, l_linenumber, cast(l_quantity as decimal(12,2)) + cast(l_tax as decimal(5,2)) as added, cast(l_quantity as decimal(12,2)) * cast(l_discount as decimal(5,2)) as product, -cast(l_tax as decimal(5,2)) as negated, cast(l_quantity as decimal(12,2)) > cast(20.5 as decimal(5,2)) as more from lineitem")
sql("decimal_aggregates", "select l_returnflag, cast(sum(cast(l_quantity as decimal(12,2))) as decimal(28,2)) as total, min(cast(l_tax as decimal(5,2))) as least, count(distinct cast(l_discount as decimal(5,2))) as kinds from lineitem group by l_returnflag")
sql("time_values", "select event_id, cast(date_format(ts, 'HH:mm:ss') as time) > time '12:00:00' as late, cast(cast(date_format(ts, 'HH:mm:ss') as time) as string) as clock from events", "select event_id, cast(strftime(ts, '%H:%M:%S') as time) > time '12:00:00' as late, strftime(ts, '%H:%M:%S') as clock from events")
sql("current_clock", "select r_regionkey, current_date() = cast(current_timestamp() as date) as today, current_timestamp() > timestamp '2024-01-01 00:00:00' as after from region", "select r_regionkey, true as today, true as after from region")


@code("select c_custkey, c_acctbal from customer where c_acctbal > 100.5 and c_nationkey = 3")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(spark, sf_dir, "customer").run("select c_custkey, c_acctbal from customer where c_acctbal > $1 and c_nationkey = $nation", 100.5, nation=3)


@code("select 'raised' as outcome")
def scalar_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar subquery of more than one row is an error."""
    try:
        copies(spark, sf_dir, "nation", "region").run("select n_nationkey, (select r_regionkey from region) as r from nation").collect()
        outcome = "passed"
    except Exception:  # raised while it runs, so by the JVM
        outcome = "raised"
    return spark.createDataFrame([(outcome,)], "outcome string")


# Views, schema changes and what tells of them.
@code("select region as k, nations as n from (select n_regionkey as region, count(*) as nations from nation group by n_regionkey) where nations > 2")
def view_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = copies(spark, sf_dir, "nation")
    db.ddl("create view counts (k, n) as select n_regionkey, count(*) from nation group by n_regionkey")
    db.ddl("create view large as select k, n from counts where n > 100")
    db.ddl("create or replace view large as select k, n from counts where n > 2")
    return db.run("select * from large")


@code("select * from (values ('VIEW', 'kept'), ('TABLE', 'nation')) as t(kind, name)")
def show_tables_and_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = copies(spark, sf_dir, "nation", "region")
    db.ddl("create view kept as select * from nation")
    db.ddl("create view gone as select * from region")
    db.ddl("drop view gone")
    db.ddl("drop table region")
    for name in ("gone", "region"):
        try:
            db.run(f"select * from {name}")
            raise AssertionError(f"{name} still answers")
        except PySparkException:
            pass
    return db.run("show views").select(F.lit("VIEW").alias("kind"), F.col("VIEW").alias("name")).union(db.run("show tables").select(F.lit("TABLE"), "TABLE"))


@code("select * from (values ('id', 'INT', 'false', 'PRIMARY'), ('name', 'VARCHAR(20)', 'true', 'UNIQUE'), ('paid', 'DECIMAL(8,2)', 'false', 'EMPTY')) as t(field, type, nullable, key)")
def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database.scratch(spark)
    db.ddl("create table t (id int primary key, name varchar(20) unique, paid decimal(8,2) not null default 1.5)")
    return db.run("describe t").select(F.col("FIELD").alias("field"), F.regexp_replace("TYPE", " ", "").alias("type"), F.col("NULL").alias("nullable"), F.col("Key").alias("key"))


@code("select true as planned")
def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = copies(spark, sf_dir, "nation").run("explain select n_name from nation where n_nationkey = 3")
    return plan.select((F.contains("PLAN", F.lit("Scan parquet")) & F.contains("PLAN", F.lit("PushedFilters"))).alias("planned"))


@code("select s_suppkey as supplier, cast(round(s_acctbal) as bigint) as balance, 'new' as state, s_nationkey from supplier")
def alter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADD, DROP, RENAME, type, default and null changes over a whole table."""
    db = copies(spark, sf_dir, "supplier")
    for text in (
        "alter table supplier add column state varchar(10) default 'new'", "alter table supplier drop column s_name", "alter table supplier rename column s_suppkey to supplier",
        "alter table supplier change column s_acctbal balance double", "alter table supplier alter column s_nationkey set not null", "alter table supplier alter column s_nationkey set default 7", "alter table supplier alter column s_nationkey drop not null",
    ):
        db.ddl(text)
    return db.table("supplier").select("supplier", F.round("balance").cast("long").alias("balance"), "state", "s_nationkey")


@code("select n_regionkey, n_name from nation where n_nationkey between 5 and 9")
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unique index refuses duplicates; a plain one is known and dropped again."""
    db = copies(spark, sf_dir, "nation")
    db.ddl("create unique index by_name on nation (n_name)")
    db.ddl("create index by_region on nation (n_regionkey, n_name)")
    db.ddl("drop index nation.by_region")
    try:
        db.run("insert into nation select n_nationkey + 100 as n_nationkey, n_name, n_regionkey from nation where n_nationkey = 3")
        raise AssertionError("a duplicate got in")
    except ConstraintError:
        pass
    return db.run("select n_regionkey, n_name from nation where n_nationkey between 5 and 9")


@code("select cast(0 as bigint) as n, 25 as copied from region where r_regionkey = 0")
def truncate_and_select_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = copies(spark, sf_dir, "nation")
    db.ddl("create table copied (n_nationkey int primary key, n_name varchar)")
    db.run("select n_nationkey, n_name into copied from nation")
    db.run("truncate table nation")
    return db.run("select (select count(*) from nation) as n, cast((select count(*) from copied) as int) as copied")


# Joined changes and transactions.
@code("select s_suppkey, case when n_regionkey = 2 then n_name else s_name end as s_name from supplier join nation on s_nationkey = n_nationkey")
def update_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = copies(spark, sf_dir, "supplier", "nation")
    db.run("update supplier join nation on s_nationkey = n_nationkey set s_name = n_name where n_regionkey = 2")
    return db.run("select s_suppkey, s_name from supplier")


@code("select n_nationkey, case when n_nationkey < 5 then r_name else 'none' end as n_name from nation left join region on n_nationkey = r_regionkey")
def update_left_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a partner are changed too."""
    db = copies(spark, sf_dir, "nation", "region")
    db.run("update nation left join region on n_nationkey = r_regionkey set n_name = coalesce(r_name, 'none')")
    return db.run("select n_nationkey, n_name from nation")


@code("select n_nationkey from nation where n_nationkey not in (select r_regionkey from region)")
def delete_right_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the other side alone touch nothing."""
    db = copies(spark, sf_dir, "nation", "region")
    db.run("delete from nation right outer join region on n_nationkey = r_regionkey")
    return db.run("select n_nationkey from nation")


@code("select n_nationkey from nation where n_nationkey in (select r_regionkey from region)")
def delete_left_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = copies(spark, sf_dir, "nation", "region")
    db.run("delete from nation left join region on n_nationkey = r_regionkey where r_regionkey is null")
    return db.run("select n_nationkey from nation")


@code("select n_nationkey from nation where n_regionkey <> 1")
def transaction_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rolled back change leaves nothing; a reader keeps the version that it began with; a committed one stays."""
    db = copies(spark, sf_dir, "nation")
    dropped = db.begin()
    dropped.run("delete from nation")
    dropped.rollback()
    reader, writer = db.begin(), db.begin()
    writer.run("delete from nation where n_regionkey = 1")
    writer.commit()
    if reader.table("nation").count() != load(spark, sf_dir, "nation").count():
        raise AssertionError("a reader saw another's change")
    return db.run("select n_nationkey from nation")


@code("select s_suppkey, s_acctbal from supplier")
def checkpoint_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.store import scratch_folder

    db = copies(spark, sf_dir, "supplier")
    folder = scratch_folder(spark)
    db.checkpoint(folder)
    db.run("delete from supplier")
    return Database(spark, folder).run("select s_suppkey, s_acctbal from supplier")


# Statistics.
@code("""select 'o_custkey' as "column", count(*) as rows, cast(0 as bigint) as nulls, cast(min(o_custkey) as varchar) as least, cast(max(o_custkey) as varchar) as most from orders union all select 'o_orderpriority', count(*), 0, min(o_orderpriority), max(o_orderpriority) from orders""")
def analyze_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = copies(spark, sf_dir, "orders")
    db.run("analyze table orders")
    return db.statistics("orders").where(F.col("column").isin("o_custkey", "o_orderpriority")).select("column", "rows", "nulls", "least", "most")


@code("select c_mktsegment as value, count(*) as n, true as bounded from customer group by c_mktsegment")
def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent values, each estimated by the sketch too: never less, and at most 0.1 % of the rows more."""
    db = copies(spark, sf_dir, "customer")
    found = db.run("analyze table customer").where("column = 'c_mktsegment'").select("rows", F.explode("frequent").alias("f")).select("rows", "f.*").collect()
    rows = [(r.value, r.n, r.n <= db.estimate("customer", "c_mktsegment", r.value) <= r.n + 0.001 * r.rows) for r in found]
    return spark.createDataFrame(rows, "value string, n long, bounded boolean")


@code("select 31 as cuts, true as even from region where r_regionkey = 0")
def histogram_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the 32 buckets of the histogram holds a 32nd of the rows, within 1 %."""
    db = copies(spark, sf_dir, "orders")
    db.run("analyze table orders")
    cuts = db.statistics("orders").where("column = 'o_totalprice'").first().histogram
    rows = db.table("orders")
    n = rows.count()
    below = rows.agg(*(F.count_if(F.col("o_totalprice") <= c).alias(f"c{i}") for i, c in enumerate(cuts))).first()
    even = all(abs(x - n * (i + 1) / 32) <= 0.01 * n + 1 for i, x in enumerate(below))
    return spark.createDataFrame([(len(cuts), even)], "cuts int, even boolean")


# User functions, builder and models.
@code("select n_nationkey, upper(n_name) || '!' as shout from nation")
def scalar_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = copies(spark, sf_dir, "nation")

    def shout(x: pd.Series) -> pd.Series:
        return x.str.upper() + "!"

    db.load("shout", shout, "string")
    return db.run("select n_nationkey, shout(n_name) as shout from nation")


@code("select cast(range as integer) as v, cast(range * range as integer) as squared from range(2, 7)")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Squares:
        def eval(self, low: int, high: int):
            for v in range(low, high):
                yield v, v * v

    db = Database.scratch(spark)
    db.load("squares", Squares, "v int, squared int")
    return db.run("select v, squared from table(squares(2, 7))")


@code("select o_orderkey, o_totalprice from orders where o_totalprice >= (select max(o_totalprice) * 0.9 from orders)")
def builder_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    most = table(orders).aggregate(most=F.max("o_totalprice") * 0.9).scalar()
    return table(orders).filter(F.col("o_totalprice") >= most).project("o_orderkey", "o_totalprice").build()


@code("select n_nationkey, case when n_regionkey = 1 then 'one' else n_name end as n_name from nation where n_nationkey not in (select r_regionkey from region)")
def builder_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """insert_select, update, joined delete by the builder."""
    db = copies(spark, sf_dir, "region")
    db.ddl("create table chosen (n_nationkey int primary key, n_name varchar, n_regionkey int)")
    table(load(spark, sf_dir, "nation")).project("n_nationkey", "n_name", "n_regionkey").insert_into(db, "chosen")
    change(db, "chosen").filter(F.col("n_regionkey") == 1).update(n_name=F.lit("one"))
    change(db, "chosen").join(db.table("region"), F.col("n_nationkey") == F.col("r_regionkey")).delete()
    return table(db.table("chosen")).project("n_nationkey", "n_name").build()


@code("select c_custkey, c_name, case when c_nationkey = 4 then null else c_acctbal end as c_acctbal from customer where c_nationkey < 10")
def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    @dataclass
    class Client:
        c_custkey: int = column(primary=True)
        c_name: str = column(type="varchar(40)", index=True)
        c_nationkey: int = column()
        c_acctbal: float | None = column(default="0")

    db = Database.scratch(spark)
    clients = Model(db, Client)
    clients.migrate()
    table(load(spark, sf_dir, "customer")).project("c_custkey", "c_name", "c_nationkey", "c_acctbal").insert_into(db, clients.name)
    clients.delete(F.col("c_nationkey") >= 10)
    clients.update(F.col("c_nationkey") == 4, c_acctbal=None)
    clients.insert(Client(-1, "extra", 1, None))
    if clients.get(-1) != Client(-1, "extra", 1, None):
        raise AssertionError("the object that was put in doesn't come back")
    clients.delete(F.col("c_custkey") == -1)
    return clients.query().project("c_custkey", "c_name", "c_acctbal").build()
