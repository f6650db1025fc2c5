"""Registered queries over the reference operators, each with its oracle SQL.

Most are SQL text that Spark and the oracle read alike; where the dialects
differ, or the operator is a layer of this package, the Spark side is code.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import dialect
from tessera.functions import scalars
from tessera.operators.builder import table
from tessera.tables import TABLES, load, register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by customer nation: the five nations with the most."""
    t = lambda name: load(spark, sf_dir, name)
    lines = t("lineitem").where(F.col("l_quantity") < 30)
    orders = t("orders").where(F.col("o_orderstatus") != "P")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.groupBy("n_name").agg(F.count("*").alias("n_lines"), revenue.alias("revenue")).where("n_lines > 5").orderBy(F.col("revenue").desc_nulls_last(), "n_name").limit(5)


def sql(name: str, text: str, oracle: str | None = None, compat: bool = False) -> None:
    """Register SQL `text`, in this package's dialect; the oracle reads it too unless it has its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", text)])
        return dialect.run(spark, text, compat=compat)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or text


def code(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


QUERIES["flagship"] = flagship
ORACLES["flagship"] = """select n_name, count(*) as n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where l_quantity < 30 and o_orderstatus <> 'P' group by n_name having count(*) > 5 order by revenue desc nulls last, n_name limit 5"""

# Scans, projections and predicates.
sql("scan_full", "select * from nation")
sql("scan_point", "select o_orderkey, o_totalprice from orders where o_orderkey = 1000")
sql("scan_range", "select o_orderkey, o_custkey from orders where o_orderkey > 500 and o_orderkey < 1000")
sql("scan_ranges", "select o_orderkey from orders where o_orderkey in (1, 5, 9) or o_orderkey between 100 and 120 or o_orderkey > 14990")
sql("dummy_row", "select 1 as one, 'x' as label")
sql("values_inline", "select a, b from (values (1, 'x'), (2, null), (3, 'z')) as t(a, b)")
sql("derived_table", "select k, n from (select o_custkey, count(*) from orders group by o_custkey) as t(k, n) where n > 12")
sql("project_expressions", "select l_orderkey, l_linenumber, l_quantity * 2 as doubled, -l_quantity as negated, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem where l_quantity < 3")
sql("wildcard_qualified", "select n.*, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey")
sql("filter_kleene", "select p_partkey from part where (nullif(p_size, 10) > 20 or p_retailprice < 1000) and not (nullif(p_size, 15) = 3)")
sql("filter_is_null", "select p_partkey from part where nullif(p_size, 10) is null or nullif(p_brand, 'Brand#11') is not null and p_size > 45")
sql("filter_in_list", "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey not in (1, 2, 3)")
sql("filter_between", "select p_partkey, p_size from part where p_size between 10 and 12 or p_retailprice not between 900 and 1900")
sql("filter_like", "select p_partkey, p_name from part where p_name like '%1%' and p_type not like 'S_%' and p_name not like 'x!%%' escape '!'")
sql("case_forms", "select p_partkey, case when p_size > 40 then 'large' when p_size > 20 then 'medium' else 'small' end as sized, case p_size when 1 then 'one' when 2 then 'two' end as named from part")
sql("cast_forms_whole", "select l_orderkey, l_linenumber, cast(l_quantity as int) as q, cast(l_linenumber as varchar(10)) as s, cast('2024-11-10' as date) as d, cast(l_orderkey as double) as f from lineitem", "select l_orderkey, l_linenumber, cast(trunc(l_quantity) as int) as q, cast(l_linenumber as varchar) as s, date '2024-11-10' as d, cast(l_orderkey as double) as f from lineitem")
sql("row_values", "select n_nationkey from nation where (n_nationkey, n_regionkey) in ((0, 0), (1, 1), (5, 9))")
sql("conditional_functions", "select p_partkey, coalesce(nullif(p_size, 10), -1) as c, ifnull(nullif(p_size, 11), 0) as i, if(p_size > 25, 'hi', 'lo') as b from part")
sql("string_functions", "select c_custkey, lower(c_name) as lo, upper(c_mktsegment) as up, char_length(c_name) as n, octet_length(encode(c_name, 'utf-8')) as o, substring(c_name, 2, 5) as sub, position('0' in c_name) as pos, trim(both 'C' from c_name) as tr, c_name || '-' || c_mktsegment as cat from customer", "select c_custkey, lower(c_name) as lo, upper(c_mktsegment) as up, cast(length(c_name) as int) as n, cast(octet_length(encode(c_name)) as int) as o, substring(c_name, 2, 5) as sub, cast(position('0' in c_name) as int) as pos, trim(c_name, 'C') as tr, c_name || '-' || c_mktsegment as cat from customer")
sql("typed_literals", "select o_orderkey from orders where o_orderdate >= timestamp '1995-03-15 00:00:00' and o_orderdate < timestamp '1995-04-01 00:00:00'")

# Joins.
sql("join_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 300000")
sql("join_left", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 400000")
sql("join_right", "select o_orderkey, c_custkey from orders right join customer on o_custkey = c_custkey and o_orderpriority = '1-URGENT'")
sql("join_full", "select n_nationkey, s_suppkey from (select * from nation where n_nationkey < 20) n full join (select * from supplier where s_nationkey > 5) s on n_nationkey = s_nationkey")
sql("join_residual", "select count(*) as n from lineitem join orders on l_orderkey = o_orderkey and l_extendedprice * 3 > o_totalprice")
sql("join_multi_key", "select count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey = b.l_suppkey where a.l_linenumber < b.l_linenumber")
sql("join_using", "select k, a, b from (select n_nationkey as k, n_name as a from nation) x join (select s_nationkey as k, s_suppkey as b from supplier) y using (k)")
sql("join_full_using", "select k, a, b from (select n_nationkey as k, n_name as a from nation where n_nationkey < 10) x full join (select c_nationkey as k, c_custkey as b from customer where c_nationkey > 5) y using (k)")
sql("join_natural", "select k, a, b from (select n_nationkey as k, n_name as a from nation) x natural join (select s_nationkey as k, s_name as b from supplier) y")
sql("join_theta", "select a.n_nationkey as lo, b.n_nationkey as hi from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey + 1 - 1")
sql("join_theta_left", "select r_regionkey, n_nationkey from region left join nation on r_regionkey > n_nationkey")
sql("join_cross", "select r_name, n_name from region cross join nation")
sql("join_comma", "select r_name, n_name from region, nation where r_regionkey = n_regionkey")
sql("join_null_keys", "select a.k, b.v from (select nullif(n_nationkey, 3) as k from nation) a left join (select nullif(s_nationkey, 4) as k, s_suppkey as v from supplier) b on a.k = b.k")
sql("join_three_way", "select r_name, count(*) as n from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name")

# Aggregation.
sql("agg_scalar", "select count(*) as n, count(nullif(l_linenumber, 1)) as nn, cast(sum(l_linenumber) as bigint) as s, round(avg(l_quantity), 6) as a, min(l_shipdate) as lo, max(l_returnflag) as hi from lineitem")
sql("agg_empty", "select count(*) as n, cast(sum(l_linenumber) as bigint) as s, min(l_quantity) as m from lineitem where l_quantity < 0")
sql("agg_group", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice), 2) as s, round(avg(l_discount), 6) as a from lineitem group by l_returnflag, l_linestatus")
sql("agg_null_group", "select nullif(p_size, 10) as k, count(*) as n from part group by nullif(p_size, 10)")
sql("agg_distinct", "select l_returnflag, count(distinct l_suppkey) as n, cast(sum(distinct l_linenumber) as bigint) as s from lineitem group by l_returnflag")
sql("agg_expression_key", "select l_linenumber % 3 as k, count(*) as n from lineitem group by l_linenumber % 3")
sql("agg_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 14 and min(o_totalprice) > 1000")
sql("distinct_rows", "select distinct l_returnflag, l_linenumber from lineitem")
sql("order_by_aggregate", "select o_orderpriority, count(*) as n from orders group by o_orderpriority order by count(*) desc, o_orderpriority limit 3")

# Sort, limit, top-k.
sql("sort_nulls_default", "select k from (select nullif(n_regionkey, 2) as k, n_nationkey from nation) t order by k desc, n_nationkey limit 22", "select k from (select nullif(n_regionkey, 2) as k, n_nationkey from nation) t order by k desc nulls last, n_nationkey limit 22")
sql("sort_nulls_first", "select n_nationkey, k from (select nullif(n_regionkey, 2) as k, n_nationkey from nation) t order by k nulls first, n_nationkey limit 7")
sql("limit_offset", "select o_orderkey from orders order by o_orderkey limit 10 offset 25")
sql("offset_only", "select n_nationkey from nation order by n_nationkey offset 20")
sql("limit_zero", "select n_nationkey from nation limit 0")
sql("top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")

# Set operations.
for op in ("union", "except", "intersect"):
    for kind in ("", " all"):
        sql(f"set_{op}{kind.replace(' ', '_')}_whole", f"select nullif(c_nationkey, 3) as k from customer {op}{kind} select nullif(s_nationkey, 3) as k from supplier")
sql("set_ordered", "select n_nationkey as k from nation union all select r_regionkey as k from region order by k desc limit 9")

# Subqueries.
sql("scalar_in_select", "select n_nationkey, (select max(r_regionkey) from region) as top from nation")
sql("scalar_in_where", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 2 from orders)")
sql("scalar_empty", "select n_nationkey, (select r_regionkey from region where r_regionkey < 0) as none from nation")
sql("exists_correlated", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
sql("not_exists", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
sql("in_subquery", "select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
sql("not_in_nulls", "select s_suppkey from supplier where s_nationkey not in (select nullif(n_nationkey, 3) from nation where n_regionkey = 1)")
sql("in_tuple", "select l_orderkey, l_linenumber from lineitem where (l_partkey, l_suppkey) in (select p_partkey, s_suppkey from part join supplier on p_partkey % 100 = s_suppkey % 100 where p_size = 1)")
sql("marks_combined", "select n_nationkey from nation where n_nationkey in (select s_nationkey from supplier where s_acctbal > 5000) or not exists (select 1 from customer where c_nationkey = n_nationkey and c_acctbal < 0)")
sql("any_greater", "select n_nationkey from nation where n_nationkey > any (select r_regionkey * 5 from region)")
sql("any_equal", "select s_suppkey from supplier where s_nationkey = some (select n_nationkey from nation where n_regionkey = 2)")
sql("all_greater", "select o_orderkey from orders where o_totalprice > all (select l_extendedprice * 3 from lineitem where l_quantity > 45)")
sql("all_with_nulls", "select n_nationkey from nation where n_nationkey >= all (select nullif(r_regionkey, 2) from region)")
sql("all_empty", "select n_nationkey from nation where n_nationkey > all (select r_regionkey from region where r_regionkey < 0)")
sql("not_any", "select n_nationkey from nation where not (n_nationkey <= any (select r_regionkey from region))", "select n_nationkey from nation where not (n_nationkey <= any (select r_regionkey from region))")


# Layers of this package.
@code("select cast(range as integer) as number from range(100) where range % 7 = 3")
def function_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.table_functions import numbers

    return numbers(spark, 100).where("number % 7 = 3")


@code("select p_partkey, case when p_size - 10 = 0 then case when p_retailprice > 0 then cast('inf' as double) end else p_retailprice / (p_size - 10) end as ratio from part")
def safe_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", scalars.safe_div(F.col("p_retailprice"), F.col("p_size") - 10).alias("ratio"))


@code("select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from customer join orders on c_custkey = o_custkey where o_totalprice >= 1000 group by c_mktsegment having count(*) > 10 order by n desc nulls last, c_mktsegment limit 4")
def builder_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return (
        table(load(spark, sf_dir, "customer")).inner_join(orders, F.col("c_custkey") == F.col("o_custkey")).filter(F.col("o_totalprice") >= 1000)
        .group_by("c_mktsegment").aggregate(n=F.count("*"), total=F.round(F.sum("o_totalprice"), 2)).having(F.col("n") > 10).order_by("-n", "c_mktsegment").limit(4).build()
    )


@code("select n_nationkey, case when n_nationkey = 7 then 'renamed' else n_name end as n_name, n_regionkey from nation where n_regionkey <> 3 union all select 99, 'added', 1")
def dml_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT, UPDATE and DELETE on versioned snapshots."""
    from tessera.api import Database

    db = Database.scratch(spark)
    db.ddl("create table nation_copy (n_nationkey int primary key, n_name varchar(40) not null, n_regionkey int)")
    db.insert("nation_copy", load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    db.run("insert into nation_copy values (99, 'added', 1)")
    db.run("update nation_copy set n_name = 'renamed' where n_nationkey = 7")
    db.run("delete from nation_copy where n_regionkey = 3")
    return db.table("nation_copy")


@code("select n_nationkey, n_name from nation where n_nationkey >= 5 union all select r_regionkey, r_name from region")
def dml_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.api import Database

    db = Database.scratch(spark)
    db.ddl("create table t (n_nationkey int primary key, n_name varchar)")
    db.insert("t", load(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    db.upsert("t", load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")))
    return db.table("t")


@code("select s_suppkey, s_name, s_acctbal from supplier")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.csv import copy_from, copy_to
    from tessera.store import scratch_folder

    path = f"{scratch_folder(spark)}/suppliers"
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    copy_to(rows, path, delimiter="|", header=True)
    return copy_from(spark, path, rows.schema, delimiter="|", header=True)
