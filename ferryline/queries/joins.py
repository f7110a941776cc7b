"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.operators import contain, partitions, profile
from ferryline.operators.ledger import expected_rows as expect
from ferryline.queries.registry import query, table


@query("join_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 50000")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_totalprice > 50000")
    return orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("join_left", "select c_custkey, coalesce(o_orderstatus, '') as o_orderstatus, o_orderkey from customer left join orders on o_custkey = c_custkey and o_totalprice > 100000")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_totalprice > 100000")
    return table(spark, d, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("o_orderstatus", F.lit("")).alias("o_orderstatus"), "o_orderkey")


@query("join_anti", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 100000")
    return table(spark, d, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("join_semi", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(some, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


_MONTHS = "(select strftime(o_orderdate, '%Y-%m') as part, date_trunc('month', min(o_orderdate)) as lo from orders group by 1)"


@query("join_overlap", f"""
with p as (select part, cast(lo as timestamp) as lower, cast(lo + interval 1 month as timestamp) as upper from {_MONTHS}),
r as (select event_type, min(ts) - interval 9490 day as a, max(ts) - interval 9400 day as b from events group by 1)
select event_type, part from r join p on (a < upper and lower < b)""")
def join_overlap(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("part")).agg(F.date_trunc("month", F.min("o_orderdate")).cast("timestamp_ntz").alias("lower"))
    parts = parts.withColumn("upper", F.add_months("lower", 1).cast("timestamp_ntz"))
    asked = table(spark, d, "events").groupBy("event_type").agg((F.min("ts") - F.expr("interval 9490 days")).alias("a"), (F.max("ts") - F.expr("interval 9400 days")).alias("b"))
    return partitions.join_overlaps(asked, parts, ("a", "b"), ("lower", "upper")).select("event_type", "part")


@query("join_contains", "select doc_id, item_id from documents join benchmark on contains(documents.text, benchmark.text)")
def join_contains(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    return contain.containing(docs, "doc_id", "text", items, "item_id", "passage")


@query("join_self_fk", """
with c(name, tab, col, ref) as (values ('pk_region', 'region', 'r_regionkey', null), ('fk_nation', 'nation', 'n_regionkey', 'pk_region'), ('pk_nation', 'nation', 'n_nationkey', null),
  ('fk_customer', 'customer', 'c_nationkey', 'pk_nation'), ('fk_orders', 'orders', 'o_custkey', 'pk_customer'))
select a.name, a.tab as child, a.col as child_column, b.tab as parent, b.col as parent_column, n.n as child_rows
from c a left join c b on a.ref = b.name
join (select 'region' as t, count(*) as n from region union all select 'nation', count(*) from nation union all select 'customer', count(*) from customer union all select 'orders', count(*) from orders) n on n.t = a.tab
where a.ref is not null""")
def join_self_fk(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(
        [("pk_region", "region", "r_regionkey", None), ("fk_nation", "nation", "n_regionkey", "pk_region"), ("pk_nation", "nation", "n_nationkey", None), ("fk_customer", "customer", "c_nationkey", "pk_nation"), ("fk_orders", "orders", "o_custkey", "pk_customer")],
        "name string, tab string, col string, ref string",
    )
    counts = profile.profile_tables({n: table(spark, d, n) for n in ("region", "nation", "customer", "orders")}).select(F.col("table_name").alias("t"), F.col("n_rows").alias("child_rows"))
    parents = rules.select(F.col("name").alias("p"), F.col("tab").alias("parent"), F.col("col").alias("parent_column"))
    joined = rules.where("ref is not null").join(parents, F.col("ref") == F.col("p"), "left").join(counts, F.col("tab") == F.col("t"))
    return joined.select("name", F.col("tab").alias("child"), F.col("col").alias("child_column"), "parent", "parent_column", "child_rows")


@query("join_stats", """
select n_nationkey, coalesce(c.n, 0) as n_customers, coalesce(s.n, 0) as n_suppliers from nation
left join (select c_nationkey, count(*) as n from customer group by 1) c on n_nationkey = c_nationkey
left join (select s_nationkey, count(*) as n from supplier group by 1) s on n_nationkey = s_nationkey""")
def join_stats(spark: SparkSession, d: str) -> DataFrame:
    count = lambda t, k, n: table(spark, d, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.count(F.lit(1)).alias(n))
    return profile.join_stats(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", count("customer", "c_nationkey", "n_customers"), count("supplier", "s_nationkey", "n_suppliers"))


@query("expected_rows", """
with u as (select o_orderpriority as table_name, o_orderstatus as part, 1 + count(*) % 5 as n_chunks from orders group by 1, 2),
p as (select o_orderpriority as table_name, o_orderstatus as part, count(*) as n from orders where o_orderstatus <> 'P' group by 1, 2),
t as (select o_orderpriority as table_name, count(*) as n from orders group by 1)
select u.table_name, u.part, u.n_chunks, cast(coalesce(p.n, t.n, 0) // greatest(u.n_chunks, 1) as bigint) as rows_expected
from u left join p using (table_name, part) left join t on t.table_name = u.table_name""")
def expected_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("table_name"), F.col("o_orderstatus").alias("part"))
    units = orders.groupBy("table_name", "part").agg((1 + F.count(F.lit(1)) % 5).alias("n_chunks"))
    parts = orders.where("part <> 'P'").groupBy("table_name", "part").agg(F.count(F.lit(1)).alias("part_rows"))
    return expect(units, parts, orders.groupBy("table_name").agg(F.count(F.lit(1)).alias("table_rows")))


@query("set_minus", "select c_nationkey as nationkey from customer except select s_nationkey from supplier where s_acctbal > 5000")
def set_minus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).subtract(table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("set_union_counts", """
select nationkey, sum(n)::bigint as n from (select c_nationkey as nationkey, count(*) as n from customer group by 1 union all select s_nationkey, count(*) from supplier group by 1) group by 1""")
def set_union_counts(spark: SparkSession, d: str) -> DataFrame:
    count = lambda t, k: table(spark, d, t).groupBy(F.col(k).alias("nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return count("customer", "c_nationkey").unionByName(count("supplier", "s_nationkey")).groupBy("nationkey").agg(F.sum("n").alias("n"))


@query("set_intersect", "select c_nationkey as nationkey from customer where c_acctbal < 0 intersect select s_nationkey from supplier")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("set_union", "select c_nationkey as nationkey from customer union select s_nationkey from supplier")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()
