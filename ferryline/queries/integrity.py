"""Reconciliation and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.operators import integrity as rules
from ferryline.operators import partitions
from ferryline.operators import reconcile as rec
from ferryline.operators.shape import cast_columns, empty_to_null
from ferryline.queries.registry import TARGET, query, table
from ferryline.spec import ForeignKey, TableSpec


def _counts(where: str = "true", part: str = "strftime(o_orderdate, '%Y-%m')") -> str:
    return f"select {part} as part, count(*) filter ({where}) as source_rows, count(*) filter ({where} and {TARGET}) as target_rows from orders group by 1"


_ERROR = "case when source_rows <> target_rows then 'row count differs: source ' || source_rows || ', target ' || target_rows end as error"


@query("reconcile_counts", f"select source_rows, target_rows, source_rows - target_rows as diff, source_rows = target_rows as match, {_ERROR} from (select count(*) as source_rows, count(*) filter ({TARGET}) as target_rows from orders where o_totalprice > 1000)")
def reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return rec.reconcile(orders, orders.where("o_totalprice > 1000").where(TARGET), [], "o_totalprice > 1000")


@query("reconcile_partitions", f"select part, source_rows, target_rows, source_rows - target_rows as diff, source_rows = target_rows as match, {_ERROR} from ({_counts()})")
def reconcile_partitions(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    shaped = cast_columns(empty_to_null(orders), {"o_totalprice": "decimal(15,2)"})
    routed = partitions.route_range(shaped, partitions.month_bounds(orders, "o_orderdate"), "o_orderdate", default="default")
    return rec.reconcile(routed, routed.where(TARGET), ["part"])


@query("reconcile_tolerance", f"""
select part, source_rows, target_rows, source_rows - target_rows as diff, source_rows > 150 and part <> '1996-01' as estimated_source, source_rows > 150 as estimated_target,
  cast(case when source_rows > 150 then greatest(source_rows, target_rows) // 100 else 0 end as bigint) as tolerance,
  abs(source_rows - target_rows) <= case when source_rows > 150 then greatest(source_rows, target_rows) // 100 else 0 end as match from ({_counts()})""")
def reconcile_tolerance(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("part", F.date_format("o_orderdate", "yyyy-MM"))
    counts = rec.reconcile(orders, orders.where(TARGET), ["part"]).drop("match", "error")
    return rec.with_tolerance(counts, F.col("source_rows"), F.col("part") == "1996-01", 150)


@query("reconcile_summary", f"select count(*) as n, count(*) filter (source_rows = target_rows) as n_matched, sum(source_rows)::bigint as source_rows, sum(target_rows)::bigint as target_rows, bool_and(source_rows = target_rows) as all_match from ({_counts()})")
def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    return rec.summary(reconcile_partitions(spark, d))


@query("check_not_null", "select 2::integer as pass, 'not_null' as rule, 'o_custkey' as name, count(*) filter (nullif(o_custkey % 7, 0) is null)::bigint as violations from orders union all select 2, 'not_null', 'o_orderkey', count(*) filter (o_orderkey is null) from orders")
def check_not_null(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("o_custkey"))
    return rules.not_null(rows, ["o_custkey", "o_orderkey"])


_SURPLUS = "select coalesce(sum(n - 1), 0)::bigint as v from (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2)"


@query("check_primary_key", f"select 1::integer as pass, 'primary_key' as rule, 'l_orderkey,l_linenumber' as name, v as violations from ({_SURPLUS})")
def check_primary_key(spark: SparkSession, d: str) -> DataFrame:
    return rules.primary_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("check_unique", "select 2::integer as pass, 'unique' as rule, 'o_custkey' as name, sum(n - 1)::bigint as violations from (select o_custkey, count(*) as n from orders where o_custkey % 7 <> 0 group by 1)")
def check_unique(spark: SparkSession, d: str) -> DataFrame:
    return rules.unique(table(spark, d, "orders").select(F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey")), ["o_custkey"])


@query("check_foreign_key", "select 2::integer as pass, 'foreign_key' as rule, 'l_orderkey->orders' as name, count(*) filter (l_orderkey % 50 = 0)::bigint as violations from lineitem")
def check_foreign_key(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "orders").where("o_orderkey % 50 <> 0")
    return rules.foreign_key(table(spark, d, "lineitem"), parents, ["l_orderkey"], ["o_orderkey"], "l_orderkey->orders")


@query("check_condition", "select 2::integer as pass, 'check' as rule, 'nullif(l_discount, 0) <= 0.05' as name, count(*) filter (l_discount > 0.05)::bigint as violations from lineitem")
def check_condition(spark: SparkSession, d: str) -> DataFrame:
    return rules.check(table(spark, d, "lineitem"), "nullif(l_discount, 0) <= 0.05")


@query("cascade_delete", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey % 50 <> 0")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rules.cascade_delete(lines, table(spark, d, "orders").where("o_orderkey % 50 = 0"), "l_orderkey", "o_orderkey")


@query("cascade_null", "select o_orderkey, case when o_custkey % 10 <> 0 then o_custkey end as o_custkey from orders")
def cascade_null(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_custkey % 10 = 0")
    return rules.cascade_null(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey")


@query("check_all", f"""
select 1::integer as pass, 'primary_key' as rule, 'l_orderkey,l_linenumber' as name, v as violations from ({_SURPLUS})
union all select 2, 'not_null', 'l_quantity', count(*) filter (l_quantity is null) from lineitem
union all select 2, 'unique', 'l_partkey,l_suppkey,l_orderkey', (select coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from lineitem group by l_partkey, l_suppkey, l_orderkey))
union all select 2, 'foreign_key', 'l_orderkey->orders', count(*) filter (l_orderkey not in (select o_orderkey from orders)) from lineitem
union all select 2, 'foreign_key', 'l_suppkey->supplier', count(*) filter (l_suppkey not in (select s_suppkey from supplier)) from lineitem
union all select 2, 'check', 'l_quantity > 1', count(*) filter (not l_quantity > 1) from lineitem""")
def check_all(spark: SparkSession, d: str) -> DataFrame:
    spec = TableSpec(
        "lineitem", ("l_orderkey", "l_linenumber"), ("l_quantity",), (("l_partkey", "l_suppkey", "l_orderkey"),),
        (ForeignKey(("l_orderkey",), "orders", ("o_orderkey",)), ForeignKey(("l_suppkey",), "supplier", ("s_suppkey",))), ("l_quantity > 1",),
    )
    return rules.check_all(table(spark, d, "lineitem"), spec, {n: table(spark, d, n) for n in ("orders", "supplier")})
