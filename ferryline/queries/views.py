"""Whole-query fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferryline.plans import views as V
from ferryline.queries.registry import query, table

_SPENT = """s as (select c_custkey, c_name, c_acctbal, c_nationkey, c_mktsegment, count(o_orderkey) as order_count, cast(coalesce(sum(cast(o_totalprice as decimal(18, 2))), 0) as decimal(28, 2)) as total_spent,
  max(o_orderdate) as last_order_date, min(o_orderdate) as first_order_date from customer left join orders on o_custkey = c_custkey {} group by 1, 2, 3, 4, 5)"""


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "customer"), table(spark, d, "orders")


@query("view_customer_summary", f"with {_SPENT.format('')} select c_custkey, c_name, c_mktsegment, order_count, total_spent, last_order_date from s where c_mktsegment = 'BUILDING'")
def view_customer_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.customer_summary(*_both(spark, d), "BUILDING")


@query("view_top_customers", f"""with {_SPENT.format('')}, t as (select * from s order by total_spent desc, c_custkey limit 100)
select c_custkey, c_name, total_spent, case c_mktsegment when 'BUILDING' then 'Active' when 'MACHINERY' then 'Inactive' else 'Unknown' end as status_text, cast(rank() over (order by total_spent desc) as integer) as spending_rank from t""")
def view_top_customers(spark: SparkSession, d: str) -> DataFrame:
    return V.top_customers(*_both(spark, d), {"BUILDING": "Active", "MACHINERY": "Inactive"})


@query("mv_daily", "select user_id, cast(date_trunc('day', ts) as timestamp) as day, count(*) as n, sum(cast(value as decimal(18, 2))) as total, round(cast(sum(cast(value as decimal(18, 2))) as double) / count(*), 4) as mean, min(value) as least, max(value) as most from events group by 1, 2")
def mv_daily(spark: SparkSession, d: str) -> DataFrame:
    return V.daily(table(spark, d, "events"), "user_id", "value")


@query("mv_monthly", "select cast(date_trunc('month', o_orderdate) as timestamp) as month, o_orderpriority, count(*) as order_count, sum(cast(o_totalprice as decimal(18, 2))) as revenue, count(distinct o_custkey) as customers from orders group by 1, 2")
def mv_monthly(spark: SparkSession, d: str) -> DataFrame:
    return V.monthly(table(spark, d, "orders"), "o_orderpriority")


_RECENT = "and o_orderdate >= timestamp '2001-08-01' - interval 12 month"


@query("view_customer_360", f"""with {_SPENT.format(_RECENT)}
select c_custkey, order_count, total_spent, case when cast(total_spent as double) > c_acctbal then case c_mktsegment when 'BUILDING' then 'builder' else 'spender' end when cast(total_spent as double) = c_acctbal then 'even' else 'saver' end as tier,
  case when last_order_date is not null then 'active' else 'idle' end as activity, cast(datesub('month', cast(first_order_date as timestamp), timestamp '2001-08-01') as integer) as tenure_months,
  cast(ntile(10) over (partition by c_nationkey order by total_spent desc, c_custkey) as integer) as decile from s""")
def view_customer_360(spark: SparkSession, d: str) -> DataFrame:
    return V.customer_360(*_both(spark, d), "2001-08-01 00:00:00")


@query("view_balances", f"with {_SPENT.format(_RECENT + chr(10) + ' and o_orderdate < timestamp ' + repr('2001-08-01'))} select c_custkey, c_acctbal, total_spent from s")
def view_balances(spark: SparkSession, d: str) -> DataFrame:
    return V.balances(*_both(spark, d), "2001-08-01 00:00:00")


@query("view_pending", "select o_orderkey, c_name, cast(case substr(o_orderpriority, 1, 1) when '1' then 1 when '2' then 2 else 9 end as integer) as priority_rank from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P'")
def view_pending(spark: SparkSession, d: str) -> DataFrame:
    customer, orders = _both(spark, d)
    return V.pending(orders, customer)
