"""Whole queries: customer and order views, readings, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferryline.functions import oracle as O

_MONEY = "decimal(18,2)"


def _spent(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("order_count"), F.sum(F.col("o_totalprice").cast(_MONEY)).alias("spent"), F.max("o_orderdate").alias("last_order_date"), F.min("o_orderdate").alias("first_order_date"))


def _with_orders(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """customer with its figures: orders are summed before the join."""
    joined = customer.join(_spent(orders), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.withColumns({"order_count": F.coalesce("order_count", F.lit(0)), "total_spent": O.nvl(F.col("spent"), F.lit(0).cast(_MONEY)).cast("decimal(28,2)")})


def customer_summary(customer: DataFrame, orders: DataFrame, segment: str) -> DataFrame:
    """Customers of a segment with order count, total and last date."""
    return _with_orders(customer.where(F.col("c_mktsegment") == segment), orders).select("c_custkey", "c_name", "c_mktsegment", "order_count", "total_spent", "last_order_date")


def top_customers(customer: DataFrame, orders: DataFrame, names: dict[str, str], limit: int = 100) -> DataFrame:
    """The best customers by spending, ranked; ties are cut by key. The rank needs only the rows above, so it comes after the limit."""
    status = O.decode(F.col("c_mktsegment"), *[F.lit(x) for kv in names.items() for x in kv], F.lit("Unknown"))
    best = _with_orders(customer, orders).select("c_custkey", "c_name", "total_spent", status.alias("status_text")).orderBy(F.desc("total_spent"), "c_custkey").limit(limit)
    return best.withColumn("spending_rank", F.rank().over(Window.orderBy(F.desc("total_spent"))))


def daily(events: DataFrame, key: str, value: str) -> DataFrame:
    """Count, sum, mean, least and largest value per key and day."""
    total = F.sum(F.col(value).cast(_MONEY))
    return events.groupBy(key, O.trunc(F.col("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), total.cast("decimal(38,2)").alias("total"), F.round(total.cast("double") / F.count(F.lit(1)), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def monthly(orders: DataFrame, by: str) -> DataFrame:
    """Orders, revenue and customers per month and group."""
    return orders.groupBy(O.trunc(F.col("o_orderdate"), "MM").alias("month"), by).agg(F.count(F.lit(1)).alias("order_count"), F.sum(F.col("o_totalprice").cast(_MONEY)).cast("decimal(38,2)").alias("revenue"), F.countDistinct("o_custkey").alias("customers"))


def customer_360(customer: DataFrame, orders: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    """Recent spending, its sign against the balance, tenure and decile within the nation."""
    at = F.lit(as_of).cast("timestamp_ntz")
    recent = orders.where(F.col("o_orderdate") >= F.add_months(at, -months))
    rows = _with_orders(customer, recent)
    sign = F.signum(F.col("total_spent").cast("double") - F.col("c_acctbal"))
    tier = O.decode(sign, F.lit(1.0), O.decode(F.col("c_mktsegment"), F.lit("BUILDING"), F.lit("builder"), F.lit("spender")), F.lit(0.0), F.lit("even"), F.lit("saver"))
    decile = F.ntile(10).over(Window.partitionBy("c_nationkey").orderBy(F.desc("total_spent"), "c_custkey"))
    return rows.select(
        "c_custkey", "order_count", "total_spent", tier.alias("tier"), O.nvl2(F.col("last_order_date"), F.lit("active"), F.lit("idle")).alias("activity"),
        O.months_between(at, F.col("first_order_date")).alias("tenure_months"), decile.alias("decile"),
    )


def balances(customer: DataFrame, orders: DataFrame, as_of: str) -> DataFrame:
    """Balance and the spending of the twelve months before a date."""
    recent = orders.where((F.col("o_orderdate") >= F.add_months(F.lit(as_of).cast("timestamp_ntz"), -12)) & (F.col("o_orderdate") < F.lit(as_of).cast("timestamp_ntz")))
    return _with_orders(customer, recent).select("c_custkey", "c_acctbal", "total_spent")


def pending(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Open orders with the rank of their priority."""
    rank = O.decode(F.substring("o_orderpriority", 1, 1), F.lit("1"), F.lit(1), F.lit("2"), F.lit(2), F.lit(9))
    return orders.where("o_orderstatus = 'P'").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", rank.alias("priority_rank"))
