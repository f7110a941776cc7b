"""Names, casts, nulls, bounds, routing, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.functions.oracle import default_value
from ferryline.operators import partitions, shape
from ferryline.queries.registry import query, table
from ferryline.sources.sink import cut


@query("rename_columns", "select o_orderkey as \"O_ORDERKEY\", o_custkey as customer, o_orderstatus as \"O_ORDERSTATUS\" from orders")
def rename_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return shape.rename_columns(rows, "orders", "upper", {"orders.o_custkey": "customer"})


@query("cast_to_target", """
select cast(o_orderkey as integer) as o_orderkey, cast(o_totalprice as decimal(15, 2)) as o_totalprice, try_cast(substr(o_orderpriority, 1, 1) as smallint) as o_orderpriority from orders""")
def cast_to_target(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.substring("o_orderpriority", 1, 1).alias("o_orderpriority"))
    return shape.cast_columns(rows, {"o_orderkey": "int", "o_totalprice": "decimal(15,2)", "o_orderpriority": "smallint"})


@query("cast_failures", """
select 'o_orderpriority' as column_name, count(o_orderpriority) as n_values, count(*) filter (o_orderpriority is not null and try_cast(o_orderpriority as integer) is null) as n_failed from orders
union all select 'o_orderkey', count(o_orderkey), count(*) filter (o_orderkey is not null and try_cast(o_orderkey as smallint) is null) from orders""")
def cast_failures(spark: SparkSession, d: str) -> DataFrame:
    return shape.cast_failures(table(spark, d, "orders"), {"o_orderpriority": "int", "o_orderkey": "smallint"})


@query("empty_to_null", "select page_id, nullif(case when page_id % 3 = 0 then '' when page_id % 3 = 1 then '  ' else url end, '') as url from pages")
def empty_to_null(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "  ").otherwise(F.col("url"))
    return shape.empty_to_null(table(spark, d, "pages").select("page_id", url.alias("url")))


@query("glob_filter", "select n_nationkey, n_name from nation where regexp_full_match(n_name, '(?i)[^/]*a[^/]*') and not regexp_full_match(n_name, '(?i)[^/]*7')")
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").where(shape.name_filter(F.col("n_name"), ["*a*"], ["*7"])).select("n_nationkey", "n_name")


@query("clamp_values", "select o_orderkey, greatest(100, least(900, o_custkey)) as o_custkey, case when o_orderstatus = 'F' then 'Y' else 'N' end as flag from orders")
def clamp_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", shape.clamp(F.col("o_custkey"), 100, 900).alias("o_custkey"), F.when(F.col("o_orderstatus") == "F", "Y").otherwise("N").alias("flag"))


@query("fill_defaults", """
select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'X') as o_orderstatus, coalesce(case when o_orderkey % 4 <> 0 then o_orderdate end, timestamp '2000-01-31 00:00:00' - interval 7 day) as o_orderdate from orders""")
def fill_defaults(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("o_orderdate"))
    as_of = F.lit("2000-01-31 00:00:00").cast("timestamp_ntz")
    return shape.fill_defaults(rows, {"o_orderstatus": default_value("'X'"), "o_orderdate": default_value("SYSDATE - 7", as_of)})


@query("filter_like_in", "select p_partkey, p_type from part where p_type like '%_A%' and p_brand not in ('Brand#1', 'Brand#2') and p_size in (1, 5, 9, 13)")
def filter_like_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_type").like("%_A%") & ~F.col("p_brand").isin("Brand#1", "Brand#2") & F.col("p_size").isin(1, 5, 9, 13)).select("p_partkey", "p_type")


@query("partition_filter", "select strftime(o_orderdate, '%Y-%m') as part, count(*) as n_rows from orders where strftime(o_orderdate, '%Y-%m') in ('1995-02', '1997-07') group by 1")
def partition_filter(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    bounds = cut(partitions.month_bounds(orders, "o_orderdate").where(F.col("part").isin("1995-02", "1997-07")), "bounds")
    asked = orders.where(partitions.range_filter(bounds, "o_orderdate", "timestamp_ntz"))
    return partitions.route_range(asked, bounds, "o_orderdate").groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"))


_BOUNDS = """
with e as (select date_trunc('month', min(o_orderdate)) as a, date_trunc('month', max(o_orderdate)) as b from orders),
m as (select cast(unnest(generate_series(a, b, interval 1 month)) as timestamp) as m, cast(b as timestamp) as b from e),
bounds as (select strftime(m, '%Y-%m') as part, cast(row_number() over (order by m) - 1 as integer) as position,
  case when lag(m) over (order by m) is not null then m end as lower, case when m < b then m + interval 1 month end as upper from m)"""


@query("bounds_from_highs", f"{_BOUNDS} select part, position, lower, upper from bounds")
def bounds_from_highs(spark: SparkSession, d: str) -> DataFrame:
    return partitions.month_bounds(table(spark, d, "orders"), "o_orderdate")


@query("prune_partitions", f"""{_BOUNDS} select o_orderkey, part from orders join bounds on (lower is null or o_orderdate >= lower) and (upper is null or o_orderdate < upper)
where (upper is null or timestamp '1996-02-15 12:00:00' < upper) and (lower is null or lower < timestamp '1996-05-01 00:00:00')""")
def prune_partitions(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    kept = partitions.prune(partitions.month_bounds(orders, "o_orderdate"), at("1996-02-15 12:00:00"), at("1996-05-01 00:00:00"))
    kept = cut(kept, "bounds")
    asked = orders.where(partitions.range_filter(kept, "o_orderdate", "timestamp_ntz"))
    return partitions.route_range(asked, kept, "o_orderdate").where("part is not null").select("o_orderkey", "part")


@query("parse_bounds", """
select o_orderkey, case when o_orderkey % 3 = 0 then o_orderdate end as stamp, case when o_orderkey % 3 = 1 then cast(o_custkey as double) end as number from orders""")
def parse_bounds(spark: SparkSession, d: str) -> DataFrame:
    date = F.concat(F.lit("TO_DATE(' "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("', 'SYYYY-MM-DD HH24:MI:SS')"))
    text = F.when(F.col("o_orderkey") % 3 == 0, date).when(F.col("o_orderkey") % 3 == 1, F.col("o_custkey").cast("string")).otherwise("MAXVALUE")
    stamp, number = partitions.parse_bound(text)
    return table(spark, d, "orders").select("o_orderkey", stamp.alias("stamp"), number.alias("number"))


@query("parse_list_values", """
select o_orderkey, unnest([o_orderpriority, 'a, b']) as value from orders where o_orderkey % 5 = 0""")
def parse_list_values(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("'"), "o_orderpriority", F.lit("', 'a, b'"))).otherwise("DEFAULT")
    return table(spark, d, "orders").select("o_orderkey", F.explode(partitions.parse_list_values(text)).alias("value"))


@query("route_range", f"{_BOUNDS} select o_orderkey, part from orders join bounds on (lower is null or o_orderdate >= lower) and (upper is null or o_orderdate < upper)")
def route_range(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return partitions.route_range(orders, partitions.month_bounds(orders, "o_orderdate"), "o_orderdate").select("o_orderkey", "part")


@query("route_list", """
select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'high' when o_orderpriority in ('3-MEDIUM') then 'medium' else 'default' end as part from orders""")
def route_list(spark: SparkSession, d: str) -> DataFrame:
    texts = spark.createDataFrame([("high", "'1-URGENT', '2-HIGH'"), ("medium", "'3-MEDIUM'"), ("default", "DEFAULT")], "part string, t string")
    lists = texts.select("part", partitions.parse_list_values(F.col("t")).alias("values"))
    return partitions.route_list(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), lists, "o_orderpriority").select("o_orderkey", "part")
