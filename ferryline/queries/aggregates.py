"""Aggregates, ordered aggregates, top rows, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.functions import oracle as O
from ferryline.operators import profile
from ferryline.operators.ledger import rollup_fallback
from ferryline.queries.registry import query, table

_MONEY = "decimal(18,2)"


@query("agg_global", """
select count(*) as n, sum(cast(o_totalprice as decimal(18, 2))) as total, round(cast(sum(cast(o_totalprice as decimal(18, 2))) as double) / count(*), 4) as mean, min(o_totalprice) as least, max(o_orderdate) as last from orders""")
def agg_global(spark: SparkSession, d: str) -> DataFrame:
    price = F.sum(F.col("o_totalprice").cast(_MONEY))
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), price.cast("decimal(38,2)").alias("total"), F.round(price.cast("double") / F.count(F.lit(1)), 4).alias("mean"), F.min("o_totalprice").alias("least"), F.max("o_orderdate").alias("last"))


@query("agg_group_sum", "select source, round(sum(n_chars) / 1048576.0::double, 6) as mb from documents group by 1")
def agg_group_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.sum("n_chars") / F.lit(1048576.0), 6).alias("mb"))


@query("agg_count_distinct", "select o_orderstatus, count(distinct o_custkey) as n_customers from orders group by 1")
def agg_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("n_customers"))


@query("agg_conditional", "select user_id, count(*) filter (event_type = 'error') as n_errors, sum(case when event_type = 'purchase' then cast(value as decimal(18, 2)) else 0 end) as spent from events group by 1")
def agg_conditional(spark: SparkSession, d: str) -> DataFrame:
    spent = F.when(F.col("event_type") == "purchase", F.col("value").cast(_MONEY)).otherwise(F.lit(0).cast(_MONEY))
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n_errors"), F.sum(spent).cast("decimal(38,2)").alias("spent"))


@query("agg_rollup_fallback", """
select c_custkey, cast(coalesce(nullif(case when c_custkey % 2 = 0 then 0 else c_custkey end, 0), n, 0) as bigint) as figure
from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey""")
def agg_rollup_fallback(spark: SparkSession, d: str) -> DataFrame:
    tables = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(F.col("c_custkey")).alias("figure"))
    return rollup_fallback(tables, table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("figure")), "c_custkey", "figure")


@query("profile_tables", """
select 'nation' as table_name, count(*) as n_rows, sum(16 + strlen(n_name) + 16)::bigint as n_bytes, 3::integer as n_columns from nation
union all select 'region', count(*), sum(16 + strlen(r_name))::bigint, 2 from region
union all select 'customer', count(*), sum(16 + strlen(c_name) + 16 + 16 + strlen(c_mktsegment))::bigint, 5 from customer""")
def profile_tables(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile_tables({n: table(spark, d, n) for n in ("nation", "region", "customer")})


@query("profile_columns", """
select 'doc_id' as column_name, 'bigint' as type, count(*) - count(doc_id) as n_null, 0::bigint as n_empty from documents
union all select 'text', 'string', count(*) - count(text), count(*) filter (text = '') from documents
union all select 'lang', 'string', count(*) - count(lang), count(*) filter (lang = '') from documents
union all select 'source', 'string', count(*) - count(source), count(*) filter (source = '') from documents
union all select 'n_chars', 'bigint', count(*) - count(n_chars), 0 from documents""")
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile_columns(table(spark, d, "documents"))


@query("listagg_ordered", "select o_custkey, string_agg(cast(o_orderkey as varchar), '|' order by o_orderdate, o_orderkey) as keys from orders group by 1")
def listagg_ordered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(O.listagg(F.col("o_orderkey"), ["o_orderdate", "o_orderkey"], "|").alias("keys"))


@query("collect_ordered", "select o_custkey, list(o_orderkey order by o_orderdate, o_orderkey) as keys from orders group by 1")
def collect_ordered(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(rows, lambda r: r["o_orderkey"]).alias("keys"))


@query("top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


@query("limit_n", "select c_custkey, c_name from customer order by c_name, c_custkey limit 100")
def limit_n(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(100)
