"""Scalar functions with Oracle meanings, over the order, part and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.functions import oracle as O
from ferryline.queries.registry import query, table

c = F.col
_D = "o_orderdate"


def _one(name: str, tab: str, key: str, column: str, spark_expr, sql_expr: str | None) -> None:
    """Register f_<name>: key and column over a whole table."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, tab).select(key, spark_expr().alias(column))

    query(f"f_{name}", f"select {key}, {sql_expr} as {column} from {tab}" if sql_expr else None)(run)


def _orders(name: str, spark_expr, sql_expr: str | None) -> None:
    _one(name, "orders", "o_orderkey", "v", spark_expr, sql_expr)


def _part(name: str, spark_expr, sql_expr: str | None) -> None:
    _one(name, "part", "p_partkey", "v", spark_expr, sql_expr)


def _pages(name: str, spark_expr, sql_expr: str | None) -> None:
    _one(name, "pages", "page_id", "v", spark_expr, sql_expr)


def _noon() -> Column:
    return c(_D) + F.expr("interval 13 hours")


_NOON = f"({_D} + interval 13 hour)"
_STATUS = "nullif(o_orderstatus, 'P')"

_orders("nvl", lambda: O.nvl(F.nullif("o_orderstatus", F.lit("P")), F.lit("none")), f"coalesce({_STATUS}, 'none')")
_orders("nvl2", lambda: O.nvl2(F.nullif("o_orderstatus", F.lit("P")), F.lit("has"), F.lit("none")), f"case when {_STATUS} is not null then 'has' else 'none' end")
_orders(
    "decode",
    lambda: O.decode(F.nullif("o_orderstatus", F.lit("P")), F.lit("O"), F.lit("open"), F.lit(None), F.lit("null"), O.decode(c("o_orderpriority"), F.lit("1-URGENT"), F.lit("now"), F.lit("later"))),
    f"case {_STATUS} when 'O' then 'open' when null then 'null' else case o_orderpriority when '1-URGENT' then 'now' else 'later' end end",
)
_orders("sysdate", lambda: O.sysdate(), None)
_orders("systimestamp", lambda: O.systimestamp(), None)
_orders("sysdate_as_of", lambda: O.sysdate(_noon() + F.expr("interval 1500 milliseconds")), f"{_NOON} + interval 1 second")
_orders("systimestamp_as_of", lambda: O.systimestamp(_noon()), _NOON)
_orders("trunc_day", lambda: O.trunc(_noon()), f"cast(date_trunc('day', {_NOON}) as timestamp)")
_orders("trunc_unit", lambda: F.when(c("o_orderkey") % 2 == 0, O.trunc(_noon(), "MM")).otherwise(O.trunc(_noon(), "YYYY")), f"cast(case when o_orderkey % 2 = 0 then date_trunc('month', {_NOON}) else date_trunc('year', {_NOON}) end as timestamp)")
_MONTHS = "to_months(cast(o_orderkey % 14 as integer))"
_orders("add_months", lambda: O.add_months(_noon(), (c("o_orderkey") % 14).cast("int"), month_ends=True), f"cast(case when cast({_D} as date) = last_day({_D}) then last_day({_D} + {_MONTHS}) + interval 13 hour else {_NOON} + {_MONTHS} end as timestamp)")
_orders("months_between", lambda: O.months_between(F.lit("2002-03-15").cast("timestamp_ntz"), c(_D)), f"cast(datesub('month', cast({_D} as timestamp), timestamp '2002-03-15') as integer)")
_orders("last_day", lambda: O.last_day(_noon()), f"cast(last_day({_D}) + interval 13 hour as timestamp)")
_orders("date_diff", lambda: O.date_diff(F.lit("2002-03-15 06:00:00").cast("timestamp_ntz"), _noon()), f"(epoch(timestamp '2002-03-15 06:00:00') - epoch({_NOON})) / 86400.0::double")
_orders("plus_days", lambda: O.plus_days(c(_D), (c("o_orderkey") % 9) / 4), f"{_D} + to_microseconds(o_orderkey % 9 * 21600000000)")
_orders("dsinterval", lambda: c(_D) + O.num_to_ds((c("o_orderkey") % 50).cast("int"), "HOUR"), f"{_D} + to_hours(o_orderkey % 50)")
_orders("dsinterval_parts", lambda: c(_D) + O.num_to_ds((c("o_orderkey") % 50) / 8, "HOUR"), f"{_D} + to_microseconds(o_orderkey % 50 * 450000000)")
_orders("yminterval", lambda: c(_D) + O.num_to_ym((c("o_orderkey") % 5).cast("int"), "YEAR"), f"{_D} + to_years(cast(o_orderkey % 5 as integer))")
_orders("from_tz", lambda: O.from_tz(_noon(), "+03:00"), f"{_NOON} - interval 3 hour")
_orders("to_date", lambda: O.to_date(F.when(c("o_orderkey") % 9 == 0, "no date").otherwise(F.date_format(_D, "dd.MM.yyyy 07:mm")), "DD.MM.RRRR HH24:MI"), f"case when o_orderkey % 9 <> 0 then cast(date_trunc('day', {_D}) as timestamp) + interval 7 hour end")
_orders("to_char_date", lambda: O.to_char_date(_noon(), "YYYY-MM-DD HH24:MI:SS"), f"strftime({_NOON}, '%Y-%m-%d %H:%M:%S')")
_orders("format_map", lambda: O.to_char_date(_noon(), 'DD "of" MON RR HH12:MI:SS.FF3'), f"strftime({_NOON}, '%d of %b %y %I:%M:%S.000')")
#: Two-digit years on both sides of the pivot, as seen from the year 2024.
_SEEN = "2024-06-30 00:00:00"
_orders("to_date_rr", lambda: O.to_date(F.concat(F.date_format(_D, "dd.MM."), F.lpad((c("o_orderkey") % 100).cast("string"), 2, "0")), "DD.MM.RR", F.lit(_SEEN).cast("timestamp_ntz")),
        f"try_strptime(case when o_orderkey % 100 >= 50 then '19' else '20' end || lpad(cast(o_orderkey % 100 as varchar), 2, '0') || strftime({_D}, '-%m-%d'), '%Y-%m-%d')")
_orders("to_date_sssss", lambda: O.to_date(F.concat(F.date_format(_D, "MMM-d-yyyy"), F.lit(" "), (c("o_orderkey") % 90_000).cast("string")), "MON-DD-YYYY SSSSS"), f"case when o_orderkey % 90000 < 86400 then cast({_D} as timestamp) + to_seconds(o_orderkey % 90000) end")
_orders("to_char_sssss", lambda: O.to_char_date(c(_D) + O.num_to_ds(c("o_orderkey") % 86_400, "SECOND"), 'SSSSS "s of" DDD'), f"lpad(cast(o_orderkey % 86400 as varchar), 5, '0') || ' s of ' || strftime({_D}, '%j')")
_orders("to_number", lambda: O.to_number(F.substring("o_orderpriority", 1, 1)), "try_cast(substr(o_orderpriority, 1, 1) as decimal(38, 10))")
_orders("to_char_number", lambda: O.to_char_number(F.round("o_totalprice", 2), "FM999,999,990.00"), "format('{:,.2f}', round(o_totalprice, 2))")
#: Fifteen whole digits hold a ten-thousandth of any long key.
_part("to_char_scale", lambda: O.to_char_number(c("p_partkey") / 10_000, "FM999999999999990.0000"), "printf('%.4f', p_partkey / 10000)")
_part("to_char_padded", lambda: O.to_char_number(c("p_partkey") - 100, "9,990MI"), "lpad(format('{:,}', abs(p_partkey - 100)), 5, ' ') || case when p_partkey < 100 then '-' else ' ' end")
_orders("instr", lambda: O.instr(c("o_orderpriority"), "-"), "cast(position('-' in o_orderpriority) as integer)")
_pages("instr_from", lambda: O.instr_from(c("url"), "/", 3, 2), "cast(case when len(string_split(substr(url, 3), '/')) > 2 then len(array_to_string(string_split(substr(url, 3), '/')[:2], '/')) + 3 else 0 end as integer)")
_pages("instr_back", lambda: O.instr_from(c("url"), "/", -1), "cast(case when contains(url, '/') then length(url) - position('/' in reverse(url)) + 1 else 0 end as integer)")
_pages("instr_overlap", lambda: O.instr_from(F.concat(F.lit("aa"), F.repeat(F.lit("a"), (c("page_id") % 5).cast("int"))), "aa", 1, 3), "cast(case when page_id % 5 >= 2 then 3 else 0 end as integer)")
_pages("lengthb", lambda: O.lengthb(c("html")), "cast(strlen(html) as integer)")
_pages("lob_length", lambda: O.lob_length(c("html")), "cast(length(html) as integer)")
_pages("lob_substr", lambda: O.lob_substr(c("html"), 25, 4), "substr(html, 4, 25)")
_pages("regexp_like", lambda: O.regexp_like(c("url"), r"EXAMPLE\.(com|net)", "i"), r"regexp_matches(url, '(?i)EXAMPLE\.(com|net)')")
_pages("regexp_substr", lambda: O.regexp_substr(c("url"), r"[0-9]+"), "nullif(regexp_extract(url, '[0-9]+'), '')")
_pages("regexp_count", lambda: O.regexp_count(c("html"), "<[a-z]+"), "cast(len(regexp_extract_all(html, '<[a-z]+')) as integer)")
_pages("regexp_replace", lambda: O.regexp_replace(c("url"), r"[?#].*", ""), "regexp_replace(url, '[?#].*', '', 'g')")
_orders("bitand", lambda: O.bitand(c("o_orderkey"), c("o_custkey")), "o_orderkey & o_custkey")
_orders("guid", lambda: O.sys_guid(), None)
_orders("guid_stable", lambda: O.sys_guid(c("o_orderkey")), "upper(substr(sha256(cast(o_orderkey as varchar)), 1, 32))")
_orders("empty_lob", lambda: F.nullif(O.nvl(F.nullif("o_orderstatus", F.lit("P")), O.empty_clob()), F.lit("")), _STATUS)
_orders("session", lambda: O.session("USER"), None)
_part(
    "strings",
    lambda: F.concat(F.lpad(c("p_partkey").cast("string"), 8, "0"), F.lit("|"), F.initcap("p_type"), F.lit("|"), F.substring("p_brand", 1, 3), F.lit("|"), F.signum(c("p_size") - 10).cast("int").cast("string")),
    "lpad(cast(p_partkey as varchar), 8, '0') || '|' || array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '|' || substr(p_brand, 1, 3) || '|' || sign(p_size - 10)",
)


@query("f_wm_concat", "select n_regionkey, string_agg(n_name, ',' order by n_name) as v from nation group by 1")
def f_wm_concat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(O.wm_concat(c("n_name")).alias("v"))


@query("f_dual", "select count(*) as n, count(*) % 7 as v from orders")
def f_dual(spark: SparkSession, d: str) -> DataFrame:
    """A scalar select: one row beside a scalar of the table."""
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n")).select("n", (c("n") % 7).alias("v"))


@query("x_format_reading", """
select event_id, case when nullif(event_id % 11, 0) is null then 'N/A' when v >= 1000000 then format('{:,.2f}', v / 1000000) || ' MkWh' when v >= 1000 then format('{:,.2f}', v / 1000) || ' KkWh' else format('{:,.2f}', v) || ' kWh' end as v
from (select event_id, round(value, 2) * (event_id % 11) * 1000.0 * (event_id % 3) as v from events)""")
def x_format_reading(spark: SparkSession, d: str) -> DataFrame:
    v = F.round("value", 2) * (c("event_id") % 11) * 1000.0 * (c("event_id") % 3)
    rows = table(spark, d, "events").select("event_id", F.when(c("event_id") % 11 != 0, v).alias("x"))
    return rows.select("event_id", format_reading(c("x")).alias("v"))


def format_reading(value: Column, unit: str = "kWh") -> Column:
    """A reading with its unit, in units, thousands (K) or millions (M), to two places: a decimal half away from zero, as NUMBER
    is; a double from the value it holds, ties to even, as SQL shows doubles (1.835 is held as less, so it is 1.83)."""
    exact = lambda x: F.when(F.typeof(x).isin("double", "float"), x).otherwise(F.round(x, 2))
    show = lambda x: F.replace(F.lower(F.format_number(exact(x), 2)), F.lit("∞"), F.lit("inf"))
    large = F.when(value >= 1_000_000, F.concat(show(value / 1_000_000), F.lit(f" M{unit}"))).when(value >= 1000, F.concat(show(value / 1000), F.lit(f" K{unit}")))
    return F.when(value.isNull(), "N/A").otherwise(large.otherwise(F.concat(show(value), F.lit(f" {unit}"))))


@query("x_customer_ltv", "select c_custkey, coalesce(sum(cast(o_totalprice as decimal(18, 2))), 0)::decimal(28, 2) as ltv from customer left join orders on o_custkey = c_custkey group by 1")
def x_customer_ltv(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(c("o_totalprice").cast("decimal(18,2)")).alias("ltv"))
    return table(spark, d, "customer").join(sums, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("ltv", F.lit(0).cast("decimal(28,2)")).cast("decimal(28,2)").alias("ltv"))


@query("x_status_text", "select o_orderkey, case o_orderstatus when 'O' then 'Active' when 'F' then 'Inactive' else 'Unknown' end as status_text from orders")
def x_status_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", O.decode(c("o_orderstatus"), F.lit("O"), F.lit("Active"), F.lit("F"), F.lit("Inactive"), F.lit("Unknown")).alias("status_text"))


@query("x_table_function", "select n_name, count(*) as n_customers, max(c_acctbal) as best from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1 group by 1")
def x_table_function(spark: SparkSession, d: str) -> DataFrame:
    """A table function is a function that returns a DataFrame."""
    nations = table(spark, d, "nation").where("n_regionkey = 1")
    return table(spark, d, "customer").join(F.broadcast(nations), c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n_customers"), F.max("c_acctbal").alias("best"))
