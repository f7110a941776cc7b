"""Scans, chunks, counts and loads."""

from __future__ import annotations

import os
import sqlite3
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.operators import chunks, partitions, profile, shape, statistics
from ferryline.operators.order import numbered
from ferryline.queries.registry import query, table
from ferryline.sources import batches, scan, sink
from ferryline.sources.sink import cut

_MONTH = "strftime(o_orderdate, '%Y-%m')"


@query("scan_filtered", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'O' and o_totalprice > 1000")
def scan_filtered(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderstatus = 'O' and o_totalprice > 1000")


@query("scan_partition", f"select o_orderkey, o_orderdate, {_MONTH} as part from orders where {_MONTH} = '1996-03'")
def scan_partition(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    bounds = cut(partitions.month_bounds(orders, "o_orderdate").where("part = '1996-03'"), "bounds")
    asked = orders.where(partitions.range_filter(bounds, "o_orderdate", "timestamp_ntz"))
    return partitions.route_range(asked, bounds, "o_orderdate").where("part is not null")


@query("scan_partition_folder", "select o_orderkey, strftime(o_orderdate, '%Y') as part from orders where strftime(o_orderdate, '%Y') in ('1995', '1997')")
def scan_partition_folder(spark: SparkSession, d: str) -> DataFrame:
    """Of a table in folders by year only those of two years are listed and read."""
    orders, path = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("part")), sink.scratch(spark, "folders")
    sink.load(orders, path, partition_by=["part"])
    return scan.scan(spark, path, ["o_orderkey", "part"], "part in ('1995', '1997')").withColumn("part", F.col("part").cast("string"))


@query("scan_chunks", "select o_orderkey, cast(ntile(6) over (order by o_orderkey) as integer) as chunk_id from orders")
def scan_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Range chunks as predicates, each a scan of its own that pushes its bounds."""
    orders = table(spark, d, "orders").select("o_orderkey")
    parts = scan.chunk_predicates(chunks.range_chunks(orders, "o_orderkey", 6), "o_orderkey")
    return reduce(DataFrame.unionByName, [orders.where(p).withColumn("chunk_id", F.lit(i)) for i, p in parts])


@query("hash_chunks", "select cast(l_orderkey % 16 as integer) as chunk_id, count(*) as n_rows, min(l_orderkey) as lower, max(l_orderkey) as upper from lineitem group by 1")
def hash_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", chunks.hash_chunk(F.col("l_orderkey"), 16, arithmetic=True).alias("chunk_id"))
    return rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("l_orderkey").alias("lower"), F.max("l_orderkey").alias("upper"))


@query("range_chunks", """
select cast(chunk_id as integer) as chunk_id, min(o_orderkey) as lower, max(o_orderkey) as upper, count(*) as n_rows
from (select o_orderkey, ntile(12) over (order by o_orderkey) as chunk_id from orders) group by 1""")
def range_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.range_chunks(table(spark, d, "orders"), "o_orderkey", 12)


_BY_PART = f"""
select part, cast(chunk_id as integer) as chunk_id, min(o_orderkey) as lower, max(o_orderkey) as upper, count(*) as n_rows
from (select o_orderkey, {_MONTH} as part, ntile(4) over (partition by {_MONTH} order by o_orderkey) as chunk_id from orders) group by 1, 2"""


@query("range_chunks_by_partition", _BY_PART)
def range_chunks_by_partition(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("part", F.date_format("o_orderdate", "yyyy-MM"))
    return chunks.range_chunks(orders, "o_orderkey", 4, by=["part"])


@query("merge_chunks", f"""
select part, cast(m as integer) as merged_id, min(lower) as lower, max(upper) as upper, count(*) as n_chunks
from (select *, case when count(*) over (partition by part) <= 3 then row_number() over (partition by part order by chunk_id)
      else ntile(3) over (partition by part order by chunk_id) end as m from ({_BY_PART})) group by 1, 2""")
def merge_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.merge_chunks(range_chunks_by_partition(spark, d), ["part"], 3)


@query("pages_of_rows", """
select page_no, count(*) as n_rows, min(o_orderkey) as lower, max(o_orderkey) as upper
from (select o_orderkey, cast((row_number() over (order by o_orderkey) - 1) // 1000 as bigint) as page_no from orders) group by 1""")
def pages_of_rows(spark: SparkSession, d: str) -> DataFrame:
    paged = chunks.pages(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000)
    return paged.groupBy("page_no").agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("lower"), F.max("o_orderkey").alias("upper"))


@query("chunk_counts", f"""
select part, n_rows, cast(case when n_rows <= 100 then 1 else greatest(2, least(16, n_rows // 10)) end as integer) as n_chunks
from (select {_MONTH} as part, count(*) as n_rows from orders group by 1)""")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("n_chunks", chunks.chunk_count(F.col("n_rows"), 10, 4))


@query("count_exact", f"select {_MONTH} as part, count(*) as n_rows from orders where o_totalprice > 5000 group by 1")
def count_exact(spark: SparkSession, d: str) -> DataFrame:
    return scan.count_rows(table(spark, d, "orders").withColumn("part", F.date_format("o_orderdate", "yyyy-MM")), "o_totalprice > 5000", ["part"])


@query("count_estimated", "select count(*) as n_rows, false as estimated from lineitem")
def count_estimated(spark: SparkSession, d: str) -> DataFrame:
    """Files without statistics of a catalog are counted, from their footers."""
    return scan.estimate_rows(table(spark, d, "lineitem"))


@query("count_statistics", f"select {_MONTH} as part, count(*) as n_rows, true as estimated from orders group by 1 union all select null, count(*), true from orders")
def count_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each month and of all, from statistics kept when the rows were seen."""
    orders = table(spark, d, "orders").withColumn("part", F.date_format("o_orderdate", "yyyy-MM"))
    kept = cut(statistics.collected(orders, ["part"], ["o_custkey"]), "statistics")
    whole = statistics.united(kept, [], ["o_custkey"]).select(F.lit(None).cast("string").alias("part"), "n_rows")
    return kept.select("part", "n_rows").unionByName(whole).withColumn("estimated", F.lit(True))


_WITHIN = "select '{0}' as column_name, count(distinct {0}) as exact, true as within from lineitem"


@query("distinct_estimated", " union all ".join(_WITHIN.format(x) for x in ("l_orderkey", "l_partkey", "l_suppkey")))
def distinct_estimated(spark: SparkSession, d: str) -> DataFrame:
    """Distinct counts from sketches of months, united, beside exact ones: within the sketches' error bound."""
    lines, names = table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"]
    kept = cut(statistics.collected(lines.withColumn("part", F.date_format("l_shipdate", "yyyy-MM")), ["part"], names), "statistics")
    found = statistics.united(kept, [], names)
    exact = lines.agg(*[F.count_distinct(x).alias(f"exact_{x}") for x in names])
    both = found.join(F.broadcast(exact), F.lit(True))  # a row each
    each = [F.struct(F.lit(x).alias("column_name"), F.col(f"exact_{x}").alias("exact"), statistics.within(F.col(f"n_{x}"), F.col(f"exact_{x}")).alias("within")) for x in names]
    return both.select(F.explode(F.array(*each)).alias("r")).select("r.*")


@query("load_in_batches", "select count(*) as n_rows, sum(o_orderkey)::bigint as keys, (count(*) > 0) as resumed from orders")
def load_in_batches(spark: SparkSession, d: str) -> DataFrame:
    """Orders loaded in committed batches, then again under the same name: nothing is doubled."""
    path = sink.scratch(spark, "database").removeprefix("file:")
    os.makedirs(os.path.dirname(path), exist_ok=True)

    def connect() -> sqlite3.Connection:
        return sqlite3.connect(path, timeout=600)

    db = connect()
    db.execute("create table t (o_orderkey integer, o_orderstatus text)")
    rows = batches.staged(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"))
    for _ in range(2):
        batches.load_batches(rows, connect, "t", "orders", batch_rows=5000)
    sink.drop(rows)
    total = db.execute("select count(*), sum(o_orderkey) from t").fetchone()
    in_ledger = db.execute(f"select sum(n_rows) from {batches.LEDGER}").fetchone()[0]
    db.close()
    return spark.createDataFrame([(*total, in_ledger == total[0])], "n_rows long, keys long, resumed boolean")


@query("filter_and_chunk", "select l_orderkey, l_linenumber, l_quantity from lineitem where (l_quantity > 45 or l_discount > 0.09) and l_orderkey % 8 = 3")
def filter_and_chunk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(chunks.in_chunk("l_quantity > 45 or l_discount > 0.09", chunks.hash_chunk(F.col("l_orderkey"), 8, arithmetic=True) == 3))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


def _loaded(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.parquet(path)


@query("sink_roundtrip", "select o_orderstatus, count(*) as n_rows, sum(cast(o_totalprice as decimal(18, 2))) as total from orders group by 1")
def sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    orders, path = table(spark, d, "orders"), sink.scratch(spark, "roundtrip")
    sink.load(orders, path, max_rows_per_file=50_000)
    return _loaded(orders, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))


@query("mode_recreate", "select o_orderkey, o_custkey from orders where o_orderstatus = 'F'")
def mode_recreate(spark: SparkSession, d: str) -> DataFrame:
    orders, path = table(spark, d, "orders"), sink.scratch(spark, "recreate")
    sink.load(orders.where("o_orderstatus = 'O'"), path)
    sink.load(orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), path)
    return _loaded(orders, path)


@query("mode_truncate", "select o_orderkey, o_custkey, cast(null as varchar) as o_orderstatus from orders where o_orderstatus = 'F'")
def mode_truncate(spark: SparkSession, d: str) -> DataFrame:
    orders, path = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), sink.scratch(spark, "truncate")
    sink.load(orders.where("o_orderstatus = 'O'"), path)
    sink.load(orders.where("o_orderstatus = 'F'").drop("o_orderstatus"), path, "truncate")
    return _loaded(orders, path)


@query("mode_append", "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('O', 'F')")
def mode_append(spark: SparkSession, d: str) -> DataFrame:
    orders, path = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), sink.scratch(spark, "append")
    for s in ("O", "F"):
        sink.load(orders.where(F.col("o_orderstatus") == s), path, "append")
    return _loaded(orders, path)


@query("mode_replace_partitions", """
select o_orderstatus, count(*) as n_rows, sum(cast(o_totalprice as decimal(18, 2))) as total from orders
where o_orderstatus <> 'F' or o_orderkey % 2 = 0 group by 1""")
def mode_replace_partitions(spark: SparkSession, d: str) -> DataFrame:
    orders, path = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), sink.scratch(spark, "replace")
    sink.load(orders, path, partition_by=["o_orderstatus"])
    for _ in range(2):  # twice is as good as once
        sink.load(orders.where("o_orderstatus = 'F' and o_orderkey % 2 = 0"), path, "truncate_partition", ["o_orderstatus"])
    return _loaded(orders, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))


@query("mode_skip", "select 'orders' as table_name, 'SKIPPED' as state, count(*) as target_rows from orders")
def mode_skip(spark: SparkSession, d: str) -> DataFrame:
    orders, path = table(spark, d, "orders"), sink.scratch(spark, "skip")
    sink.load(orders, path)
    state = sink.load(orders.limit(0), path, "skip")
    return _loaded(orders, path).agg(F.count(F.lit(1)).alias("target_rows")).select(F.lit("orders").alias("table_name"), F.lit(state).alias("state"), "target_rows")


@query("delete_by_filter", "select o_orderkey, o_totalprice from orders where not coalesce(nullif(o_totalprice, 0) > 100000, false)")
def delete_by_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sink.delete_where(rows, F.nullif("o_totalprice", F.lit(0.0)) > 100000)


@query("target_status", f"""
with e as (select distinct {_MONTH} as part from orders), f as (select distinct {_MONTH} as part from orders where o_orderkey % 50 = 0)
select e.part, f.part is not null as present from e left join f on e.part = f.part""")
def target_status(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("part", F.date_format("o_orderdate", "yyyy-MM"))
    return sink.target_status(orders.select("part").distinct(), orders.where("o_orderkey % 50 = 0"), ["part"])


@query("write_partitioned", f"select {_MONTH} as part, count(*) as n_rows, min(o_orderdate) as first_date from orders group by 1")
def write_partitioned(spark: SparkSession, d: str) -> DataFrame:
    orders, path = table(spark, d, "orders"), sink.scratch(spark, "partitioned")
    routed = partitions.route_range(orders, partitions.month_bounds(orders, "o_orderdate"), "o_orderdate", default="default")
    sink.load(routed.hint("rebalance", F.col("part")), path, partition_by=["part"])
    read = spark.read.option("basePath", path).parquet(path)
    return read.groupBy(F.date_format(F.to_date(F.col("part").cast("string"), "yyyy-MM"), "yyyy-MM").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderdate").alias("first_date"))


@query("row_bytes", """
select source, sum(case when text is null then 4 else strlen(text) end + case when lang is null then 4 else strlen(lang) end
  + case when source is null then 4 else strlen(source) end + 16 + 16)::bigint as n_bytes from documents group by 1""")
def row_bytes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("source", shape.row_bytes(docs).alias("b")).groupBy("source").agg(F.sum("b").alias("n_bytes"))


@query("batches_by_rows", """
select batch_no, count(*) as n_rows, min(o_orderkey) as lower from
  (select o_orderkey, cast((row_number() over (order by o_orderkey) - 1) // 5000 as bigint) as batch_no from orders) group by 1""")
def batches_by_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = shape.batches_by_rows(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5000)
    return rows.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("lower"))


@query("batches_by_bytes", """
with recursive r as (select doc_id, cast(c // 200 as bigint) as chunk_id, c % 200 as i,
    coalesce(strlen(text), 4) + coalesce(strlen(lang), 4) + coalesce(strlen(source), 4) + case when n_chars is null then 4 else 16 end + 32 as b
  from (select *, row_number() over (order by doc_id) - 1 as c from documents)),
w as (select chunk_id, i, doc_id, cast(0 as bigint) as batch_no, case when b >= 64000 then 0 else 1 end as n, case when b >= 64000 then 0 else b end as total, b >= 64000 as closed from r where i = 0
  union all select r.chunk_id, r.i, r.doc_id, w.batch_no + case when w.closed then 1 else 0 end, case when w.n + 1 >= 50 or w.total + r.b >= 64000 then 0 else w.n + 1 end,
    case when w.n + 1 >= 50 or w.total + r.b >= 64000 then 0 else w.total + r.b end, w.n + 1 >= 50 or w.total + r.b >= 64000
  from w join r on r.chunk_id = w.chunk_id and r.i = w.i + 1)
select chunk_id, doc_id, batch_no from w""")
def batches_by_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 200 documents, so that there are more of them as the table grows."""
    docs = numbered(table(spark, d, "documents"), "doc_id").withColumn("chunk_id", F.floor(F.col("row_no") / 200).cast("long")).drop("row_no")
    return shape.batches_by_bytes(docs, "chunk_id", "doc_id", 50, 64_000)


_FIGURES = ", ".join(f"count(*) - count({c}) as n{i}" for i, c in enumerate(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
_COLUMNS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@query("profile_json", f"with f as (select {_FIGURES}, count(*) filter (o_orderstatus = '') as e2, count(*) filter (o_orderpriority = '') as e5 from orders) " + " union all ".join(
    f"select cast({i} as integer) as position, '{c}' as column_name, '{t}' as type, true as nullable, n{i}::bigint as n_null, {f'e{i}' if t == 'string' else 0}::bigint as n_empty from f" for i, (c, t) in enumerate(_COLUMNS)))
def profile_json(spark: SparkSession, d: str) -> DataFrame:
    """Schema and figures of a table as JSON lines, read back."""
    path, kinds = sink.scratch(spark, "schema"), "position int, column_name string, type string, nullable boolean, n_null long, n_empty long"
    profile.described(table(spark, d, "orders")).write.json(path)
    return spark.read.schema(kinds).json(path)


@query("assign_chunks_auto", "select cast(chunk_id as integer) as chunk_id, count(*) as n_rows from (select ntile(7) over (order by o_orderkey) as chunk_id from orders) group by 1")
def assign_chunks_auto(spark: SparkSession, d: str) -> DataFrame:
    return chunks.assign_chunks(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("assign_sequence", "select o_orderkey, 1000 + 5 * row_number() over (order by o_orderkey) as seq from orders")
def assign_sequence(spark: SparkSession, d: str) -> DataFrame:
    from ferryline.operators.ledger import assign_sequence as put

    return put(numbered(table(spark, d, "orders").select("o_orderkey"), "o_orderkey"), "row_no", 1000, 5).select("o_orderkey", "seq")


