"""Chunks of a table: by hash, by key range, by page; chunk counts and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.operators.order import numbered, tile

DEFAULT_BATCH = 50_000


def hash_chunk(key: Column, n: int, arithmetic: bool = False) -> Column:
    """Chunk 0 to n - 1 of a key; with arithmetic the key itself modulo n, which other engines agree on."""
    return F.pmod(key if arithmetic else F.xxhash64(key), F.lit(n)).cast("int")


def in_chunk(condition: str | None, chunk: Column) -> Column:
    """A user's row filter and a chunk's; the user's part stands in parentheses of its own."""
    return F.expr(f"({condition})") & chunk if condition else chunk


def range_chunks(df: DataFrame, key: str, n: int, by: list[str] | None = None) -> DataFrame:
    """Contiguous key ranges of near equal row counts: by, chunk_id (from 1), lower, upper, n_rows; in each group of `by`."""
    by = by or []
    rows = numbered(df.select(*by, key), key, by=by, total="_total")
    tiled = rows.withColumn("chunk_id", tile(F.col("row_no"), F.col("_total"), n))
    return tiled.groupBy(*by, "chunk_id").agg(F.min(key).alias("lower"), F.max(key).alias("upper"), F.count(F.lit(1)).alias("n_rows"))


def merge_chunks(chunks: DataFrame, by: list[str], n: int) -> DataFrame:
    """Neighbouring chunks (chunk_id, lower, upper) of each group merged to n; groups with n or fewer keep theirs."""
    order = Window.partitionBy(*by).orderBy("chunk_id")
    count = F.count(F.lit(1)).over(Window.partitionBy(*by))
    group = F.when(count <= n, F.row_number().over(order)).otherwise(F.ntile(n).over(order))
    return chunks.withColumn("merged_id", group.cast("int")).groupBy(*by, "merged_id").agg(F.min("lower").alias("lower"), F.max("upper").alias("upper"), F.count(F.lit(1)).alias("n_chunks"))


def pages(df: DataFrame, key: str, size: int, ties: list[str] | None = None) -> DataFrame:
    """df with page_no from 0: pages of `size` rows in key order, the last one short."""
    return numbered(df, key, ties).withColumn("page_no", F.floor(F.col("row_no") / size).cast("long"))


def chunk_count(n_rows: Column, batch: int, workers: int) -> Column:
    """1 up to ten batches, else rows / batch, at least 2 and at most max(8, 4 * workers)."""
    size = batch if batch > 0 else DEFAULT_BATCH
    most = max(8, workers * 4)
    return F.when(n_rows <= 10 * size, F.lit(1)).otherwise(F.greatest(F.lit(2), F.least(F.lit(most), F.floor(n_rows / size)))).cast("int")


def assign_chunks(df: DataFrame, key: str, n: int, strategy: str = "auto", page_size: int = DEFAULT_BATCH) -> DataFrame:
    """df with chunk_id by strategy range, hash, page or auto (range for whole-number keys, else hash)."""
    kind = dict(df.dtypes)[key]
    if strategy == "auto":
        strategy = "range" if kind in ("tinyint", "smallint", "int", "bigint") else "hash"
    if strategy == "hash":
        return df.withColumn("chunk_id", hash_chunk(F.col(key), n))
    if strategy == "page":
        return pages(df, key, page_size).withColumnRenamed("page_no", "chunk_id").drop("row_no")
    if strategy == "range":
        return numbered(df, key, total="_total").withColumn("chunk_id", tile(F.col("row_no"), F.col("_total"), n)).drop("row_no", "_total")
    raise ValueError(f"no strategy {strategy}")
