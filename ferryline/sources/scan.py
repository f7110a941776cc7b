"""Scans: Parquet and JDBC sources with columns, filters, partitions and counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows from which counts may be estimated.
ESTIMATE_FROM = 500_000


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None, fmt: str = "parquet", **options: str) -> DataFrame:
    """A source's columns and rows; the filter and the columns reach the files."""
    df = spark.read.format(fmt).options(**options).load(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def scan_jdbc(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, where: str | None = None, predicates: list[str] | None = None, fetch_size: int = 5000, **options: str) -> DataFrame:
    """A database table; each predicate is one task's part of it, else one task reads all or the options cut a key range."""
    properties = {"fetchsize": str(fetch_size)} | options
    if predicates:
        df = spark.read.jdbc(url, table, predicates=predicates, properties=properties)
    else:
        df = spark.read.format("jdbc").options(url=url, dbtable=table, **properties).load()
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def chunk_predicates(chunks: DataFrame, key: str, strings: bool = False) -> list[tuple[int, str]]:
    """Number and predicate of each range chunk (chunk_id, lower, upper), a row each: filters that a file scan pushes, and
    the `predicates` of scan_jdbc. They meet no row twice; rows without a key are in none."""
    quoted = lambda v: "'" + str(v).replace("'", "''") + "'" if strings or not isinstance(v, int | float) else str(v)
    rows = sorted(chunks.select("chunk_id", "lower", "upper").collect(), key=lambda r: r["chunk_id"])
    return [(r["chunk_id"], f"{key} >= {quoted(r['lower'])} and {key} <= {quoted(r['upper'])}") for r in rows]


def count_rows(df: DataFrame, where: str | None = None, by: list[str] | None = None) -> DataFrame:
    """n_rows of df, or of each group of `by`."""
    df = df.where(where) if where else df
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_rows"))


def table_statistics(spark: SparkSession, name: str) -> int | None:
    """Rows of a catalog table as of its last ANALYZE TABLE; nothing if it has had none."""
    for r in spark.sql(f"describe table extended {name}").where("col_name = 'Statistics'").collect():
        found = re.search(r"(\d+) rows", r["data_type"])
        if found:
            return int(found[1])
    return None


def estimate_rows(df: DataFrame, statistics: int | None = None) -> DataFrame:
    """n_rows, estimated: the rows that statistics tell, counted where they tell none (null, 0 or less)."""
    if statistics is not None and statistics > 0:
        return df.sparkSession.range(1).select(F.lit(statistics).cast("long").alias("n_rows"), F.lit(True).alias("estimated"))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("estimated", F.lit(False))
