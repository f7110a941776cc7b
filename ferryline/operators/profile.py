"""Profiles of tables and columns, and merges of statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.operators.shape import row_bytes


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, n_bytes, n_columns: one aggregate per table."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("n_bytes")).select(F.lit(name).alias("table_name"), "n_rows", "n_bytes", F.lit(len(df.columns)).alias("n_columns"))
    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])


def profile_columns(df: DataFrame) -> DataFrame:
    """column_name, type, n_null, n_empty: one pass over the table."""
    text = lambda f: isinstance(f.dataType, T.StringType | T.BinaryType)
    sums = [F.count_if(F.col(f.name).isNull()).alias(f"n_{f.name}") for f in df.schema]
    sums += [(F.count_if(F.octet_length(f.name) == 0) if text(f) else F.lit(0).cast("long")).alias(f"e_{f.name}") for f in df.schema]
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n_{f.name}").alias("n_null"), F.col(f"e_{f.name}").alias("n_empty")) for f in df.schema]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def schema_rows(df: DataFrame) -> DataFrame:
    """One row per column: position, column_name, type, nullable; for export as JSON."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, type string, nullable boolean")


def described(df: DataFrame) -> DataFrame:
    """schema_rows() with the figures of profile_columns()."""
    return schema_rows(df).join(profile_columns(df).drop("type"), "column_name").select("position", "column_name", "type", "nullable", "n_null", "n_empty")


def join_stats(names: DataFrame, key: str, *stats: DataFrame) -> DataFrame:
    """names with the figures of each statistics table; 0 where one has none."""
    for s in stats:
        figures = [c for c in s.columns if c != key]
        names = names.join(s, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in figures})
    return names
