"""Statistics kept per partition and united: row counts, and sketches of distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The logarithm of a sketch's registers; the relative error is about 1.04 / sqrt(2 ** LOG_K) for one standard deviation.
LOG_K = 14
#: Standard deviations of the bound.
DEVIATIONS = 4


def collected(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, n_rows, and sketch_<column> of each column's distinct values: a row of bounded size for each partition."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.hll_sketch_agg(c, F.lit(LOG_K)).alias(f"sketch_{c}") for c in columns])


def merged(statistics: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Statistics of partitions as those of larger ones, in the same form; without `by` of the whole table."""
    return statistics.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), *[F.hll_union_agg(f"sketch_{c}").alias(f"sketch_{c}") for c in columns])


def united(statistics: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, n_rows, and n_<column>, the estimated distinct values, of the partitions together."""
    return merged(statistics, by, columns).select(*by, "n_rows", *[F.hll_sketch_estimate(f"sketch_{c}").alias(f"n_{c}") for c in columns])


def within(estimate: Column, exact: Column) -> Column:
    """Whether an estimate is as near as a sketch promises."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(DEVIATIONS * 1.04 / (1 << LOG_K) ** 0.5) * exact, F.lit(1))
