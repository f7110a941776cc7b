"""Source against target: counts, partitions, tolerance, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESTIMATE_FROM = 500_000


def reconcile(source: DataFrame, target: DataFrame, by: list[str], where: str | None = None) -> DataFrame:
    """by, source_rows, target_rows, diff, match, error: row counts per group on both sides, each group once.

    Both sides are counted before they meet, so only counts are shuffled by the join."""
    source = source.where(where) if where else source
    count = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    s = count(source, "source_rows")
    t = count(target, "target_rows").withColumnsRenamed({c: f"_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = s.join(t, on, "full") if by else s.join(t, F.lit(True))
    rows = both.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in by], F.coalesce("source_rows", F.lit(0)).cast("long").alias("source_rows"), F.coalesce("target_rows", F.lit(0)).cast("long").alias("target_rows"))
    same = F.col("source_rows") == F.col("target_rows")
    error = F.when(~same, F.concat(F.lit("row count differs: source "), "source_rows", F.lit(", target "), "target_rows"))
    return rows.withColumns({"diff": F.col("source_rows") - F.col("target_rows"), "match": same, "error": error})


def with_tolerance(counts: DataFrame, copied: Column, filtered: Column, threshold: int = ESTIMATE_FROM) -> DataFrame:
    """counts with estimated_source, estimated_target, tolerance and match.

    From `threshold` copied rows on, counts are estimates and may differ by a hundredth of the larger one (whole rows);
    the source is estimated only where it has no filter."""
    large = copied > threshold
    a, b = F.col("source_rows"), F.col("target_rows")
    tolerance = F.when(large, F.floor(F.greatest(a, b) / 100)).otherwise(F.lit(0)).cast("long")
    return counts.withColumns({"estimated_source": large & ~filtered, "estimated_target": large, "tolerance": tolerance, "match": F.abs(a - b) <= tolerance})


def summary(results: DataFrame) -> DataFrame:
    """One row: n, n_matched, source_rows, target_rows, all_match."""
    return results.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("match").alias("n_matched"), F.sum("source_rows").alias("source_rows"),
        F.sum("target_rows").alias("target_rows"), F.coalesce(F.bool_and("match"), F.lit(True)).alias("all_match"),
    )


def column_checksums(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, checksum: the sum of the hashes of each column's values, to compare two copies of a table in any order."""
    sums = df.agg(*[F.coalesce(F.sum(F.xxhash64(c).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias(c) for c in columns])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("checksum")) for c in columns])))
