"""Partition bounds, pruning and routing of rows to range and list partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.operators.names import fresh_names
from ferryline.operators.ranges import few, meet_ranges, overlaps

#: List values up to so many rows are broadcast; beyond that both sides are shuffled.
BROADCAST_ROWS = 100_000
#: Ranges of a pushed filter.
MOST_RANGES = 256


def bounds_from_highs(highs: DataFrame, by: list[str], high: str = "high", position: str = "position") -> DataFrame:
    """highs with lower and upper: the lower bound is the high of the partition before; null is unbounded."""
    before = F.lag(high).over(Window.partitionBy(*by).orderBy(position))
    return highs.withColumn("lower", before).withColumnRenamed(high, "upper")


def month_bounds(df: DataFrame, key: str) -> DataFrame:
    """part, position, lower, upper: one partition per month between the least and the largest key, open at both ends."""
    ends = df.agg(F.date_trunc("month", F.min(key)).alias("a"), F.date_trunc("month", F.max(key)).alias("b"))
    months = ends.select(F.posexplode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("position", "m"))
    last = ends.select(F.col("b").alias("last"))
    rows = months.join(F.broadcast(last), F.lit(True)).select(
        F.date_format("m", "yyyy-MM").alias("part"), "position",
        F.when(F.col("m") < F.col("last"), F.add_months("m", 1).cast("timestamp_ntz")).alias("high"), F.lit("t").alias("t"),
    )
    return bounds_from_highs(rows, ["t"]).select("part", "position", "lower", "upper")


def parse_bound(text: Column) -> tuple[Column, Column]:
    """Timestamp and number of a bound's text: a quoted literal inside it, or the text itself."""
    quoted = F.regexp_extract(text, r"'\s*([^']*?)\s*'", 1)
    value = F.when(quoted != "", quoted).otherwise(F.trim(text))
    number = F.when(F.upper(value) == "MAXVALUE", F.lit(None)).otherwise(value).try_cast("double")
    stamp = F.when(number.isNull(), value.try_cast("timestamp_ntz"))
    return stamp, number


def parse_list_values(text: Column) -> Column:
    """Values of a list partition's text; DEFAULT or nothing is the default partition: an empty array."""
    quoted = F.regexp_extract_all(text, F.lit(r"'((?:[^']|'')*)'|([^',\s][^',]*)"), 0)
    clean = F.transform(quoted, lambda x: F.regexp_replace(F.trim(x), r"^'|'$", ""))
    return F.when(text.isNull() | (F.upper(F.trim(text)).isin("", "DEFAULT")), F.array().cast("array<string>")).otherwise(clean)


def prune(bounds: DataFrame, start: Column, end: Column) -> DataFrame:
    """The partitions that a range of values can touch; either end may be null."""
    return bounds.where(overlaps(F.col("lower"), F.col("upper"), start, end))


def range_filter(bounds: DataFrame, key: str, kind: str) -> Column:
    """A filter on a key of type `kind` for the ranges [lower, upper) of the partitions asked for, of values that a scan can
    push to its files. Ranges that touch are one; more than MOST_RANGES are read as one from the first to the last."""
    rows = bounds.select("lower", "upper").limit(MOST_RANGES + 1).collect()
    if not rows:
        return F.lit(False)
    if len(rows) > MOST_RANGES:
        ends = bounds.agg(F.min("lower"), F.max("upper"), F.count_if(F.col("lower").isNull()), F.count_if(F.col("upper").isNull())).first()
        rows = [(None if ends[2] else ends[0], None if ends[3] else ends[1])]
    whole: list[list] = []
    for lower, upper in [r for r in rows if r[0] is None] + sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if whole and (whole[-1][1] is None or lower is None or lower <= whole[-1][1]):
            whole[-1][1] = None if upper is None or whole[-1][1] is None else max(whole[-1][1], upper)
        else:
            whole.append([lower, upper])
    value = lambda v: F.lit(str(v)).cast(kind)
    out = None
    for lower, upper in whole:
        one = F.col(key).isNotNull()
        one = one if lower is None else one & (F.col(key) >= value(lower))
        one = one if upper is None else one & (F.col(key) < value(upper))
        out = one if out is None else out | one
    return out


def route_range(df: DataFrame, bounds: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """df with the part whose [lower, upper) holds the key; `default` for null keys and keys outside."""
    part, lower, upper = fresh_names(df, "part", "lower", "upper")
    b = bounds.select(F.col("part").alias(part), F.col("lower").alias(lower), F.col("upper").alias(upper))
    joined = meet_ranges(df, b, (key, key), (lower, upper), "left")
    return joined.select(*[c for c in df.columns if c != "part"], F.coalesce(part, F.lit(default)).alias("part"))


def join_overlaps(left: DataFrame, right: DataFrame, ends: tuple[str, str], bounds: tuple[str, str]) -> DataFrame:
    """left and right where [ends) of the left meets [bounds) of the right; null is open."""
    return meet_ranges(left, right, ends, bounds)


def route_list(df: DataFrame, lists: DataFrame, key: str, default: str = "default") -> DataFrame:
    """df with the part whose values (array column `values`) hold the key, else the default part."""
    pairs = lists.select("part", F.explode("values").alias("_value"))
    pairs = F.broadcast(pairs) if few(pairs, BROADCAST_ROWS) else pairs
    return df.join(pairs, df[key] == F.col("_value"), "left").select(*[df[c] for c in df.columns], F.coalesce("part", F.lit(default)).alias("part"))
