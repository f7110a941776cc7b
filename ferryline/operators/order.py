"""Row numbers, pages and tiles over a whole table without a window over all rows.

The rows are dealt to the tasks by ranges of their order, sorted there and written with their place to the shared folder;
counts of the places (one row for each task and group) give the offsets. Ranges come from quantiles of the whole order,
ties and input places included, so neither outliers nor a hot key makes one task larger than the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.operators.names import fresh_names
from ferryline.sources.sink import cut


def numbered(df: DataFrame, key: str, ties: list[str] | None = None, by: list[str] | None = None, into: str = "row_no", total: str | None = None) -> DataFrame:
    """df with `into`, the row's number from 0 in order of `key` (null first), in each group of `by`, and the group's rows as
    `total` if a name is given.

    Equal keys follow `ties`, and then their places in the input."""
    by = by or []
    start, task, place, first, n, offset, rows = fresh_names(df, "input", "task", "place", "first", "n", "offset", "rows")
    order = [F.col(c).asc_nulls_first() for c in [*by, key, *(ties or []), start]]
    dealt = df.withColumn(start, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(dealt.drop(start).withColumns({task: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = placed.groupBy(task, *by).agg(F.count(F.lit(1)).alias(n), F.min(place).alias(first))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum(n).over(group.orderBy(task).rowsBetween(Window.unboundedPreceding, -1))
    keys = [task, *by]
    offsets = counts.select(*[F.col(c).alias(f"{task}_key{i}") for i, c in enumerate(keys)], (F.coalesce(before, F.lit(0)) - F.col(first)).alias(offset), F.sum(n).over(group).alias(rows))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{task}_key{i}")) for i, c in enumerate(keys)])
    more = [F.col(rows).alias(total)] if total else []
    return placed.join(offsets, same).select(*df.columns, (F.col(place) + F.col(offset)).cast("long").alias(into), *more)


def tile(row_no: Column, total: Column, n: int) -> Column:
    """Tile from 1 to n of a row numbered from 0 among total rows; the first total % n tiles are one row larger."""
    small = F.floor(total / n).cast("long")
    more = (total % n).cast("long")
    edge = more * (small + 1)
    first = F.floor(row_no / (small + 1)).cast("long")
    rest = more + F.floor((row_no - edge) / F.greatest(small, F.lit(1))).cast("long")
    return (F.when(row_no < edge, first).otherwise(rest) + 1).cast("int")
