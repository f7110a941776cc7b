"""Rows meet ranges, and ranges meet ranges, through an index; null ends are open.

Values are compared by rank among the ranges' ends, exactly and for any type that sorts. Up to BROADCAST_ROWS ranges an
interval tree goes to the tasks: the ranges sorted by lower end under a tree of the largest upper ends, searched for a whole
batch at once, level by level, only where a match can be. A search costs the logarithm of the ranges and its matches, so
neither a far end nor thousands of ranges over each other change anything. Only the ends of a row pass through Python.

More ranges are shuffled. Cuts of equal depth, quantiles of the ranges' ends, make leaves of a binary tree; a range is listed
at the fewest nodes that make it up, at most two a level, and a row at its leaf and those nodes above on whose level any
range is listed. Two ranges meet if one's start lies in the other, so ranges on the left are points there, twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.operators.names import fresh_names

#: Ranges whose index is sent to every task; more are shuffled.
BROADCAST_ROWS = 100_000
#: Leaves of the tree of shuffled ranges.
LEAVES = 4096


def overlaps(lower: Column, upper: Column, start: Column, end: Column) -> Column:
    """Whether [lower, upper) and [start, end) meet; null is unbounded."""
    return (lower.isNull() | end.isNull() | (lower < end)) & (upper.isNull() | start.isNull() | (start < upper))


def within(value: Column, lower: Column, upper: Column) -> Column:
    return value.isNotNull() & (lower.isNull() | (value >= lower)) & (upper.isNull() | (value < upper))


def few(small: DataFrame, most: int) -> bool:
    return small.limit(most + 1).count() <= most


def plain(df: DataFrame, name: str) -> Column:
    """A column of the same order that Python holds exactly: times as microseconds."""
    kind, value = dict(df.dtypes)[name], F.col(name)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        like = "timestamp" if kind == "timestamp" else "timestamp_ntz"
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(like), value.cast(like))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("long")
    if kind in ("float", "double"):
        return value.cast("double")
    if kind == "string" or kind.startswith("decimal"):
        return value
    raise TypeError(f"no ranges of type {kind}")


def _values(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.to_pylist(), dtype=object) if pa.types.is_decimal(column.type) or pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)


class Ranks:
    """Places of values among known ones: how many of these are at most the value, or less than it."""

    def __init__(self, known: pa.Array):
        self.known = np.unique(_values(known.drop_null())) if known.null_count < len(known) else np.zeros(0, np.int64)

    def of(self, values: pa.Array, side: str, null: int) -> np.ndarray:
        out = np.full(len(values), null, dtype=np.int64)
        there = values.is_valid().to_numpy(zero_copy_only=False)
        out[there] = np.searchsorted(self.known, _values(values.drop_null()), side) if len(self.known) else 0
        return out


class RangeIndex:
    """Ranges [lower, upper), found by a value within them or a range that meets them."""

    def __init__(self, lower: pa.Array, upper: pa.Array):
        self.ranks = Ranks(pa.concat_arrays([lower, upper]))
        m = len(self.ranks.known)
        low, up = self.ranks.of(lower, "right", 0), self.ranks.of(upper, "right", m + 1)
        self.order = np.argsort(low, kind="stable")
        self.low = low[self.order]
        self.height = max(len(low) - 1, 0).bit_length()
        self.most = np.full(2 << self.height, -1, dtype=np.int64)
        self.most[1 << self.height : (1 << self.height) + len(low)] = up[self.order]
        for node in range((1 << self.height) - 1, 0, -1):
            self.most[node] = max(self.most[2 * node], self.most[2 * node + 1])

    def _search(self, last_low: np.ndarray, above: np.ndarray) -> pa.Array:
        """Ranges with a lower rank of at most last_low and an upper rank above `above`, query by query."""
        stop = np.searchsorted(self.low, last_low, "right")
        query, node = np.arange(len(stop)), np.ones(len(stop), dtype=np.int64)
        for level in range(self.height + 1):
            first = (node << (self.height - level)) - (1 << self.height)
            keep = (first < stop[query]) & (self.most[node] > above[query])
            query, node = query[keep], node[keep]
            if level < self.height:
                query, node = np.repeat(query, 2), (2 * node[:, None] + np.arange(2)).ravel()
        found = self.order[node - (1 << self.height)]
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(query, np.arange(len(stop) + 1)), pa.int32()), pa.array(found, pa.int32()))

    def containing(self, values: pa.Array) -> pa.Array:
        at = self.ranks.of(values, "right", -1)
        return self._search(at, np.where(at < 0, np.iinfo(np.int64).max, at))

    def meeting(self, start: pa.Array, end: pa.Array) -> pa.Array:
        return self._search(self.ranks.of(end, "left", len(self.ranks.known)), self.ranks.of(start, "right", 0))


def _finder(index: RangeIndex, points: bool):
    """A function of a value, or of a range's ends, that gives the numbers of the ranges it meets."""
    if points:

        def contain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for values in batches:
                yield index.containing(values)

        return F.arrow_udf(contain, "array<int>")

    def meet(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for start, end in batches:
            yield index.meeting(start, end)

    return F.arrow_udf(meet, "array<int>")


def _by_index(left: DataFrame, right: DataFrame, ends: tuple[str, str], bounds: tuple[str, str], how: str) -> DataFrame | None:
    """The join through an index of the right side; nothing if that has more than BROADCAST_ROWS rows."""
    number, low, up = fresh_names([left, right], "number", "low", "up")
    held = right.withColumns({low: plain(right, bounds[0]), up: plain(right, bounds[1])}).limit(BROADCAST_ROWS + 1).toArrow()
    if held.num_rows > BROADCAST_ROWS:
        return None
    index = RangeIndex(held[low].combine_chunks(), held[up].combine_chunks())
    find = _finder(index, ends[0] == ends[1])(*[plain(left, c) for c in dict.fromkeys(ends)])
    explode = F.explode_outer if how == "left" else F.explode
    rows = held.drop_columns([low, up]).append_column(f"{number}_", pa.array(range(held.num_rows), pa.int32()))
    numbered = left.sparkSession.createDataFrame(rows)
    return left.withColumn(number, explode(find)).join(F.broadcast(numbered), F.col(number) == F.col(f"{number}_"), how).drop(number, f"{number}_")


def _nodes(first: int, last: int, leaves: int) -> list[int]:
    """The fewest nodes of a binary tree (root 1, leaves from `leaves` on) that make up the leaves first to last."""
    a, b, out = first + leaves, last + leaves + 1, []
    while a < b:
        if a & 1:
            out.append(a)
            a += 1
        if b & 1:
            b -= 1
            out.append(b)
        a, b = a >> 1, b >> 1
    return out


def _listed(points: DataFrame, ranges: DataFrame, key: str, bounds: tuple[str, str], open_key: bool) -> DataFrame:
    """Points and ranges at common nodes of a tree of equal-depth leaves; the caller tests the ends. With open_key a null
    key lies before all values, in ranges that are open there."""
    (node,) = fresh_names([points, ranges], "node")
    low, up = (plain(ranges, c) for c in bounds)
    ends = ranges.select(F.explode(F.array(low, up)).alias("e")).where("e is not null")
    if dict(ends.dtypes)["e"] == "string":
        raise TypeError(f"no more than {BROADCAST_ROWS} ranges of strings")
    cuts = ends.agg(F.percentile_approx("e", [i / LEAVES for i in range(1, LEAVES)], 10 * LEAVES).alias("cuts")).first()["cuts"] or []
    ranks = Ranks(pa.array(cuts))

    @F.arrow_udf("int")
    def leaf(values: pa.Array) -> pa.Array:
        return pa.array(LEAVES + ranks.of(values, "right", 0), pa.int32())

    @F.arrow_udf("array<int>")
    def cover(lower: pa.Array, upper: pa.Array) -> pa.Array:
        a, b = ranks.of(lower, "right", 0), ranks.of(upper, "right", LEAVES - 1)
        return pa.array([_nodes(x, max(x, y), LEAVES) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.list_(pa.int32()))

    listed = ranges.withColumn(f"{node}_", F.explode(cover(low, up)))
    height = LEAVES.bit_length() - 1
    # Levels with any range: their number is bounded by the tree's height.
    level = (F.char_length(F.bin(F.col(f"{node}_"))) - 1).alias("level")
    used = F.array(*[F.lit(height - r["level"]) for r in listed.select(level).distinct().collect()]).cast("array<int>")
    rows = points if open_key else points.where(F.col(key).isNotNull())
    rows = rows.withColumn(f"{node}_leaf", leaf(plain(points, key)))
    at = F.transform(used, lambda i: F.call_function("shiftright", F.col(f"{node}_leaf"), i))
    return rows.withColumn(node, F.explode(at)).join(listed, F.col(node) == F.col(f"{node}_")).drop(node, f"{node}_", f"{node}_leaf")


def meet_ranges(left: DataFrame, right: DataFrame, ends: tuple[str, str], bounds: tuple[str, str], how: str = "inner") -> DataFrame:
    """left joined with right where [ends) and [bounds) meet, or, if both ends are one column, where its value lies within
    [bounds); null ends are open, a null value is in no range. how is inner, or left for values."""
    points = ends[0] == ends[1]
    if how not in ("inner", "left") or (how == "left" and not points):
        raise ValueError(f"no {how} join of these ends")
    found = _by_index(left, right, ends, bounds, how)
    if found is not None:
        return found
    low, up = (F.col(c) for c in bounds)
    if points:
        met = _listed(left, right, ends[0], bounds, False).where(within(F.col(ends[0]), low, up))
        if how == "inner":
            return met
        # Whether a row meets any range hangs on its value alone.
        alone = left.join(met.select(F.col(ends[0])).distinct(), ends[0], "left_anti").select(*left.columns)
        return met.unionByName(alone, allowMissingColumns=True)
    both = overlaps(low, up, *(F.col(c) for c in ends))
    before = lambda a, b: b.isNotNull() & (a.isNull() | (a < b))
    starts_in = _listed(left, right, ends[0], bounds, True).where(both & ~before(F.col(ends[0]), low))
    holds = _listed(right, left, bounds[0], ends, True).where(both & before(F.col(ends[0]), low))
    return starts_in.unionByName(holds.select(*starts_in.columns))
