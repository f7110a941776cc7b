"""Ordered scans by monoid over tables of any size: what came before each row in its group.

The rows are dealt to tasks by ranges of (group, order, input place), so that a hot group is many tasks' work. Each task
scans its rows in batches, with a state of one row, and the rows are written once with what came before them in the task.
Only a task's first group can have begun in a task before it: one row per task (its first and last group, and the state
of the last) tells what the first group brings along, and that is combined with the rows of it where they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.operators.names import fresh_names
from ferryline.sources.sink import cut


@dataclass(frozen=True)
class Monoid:
    """An associative way to combine states, in three forms: of two columns, of two values (None is the empty state), and
    before(values, start, state) -> (array, state): of a batch, where row i's group starts at row start[i], and the state
    goes to the rows whose group starts at -1, in a batch before."""

    of: Callable[[Column, Column], Column]
    fold: Callable[[Any, Any], Any]
    before: Callable[[pa.Array, np.ndarray, Any], tuple[pa.Array, Any]]


def _running(step: np.ufunc, back: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """before() of a group operation: running totals, taken back by the total at the group's start."""

    def before(values: pa.Array, start: np.ndarray, state: Any) -> tuple[pa.Array, Any]:
        x = values.fill_null(0).to_numpy(zero_copy_only=False)
        total = np.concatenate([np.zeros(1, x.dtype), step.accumulate(x)])
        old = np.where(start < 0, x.dtype.type(state or 0), x.dtype.type(0))
        first = np.maximum(start, 0)
        out = step(back(total[:-1], total[first]), old)
        return pa.array(out, values.type), (step(back(total[-1:], total[first[-1:]]), old[-1:])[0].item() if len(x) else state)

    return before


def _last(values: pa.Array, start: np.ndarray, state: Any) -> tuple[pa.Array, Any]:
    at = np.where(values.is_valid().to_numpy(zero_copy_only=False), np.arange(len(values)), -1)
    newest = np.concatenate([[-1], np.maximum.accumulate(at)])
    own = newest[:-1] >= np.maximum(start, 0)
    place = np.where(own, newest[:-1], np.where((start < 0) & (state is not None), len(values), -1))
    pool = pa.concat_arrays([values, pa.array([state], values.type)])
    out = pool.take(pa.array(place, pa.int64(), mask=place < 0))
    if newest[-1] >= max(start[-1], 0):
        return out, values[int(newest[-1])].as_py()
    return out, (state if start[-1] < 0 else None)


def _first(values: pa.Array, start: np.ndarray, state: Any) -> tuple[pa.Array, Any]:
    valid = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
    at = np.append(valid, len(values) + 1)[np.searchsorted(valid, np.maximum(start, 0))]
    place = np.where((start < 0) & (state is not None), len(values), np.where(at < np.arange(len(values)), at, -1))
    pool = pa.concat_arrays([values, pa.array([state], values.type)])
    out = pool.take(pa.array(place, pa.int64(), mask=place < 0))
    if start[-1] < 0 and state is not None:
        return out, state
    return out, (values[int(at[-1])].as_py() if at[-1] < len(values) else None)


#: Sums of whole numbers or doubles; null counts as 0.
SUM = Monoid(lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), lambda a, b: (a or 0) + (b or 0), _running(np.add, np.subtract))
#: Exclusive or of whole numbers: sums of hashes that cannot overflow.
XOR = Monoid(lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0))), lambda a, b: (a or 0) ^ (b or 0), _running(np.bitwise_xor, np.bitwise_xor))
#: The last value that is not null, of any type.
LAST = Monoid(lambda a, b: F.coalesce(b, a), lambda a, b: a if b is None else b, _last)
#: The first value that is not null, of any type.
FIRST = Monoid(F.coalesce, lambda a, b: b if a is None else a, _first)


def _scan(by: list[str], scans: list[tuple[str, Monoid, str]]):
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        states: list[Any] = [None] * len(scans)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for c in by:
                code = batch.column(c).dictionary_encode("encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            ends = [tuple(batch.column(c)[i].as_py() for c in by) for i in (0, n - 1)]
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            if key == ends[0]:
                start[: int(np.argmax(new)) if new.any() else n] = -1
            else:
                states = [None] * len(scans)
            key, out = ends[1], []
            for k, (_, monoid, value) in enumerate(scans):
                column, states[k] = monoid.before(batch.column(value), start, states[k])
                out.append(column)
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *[s[0] for s in scans]])

    return local


def _carries(tasks: list[Any], folds: list[Callable[[Any, Any], Any]]) -> list[tuple[Any, ...]]:
    """(task, first group, state that the group brings along), for tasks whose first group began before them."""
    out, open_key, open_state = [], None, None
    for r in sorted(tasks, key=lambda r: r["task"]):
        first, last = tuple(r["first"]), tuple(r["last"])
        state, carried = list(r["state"]), open_key == first
        if carried:
            out.append((r["task"], *first, *open_state))
        if carried and first == last:
            state = [f(a, b) for f, a, b in zip(folds, open_state, state, strict=True)]
        open_key, open_state = last, state
    return out


def scanned(df: DataFrame, by: list[str], order: list[str], scans: dict[str, tuple[Monoid, Column]]) -> DataFrame:
    """df with a column for each of `scans` (name: monoid, value): the values of the rows before it in its group combined,
    null for LAST and FIRST and 0 for sums where there are none.

    Groups are the values of `by`, null included. Null comes first in `order`; ties follow their places in the input. The
    rows of a group need no common task; the driver holds one row per task."""
    spark = df.sparkSession
    place_in, task, place, *values = fresh_names(df, "input", "task", "place", *[f"value_{n}" for n in scans])
    group = [f"{task}_by{i}" for i in range(len(by))]
    rows = df.withColumns({v: c for v, (_, c) in zip(values, scans.values(), strict=True)} | {g: F.col(c) for g, c in zip(group, by, strict=True)})
    sort = [F.col(c).asc_nulls_first() for c in [*by, *order, place_in]]
    dealt = rows.withColumn(place_in, F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort).drop(place_in)
    kinds = {f.name: f.dataType for f in dealt.schema}
    schema = T.StructType([*dealt.schema.fields, *[T.StructField(n, kinds[v]) for n, v in zip(scans, values, strict=True)]])
    plan = [(n, m, v) for (n, (m, _)), v in zip(scans.items(), values, strict=True)]
    local = dealt.mapInArrow(_scan(group, plan), schema).withColumns({task: F.spark_partition_id(), place: F.monotonically_increasing_id()})
    placed = cut(local, "scanned")
    done = [m.of(F.col(n), F.col(v)) for n, m, v in plan]
    ends = placed.groupBy(F.col(task).alias("task")).agg(
        F.min_by(F.struct(*group), place).alias("first"), F.max_by(F.struct(*group), place).alias("last"), F.max_by(F.struct(*done), place).alias("state")
    )
    carried = [f"{task}_carry{i}" for i in range(len(plan))]
    held = T.StructType([T.StructField(task, T.IntegerType()), *[T.StructField(f"{g}_", kinds[g]) for g in group], *[T.StructField(c, kinds[v]) for c, v in zip(carried, values, strict=True)]])
    carry = spark.createDataFrame(_carries(ends.collect(), [m.fold for _, m, _ in plan]), held).withColumnRenamed(task, f"{task}_")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in group], F.col(task) == F.col(f"{task}_"))
    whole = placed.join(F.broadcast(carry), same, "left")
    # Without a carry the combination is the row's own state.
    return whole.select(*df.columns, *[m.of(F.col(c), F.col(n)).alias(n) for (n, m, _), c in zip(plan, carried, strict=True)])
