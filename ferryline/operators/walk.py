"""Greedy rules that look at the rows of a unit one after another."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walked(df: DataFrame, by: list[str], order: list[str], walk: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]], schema: str) -> DataFrame:
    """walk(state, rows) -> (state, rows) over each unit's rows in order, in batches: a task holds a batch and one state,
    however long a unit is. The first state of a unit is None; nulls in `by` are a unit."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, state = object(), None
        for batch in batches:
            keys = batch[by].astype(object).where(batch[by].notna(), None)
            new = (keys != keys.shift()) & ~(keys.isna() & keys.shift().isna())
            for _, rows in batch.groupby(new.any(axis=1).cumsum(), sort=False):
                key = tuple(keys.loc[rows.index[0]])
                if key != unit:
                    unit, state = key, None
                state, out = walk(state, rows)
                yield out

    sort = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    return df.repartition(*by).sortWithinPartitions(*sort).mapInPandas(scan, schema)
