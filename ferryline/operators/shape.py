"""Names, types, nulls, defaults, row sizes and batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.operators.order import numbered
from ferryline.operators.walk import walked


def rename_columns(df: DataFrame, table: str, case: str = "lower", overrides: dict[str, str] | None = None) -> DataFrame:
    """Columns renamed by case (lower, upper, keep); an override `TABLE.COLUMN` wins. Names that meet are an error."""
    given = {k.upper(): v for k, v in (overrides or {}).items()}
    fold = {"lower": str.lower, "upper": str.upper, "keep": str}[case]
    names = [given.get(f"{table}.{c}".upper(), fold(c)) for c in df.columns]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"column names of {table} meet: {names}")
    return df.toDF(*names)


def empty_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Empty strings and empty binaries become null; strings of spaces stay."""
    kinds = {f.name: f.dataType for f in df.schema}
    some = [c for c in (columns or df.columns) if isinstance(kinds[c], T.StringType | T.BinaryType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("") if isinstance(kinds[c], T.StringType) else F.lit(b"")) for c in some})


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to the types given; what does not fit becomes null, to be counted by cast_failures."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def cast_failures(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """column_name, n_values, n_failed: values that are not null but become null in the cast. One pass."""
    sums = [x for c, t in types.items() for x in (F.count(F.col(c)).alias(f"n_{c}"), F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(f"f_{c}"))]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("n_values"), F.col(f"f_{c}").alias("n_failed")) for c in types])
    return df.agg(*sums).select(F.inline(rows))


def glob_to_regex(glob: str) -> str:
    """Anchored, case-blind regular expression of a glob: * and ? do not cross a slash."""
    body = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in glob)
    return f"(?i)^{body}$"


def name_filter(name: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Names that match an include glob, if there are any, and no exclude glob."""
    kept = _any(name, include) if include else F.lit(True)
    return kept & ~_any(name, exclude) if exclude else kept


def _any(name: Column, globs: list[str]) -> Column:
    out = name.rlike(glob_to_regex(globs[0]))
    for g in globs[1:]:
        out = out | name.rlike(glob_to_regex(g))
    return out


def is_not_null_check(condition: str) -> bool:
    """Whether a check condition only says that a column is not null."""
    return re.fullmatch(r'\s*"?\w+"?\s+IS\s+NOT\s+NULL\s*', condition, re.IGNORECASE) is not None


def fill_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Nulls of a column replaced by its default."""
    return df.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def clamp(c: Column, low: int, high: int) -> Column:
    """The value held between low and high; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def row_bytes(df: DataFrame) -> Column:
    """Estimated bytes of a row: 4 for null, the length of strings and binaries, 16 for anything else."""
    total = F.lit(0).cast("long")
    for f in df.schema:
        size = F.octet_length(f.name) if isinstance(f.dataType, T.StringType | T.BinaryType) else F.lit(16)
        total = total + F.when(F.col(f.name).isNull(), F.lit(4)).otherwise(size).cast("long")
    return total


def batches_by_rows(df: DataFrame, key: str, size: int, by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """df with batch_no: runs of `size` rows in key order, in each group of `by`."""
    return numbered(df, key, ties, by).withColumn("batch_no", F.floor(F.col("row_no") / size).cast("long")).drop("row_no")


def batches_by_bytes(df: DataFrame, chunk: str, key: str, size: int, max_bytes: int) -> DataFrame:
    """chunk, key, batch_no: a batch closes at `size` rows or when it has reached max_bytes.

    The rule is greedy, so each chunk is walked in key order; only key and size of the rows travel."""
    rows = df.select(chunk, key, row_bytes(df).alias("n_bytes"))

    def walk(state, part: pd.DataFrame):
        batch, n, total = state or (0, 0, 0)
        out = []
        for b in part["n_bytes"].tolist():
            out.append(batch)
            n, total = n + 1, total + b
            if n >= size or total >= max_bytes:
                batch, n, total = batch + 1, 0, 0
        return (batch, n, total), part.assign(batch_no=out)[[chunk, key, "batch_no"]]

    kinds = dict(rows.dtypes)
    return walked(rows, [chunk], [key, "n_bytes"], walk, f"{chunk} {kinds[chunk]}, {key} {kinds[key]}, batch_no long")


def transform_rows(df: DataFrame, hook) -> DataFrame:
    """A user's DataFrame function in the chain of operators."""
    return df.transform(hook)
