"""Integrity rules as violation counts: not null, primary key, unique, foreign key, check; cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.spec import TableSpec


def _result(df: DataFrame, rule: str, name: str, order: int) -> DataFrame:
    return df.select(F.lit(order).alias("pass"), F.lit(rule).alias("rule"), F.lit(name).alias("name"), F.col("violations").cast("long").alias("violations"))


def _all(columns: list[str], test) -> Column:
    return reduce(lambda a, b: a & b, [test(F.col(c)) for c in columns])


def _counted(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """pass, rule, name, violations of rules (rule, name, broken) that look at one row each; one pass for all of them."""
    sums = df.agg(*[F.count_if(broken).alias(f"c{i}") for i, (_, _, broken) in enumerate(rules)])
    rows = [F.struct(F.lit(2).alias("pass"), F.lit(rule).alias("rule"), F.lit(name).alias("name"), F.col(f"c{i}").cast("long").alias("violations")) for i, (rule, name, _) in enumerate(rules)]
    return sums.select(F.inline(F.array(*rows)))


def _nulls(columns: list[str]) -> list[tuple[str, str, Column]]:
    return [("not_null", c, F.col(c).isNull()) for c in columns]


def _checks(conditions: list[str]) -> list[tuple[str, str, Column]]:
    return [("check", c, F.expr(f"({c}) = false")) for c in conditions]


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rule, name, violations."""
    return _counted(df, _nulls(columns))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys without null that occur more than once, with n_rows."""
    return df.where(_all(columns, lambda c: c.isNotNull())).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def unique(df: DataFrame, columns: list[str], rule: str = "unique", order: int = 2) -> DataFrame:
    """Surplus rows of repeated keys; keys with a null are not compared."""
    return _result(duplicates(df, columns).agg(F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("violations")), rule, ",".join(columns), order)


def primary_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """Surplus rows of repeated keys and rows with a null in the key; one shuffle of the keys."""
    keys = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    bad = F.when(_all(columns, lambda c: c.isNotNull()), F.col("n") - 1).otherwise(F.col("n"))
    return _result(keys.agg(F.coalesce(F.sum(bad), F.lit(0)).alias("violations")), "primary_key", ",".join(columns), 1)


def orphans(child: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str]) -> DataFrame:
    """Child rows whose key has no null and no parent."""
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_columns)])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)])
    return child.where(_all(columns, lambda c: c.isNotNull())).join(keys, on, "left_anti")


def foreign_key(child: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str], name: str) -> DataFrame:
    return _result(orphans(child, parent, columns, parent_columns).agg(F.count(F.lit(1)).alias("violations")), "foreign_key", name, 2)


def check(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition is false; unknown passes."""
    return _counted(df, _checks([condition]))


def check_all(df: DataFrame, spec: TableSpec, parents: dict[str, DataFrame]) -> DataFrame:
    """All rules of a table: pass (1 for the primary key, 2 for the others), rule, name, violations."""
    found = [primary_key(df, list(spec.primary_key))] if spec.primary_key else []
    by_row = _nulls(list(spec.not_null)) + _checks(list(spec.checks))
    found += [_counted(df, by_row)] if by_row else []
    found += [unique(df, list(u)) for u in spec.unique]
    found += [foreign_key(df, parents[f.parent], list(f.columns), list(f.parent_columns), f"{','.join(f.columns)}->{f.parent}") for f in spec.foreign_keys]
    return reduce(DataFrame.unionByName, found)


def cascade_delete(child: DataFrame, deleted: DataFrame, column: str, parent_column: str) -> DataFrame:
    """The child rows that stay when rows of deleted parents go with them."""
    return child.join(deleted.select(F.col(parent_column).alias("_p")), F.col(column) == F.col("_p"), "left_anti")


def cascade_null(child: DataFrame, deleted: DataFrame, column: str, parent_column: str) -> DataFrame:
    """The child with the key nulled where its parent was deleted."""
    gone = deleted.select(F.col(parent_column).alias("_p")).distinct()
    joined = child.join(gone, F.col(column) == F.col("_p"), "left")
    return joined.withColumn(column, F.when(F.col("_p").isNull(), F.col(column))).drop("_p")
