"""Changes merged into a table by key: as a whole, or partition by partition in a folder of Parquet files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.operators.names import fresh_names
from ferryline.sources.sink import cut, drop, remove


def _once(changes: DataFrame, keys: list[str], row: str) -> DataFrame:
    """keys and the one change of each key as the struct `row`; a second change of a key is an error."""
    found = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{row}_n"), F.first(F.struct(*changes.columns)).alias(row))
    message = F.concat(F.lit("several changes of the key "), F.to_json(F.struct(*keys)))
    return found.select(*keys, F.when(F.col(f"{row}_n") > 1, F.raise_error(message)).otherwise(F.col(row)).alias(row))


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of changes put in by key: a change replaces all columns of its row or is a new row.

    Two changes of one key are an error when the rows are read; rows of the target that share a key all become the change.
    A key with a null matches nothing, so such changes are new rows."""
    (row,) = fresh_names([target, changes], "row")
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    changed = _once(changes.where(whole), keys, row)
    joined = target.join(changed, keys, "full")
    merged = joined.select(*[c if c in keys else F.when(F.col(row).isNotNull(), F.col(row)[c]).otherwise(F.col(c)).alias(c) for c in target.columns])
    return merged.unionByName(changes.where(~whole).select(*target.columns))


def merge_partitions(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], part: str) -> list[str]:
    """Merge changes into the Parquet folder `path` partitioned by `part`, and return the partitions that were rewritten.

    Only partitions that a change goes to, or that hold a row of a changed key, are read whole and written again; files of
    all others stay as they are. A row whose change names another partition moves there. A partition left empty goes. Each
    partition is replaced as a whole; a merge that did not come to its end can be run again."""
    (folder,) = fresh_names([changes], "folder")
    asked = cut(changes, "changes")
    target = spark.read.parquet(path)
    kind = dict(target.dtypes)[part]
    held = target.select(*keys, part, F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias(folder)).join(asked.select(*keys), keys, "left_semi").select(part, folder).distinct().collect()  # partitions
    goes = [r[0] for r in asked.select(F.col(part).cast(kind)).distinct().collect()]
    touched = list(dict.fromkeys([r[0] for r in held] + goes))
    own = target.where(F.col(part).isin([t for t in touched if t is not None]) | (F.col(part).isNull() if None in touched else F.lit(False)))
    merged = cut(upsert(own, asked.withColumn(part, F.col(part).cast(kind)), keys), "merged")
    left = {r[0] for r in merged.select(part).distinct().collect()}
    merged.hint("rebalance", F.col(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    for r in held:
        if r[0] not in left:
            remove(spark, r[1])
    drop(asked, merged)
    return sorted(map(str, touched))
