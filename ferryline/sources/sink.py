"""Loads by target mode, deletes and target status, over Parquet folders."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MODES = ("recreate", "truncate", "append", "truncate_partition", "skip")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a local one where none is set and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or f'{tempfile.gettempdir()}/checkpoints').rstrip('/')}/ferryline/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: later jobs restart from the files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _cut[out] = path
    return out


_cut: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def is_cut(df: DataFrame) -> bool:
    return df in _cut


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Remove the files of cut tables that nothing reads any more, DataFrames not yet run included."""
    for df in tables:
        path = _cut.pop(df, None)
        if path:
            remove(df.sparkSession, path)


def resolve_mode(mode: str | None) -> str:
    """The mode given, else recreate."""
    if mode and mode not in MODES:
        raise ValueError(f"no target mode {mode}")
    return mode or "recreate"


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def load(df: DataFrame, path: str, mode: str | None = None, partition_by: list[str] | None = None, max_rows_per_file: int = 0) -> str:
    """Write df by mode and return the state of the load: COMPLETED or SKIPPED. Spark commits the job as a whole.

    recreate replaces table and columns; truncate replaces the rows and keeps the target's columns and types; append
    adds; truncate_partition replaces the partitions found in df only; skip writes nothing."""
    mode, spark = resolve_mode(mode), df.sparkSession
    if mode == "skip":
        return "SKIPPED"
    if mode == "truncate" and exists(spark, path):
        target = spark.read.parquet(path).schema
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target])
    writer = df.write.mode("append" if mode == "append" else "overwrite").option("maxRecordsPerFile", max_rows_per_file)
    if mode == "truncate_partition":
        if not partition_by:
            raise ValueError("truncate_partition needs partition columns")
        writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return "COMPLETED"


def load_jdbc(df: DataFrame, url: str, table: str, mode: str | None = None, batch_size: int = 50_000, isolation: str = "READ_COMMITTED", **options: str) -> str:
    """Write df to a database table by mode and return the state of the load: COMPLETED or SKIPPED.

    Each task writes its rows in batches of batch_size and commits them as one transaction. recreate replaces table and
    columns; truncate keeps the table's definition; append adds; skip writes nothing."""
    mode = resolve_mode(mode)
    if mode == "skip":
        return "SKIPPED"
    if mode == "truncate_partition":
        raise ValueError("a database table is loaded whole or appended to")
    how = {"batchsize": str(batch_size), "isolationLevel": isolation, "truncate": str(mode == "truncate").lower()} | options
    df.write.mode("append" if mode == "append" else "overwrite").format("jdbc").options(url=url, dbtable=table, **how).save()
    return "COMPLETED"


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which the condition is not true; unknown keeps the row."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def target_status(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """expected with `present`: whether the target has the table or partition."""
    have = found.select(*on).distinct().withColumn("_have", F.lit(True))
    return expected.join(have, on, "left").withColumn("present", F.coalesce("_have", F.lit(False))).drop("_have")
