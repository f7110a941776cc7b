"""The registry of queries and small helpers that all query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, the SQL for the same rows."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Source and target of the reconcile queries: the target lacks the keys divisible by 97.
TARGET = "o_orderkey % 97 <> 0"

LEDGER_SQL = """
select event_id as job_id, 'run-' || strftime(ts, '%Y%m%d') as run_id,
  'T' || lpad(cast(user_id % 20 as varchar), 2, '0') as table_name,
  'P' || cast(extract(hour from ts) // 6 as varchar)
      || case when event_id % 3 = 0 then '' else ':chunk:' || cast(event_id % 5 as varchar) end as partition_key,
  case event_id % 10 when 0 then 'ddl' when 1 then 'constraints' when 2 then 'validate' else 'data' end as phase,
  case event_type when 'signup' then 'PENDING' when 'view' then 'RUNNING' when 'click' then 'COMPLETED' when 'purchase' then 'SKIPPED'
       else case when event_id % 7 = 0 then 'RETRYING' else 'FAILED' end end as state,
  cast(round(value * 100) as bigint) as rows_copied, cast(round(value * 100) as bigint) + event_id % 3 as rows_expected,
  event_id % 4 as attempt, case when event_type = 'error' then 'E' || cast(event_id % 11 as varchar) end as error_message, ts as started_at,
  case when event_type in ('click', 'purchase') or (event_type = 'error' and event_id % 7 <> 0) then ts + interval 1 minute end as finished_at
from events"""

PROGRESS_SQL = f"""
select job_id as event_id, table_name, partition_key, started_at as ts, state, rows_copied as rows, rows_copied % 1000 as speed,
  cast(least(rows_copied * 100.0 / greatest(rows_expected, 1), 100) as double) as percent, 1000 + job_id % 500 as duration_ms,
  ((1000 + job_id % 500) * (job_id % 10)) // 10 as read_time_ms,
  (1000 + job_id % 500) - ((1000 + job_id % 500) * (job_id % 10)) // 10 as write_time_ms, 1 + job_id % 5 as batches, job_id % 200 as acquire_wait_ms
from ({LEDGER_SQL})"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run ledger that the event table stands for."""
    return as_ledger(table(spark, sf_dir, "events"))


def as_ledger(e: DataFrame) -> DataFrame:
    state = (
        F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "view", "RUNNING").when(F.col("event_type") == "click", "COMPLETED")
        .when(F.col("event_type") == "purchase", "SKIPPED").when(F.col("event_id") % 7 == 0, "RETRYING").otherwise("FAILED")
    )
    phase = F.when(F.col("event_id") % 10 == 0, "ddl").when(F.col("event_id") % 10 == 1, "constraints").when(F.col("event_id") % 10 == 2, "validate").otherwise("data")
    chunk = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(":chunk:"), (F.col("event_id") % 5).cast("string")))
    copied = F.round(F.col("value") * 100).cast("long")
    return e.select(
        F.col("event_id").alias("job_id"), F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        F.concat(F.lit("T"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("table_name"),
        F.concat(F.lit("P"), F.floor(F.hour("ts") / 6).cast("string"), chunk).alias("partition_key"), phase.alias("phase"), state.alias("state"),
        copied.alias("rows_copied"), (copied + F.col("event_id") % 3).alias("rows_expected"), (F.col("event_id") % 4).alias("attempt"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), (F.col("event_id") % 11).cast("string"))).alias("error_message"), F.col("ts").alias("started_at"),
        F.when(state.isin("COMPLETED", "FAILED", "SKIPPED"), F.col("ts") + F.expr("interval 1 minute")).alias("finished_at"),
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress events on the ledger."""
    return as_progress(table(spark, sf_dir, "events"))


def as_progress(events: DataFrame) -> DataFrame:
    d = F.lit(1000).cast("long") + F.col("job_id") % 500
    read = F.floor(d * (F.col("job_id") % 10) / 10).cast("long")
    percent = F.least(F.col("rows_copied") * 100.0 / F.greatest("rows_expected", F.lit(1)), F.lit(100)).cast("double")
    return as_ledger(events).select(
        F.col("job_id").alias("event_id"), "table_name", "partition_key", F.col("started_at").alias("ts"), "state", F.col("rows_copied").alias("rows"),
        (F.col("rows_copied") % 1000).alias("speed"), percent.alias("percent"), d.alias("duration_ms"), read.alias("read_time_ms"), (d - read).alias("write_time_ms"),
        (1 + F.col("job_id") % 5).alias("batches"), (F.col("job_id") % 200).alias("acquire_wait_ms"),
    )
