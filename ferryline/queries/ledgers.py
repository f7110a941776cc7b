"""Run-ledger analytics over the ledger that the event table stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.operators import ledger as L
from ferryline.queries.registry import LEDGER_SQL, PROGRESS_SQL, ledger, progress, query, table
from ferryline.streaming import progress as P

_RUN, _BEFORE = "run-20240115", "run-20240114"
_L = f"with l as ({LEDGER_SQL})"
_STRIP = "regexp_replace(partition_key, ':?chunk:.*$', '')"
_STATES = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "RETRYING", "SKIPPED")
_COUNT = ", ".join(f"count(*) filter (state = '{s}') as {s.lower()}" for s in _STATES)
_WORST = """case when count(*) filter (state = 'FAILED') > 0 then 'FAILED' when count(*) filter (state = 'RUNNING') > 0 then 'RUNNING' when count(*) filter (state = 'RETRYING') > 0 then 'RETRYING'
  when count(*) filter (state = 'PENDING') > 0 then 'PENDING' when count(*) filter (state = 'COMPLETED') = count(*) then 'COMPLETED' else 'SKIPPED' end"""


@query("copied_rows", f"{_L} select table_name, sum(rows_copied)::bigint as rows_copied from l where state = 'COMPLETED' and phase = 'data' group by 1")
def copied_rows(spark: SparkSession, d: str) -> DataFrame:
    return L.copied_rows(ledger(spark, d))


@query("run_summary", f"""{_L} select run_id, {_COUNT}, count(*) as total, min(started_at) as started_at,
  case when count(*) filter (state in ('PENDING', 'RUNNING', 'RETRYING')) = 0 then max(finished_at) end as finished_at, sum(case when phase = 'data' then rows_copied else 0 end)::bigint as rows_copied from l group by 1""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.run_summary(ledger(spark, d))


_UNITS = f"""u as (select run_id, table_name, phase, contains(partition_key, ':chunk:') as chunked, case when contains(partition_key, ':chunk:') then '' else partition_key || ':' || job_id end as unit, {_WORST} as state
  from l group by 1, 2, 3, 4, 5)"""


@query("run_summary_chunked", f"{_L}, {_UNITS} select run_id, {_COUNT}, count(*) as total from u group by 1")
def run_summary_chunked(spark: SparkSession, d: str) -> DataFrame:
    return L.run_summary_chunked(ledger(spark, d))


@query("job_rollup", f"""{_L} select run_id, table_name, {_STRIP} as partition_key, phase, count(*) as n_units, {_WORST} as state, sum(rows_copied)::bigint as rows_copied,
  greatest(sum(rows_expected), sum(rows_copied))::bigint as rows_expected, arg_min(error_message, job_id) filter (error_message is not null) as error_message, max(attempt) as attempt,
  min(started_at) as started_at, max(finished_at) as finished_at from l group by 1, 2, 3, 4""")
def job_rollup(spark: SparkSession, d: str) -> DataFrame:
    return L.job_rollup(ledger(spark, d))


@query("strip_chunk", f"{_L} select job_id, {_STRIP} as part, contains(partition_key, ':chunk:') as chunked from l")
def strip_chunk(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).select("job_id", L.strip_chunk(F.col("partition_key")).alias("part"), L.is_chunk(F.col("partition_key")).alias("chunked"))


@query("table_groups", f"""{_L} select table_name, string_agg(distinct phase, ',' order by phase) as phases,
  case when count(*) filter (state = 'FAILED') > 0 then 'FAILED' when count(*) filter (state = 'RUNNING') > 0 then 'RUNNING' when count(*) filter (state in ('PENDING', 'RETRYING')) > 0 then 'PENDING'
    when count(*) filter (state = 'SKIPPED') = count(*) then 'SKIPPED' else 'COMPLETED' end as state,
  sum(case when phase = 'data' then rows_expected else 0 end)::bigint as rows_expected, sum(case when phase = 'data' then rows_copied else 0 end)::bigint as rows_copied from l group by 1""")
def table_groups(spark: SparkSession, d: str) -> DataFrame:
    return L.table_groups(ledger(spark, d))


_SUMS = "sum(rows)::bigint as rows, sum(duration_ms)::bigint as duration_ms, sum(read_time_ms)::bigint as read_time_ms, sum(write_time_ms)::bigint as write_time_ms, sum(batches)::bigint as batches, sum(acquire_wait_ms)::bigint as acquire_wait_ms"
_STATS = f"""s as (select table_name, {_SUMS} from p group by 1)
select *, case when duration_ms > 0 then read_time_ms * 100.0::double / duration_ms else 0 end as read_percent, case when duration_ms > 0 then write_time_ms * 100.0::double / duration_ms else 0 end as write_percent,
  cast(case when duration_ms > 0 then floor(rows * 1000.0::double / duration_ms) else 0 end as bigint) as rows_per_s, cast(case when batches > 0 then floor(rows * 1.0::double / batches) else 0 end as bigint) as avg_batch from s"""


@query("pipeline_rollup", f"with p as ({PROGRESS_SQL}), {_STATS}")
def pipeline_rollup(spark: SparkSession, d: str) -> DataFrame:
    return P.stats_totals(progress(spark, d), ["table_name"])


@query("bottleneck", f"select table_name, case when read_percent > write_percent then 'read' else 'write' end as bottleneck, acquire_wait_ms * 10 > duration_ms as contention from (with p as ({PROGRESS_SQL}), {_STATS})")
def bottleneck(spark: SparkSession, d: str) -> DataFrame:
    return P.bottleneck(pipeline_rollup(spark, d)).select("table_name", "bottleneck", "contention")


@query("progress_percent", f"""{_L} select run_id, cast(round(count(*) filter (state in ('COMPLETED', 'SKIPPED')) * 100.0 / count(*)) as bigint) as percent,
  round(cast(case when sum(rows_copied) * 100.0 / greatest(sum(rows_expected), 1) > 100 then 99.0 else sum(rows_copied) * 100.0 / greatest(sum(rows_expected), 1) end as double), 4) as row_percent from l group by 1""")
def progress_percent(spark: SparkSession, d: str) -> DataFrame:
    return L.percent_done(ledger(spark, d))


@query("interleave", f"{_L} select job_id, table_name, cast(row_number() over (partition by table_name order by job_id) as integer) as round, min(job_id) over (partition by table_name) as bucket_start from l")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    return L.interleave(ledger(spark, d).select("job_id", "table_name"), "table_name", "job_id")


_HIT = "max(case when state = 'RETRYING' and contains(partition_key, ':chunk:') then 1 else 0 end) over (partition by run_id, table_name, phase) = 1 and contains(partition_key, ':chunk:')"


@query("resume_reset", f"{_L} select job_id, {_HIT} as reset, case when {_HIT} then 'RETRYING' else state end as state from l")
def resume_reset(spark: SparkSession, d: str) -> DataFrame:
    return L.reset_tables(ledger(spark, d)).select("job_id", "reset", "state")


@query("latest_per_key", f"{_L} select table_name, partition_key, arg_max(job_id, (started_at, job_id)) as job_id, arg_max(state, (started_at, job_id)) as state from l group by 1, 2")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger(spark, d).select("table_name", "partition_key", "job_id", "state", "started_at")
    return L.latest(rows, ["table_name", "partition_key"], ["started_at", "job_id"]).select("table_name", "partition_key", "job_id", "state")


@query("failure_streaks", f"""{_L}, f as (select *, case when state in ('FAILED', 'RUNNING', 'RETRYING') then 'FAILED' else state end as s from l),
r as (select table_name, job_id, s, row_number() over (partition by table_name order by job_id) - row_number() over (partition by table_name, s order by job_id) as g from f)
select table_name, min(job_id) as first, max(job_id) as last, count(*) as n from r where s = 'FAILED' group by table_name, g having count(*) >= 5""")
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Here a unit that is not done counts as failed, as failures alone are too rare for streaks."""
    s = F.when(F.col("state").isin("FAILED", "RUNNING", "RETRYING"), "FAILED").otherwise(F.col("state"))
    return L.failure_streaks(ledger(spark, d).withColumn("state", s), ["table_name"], "job_id")


@query("stalls", "select user_id, last_seen, ts from (select user_id, ts, lag(ts) over (partition by user_id order by ts) as last_seen from events) where ts > last_seen + interval 30 minute")
def stalls(spark: SparkSession, d: str) -> DataFrame:
    return L.stalls(table(spark, d, "events").select("user_id", "ts"), ["user_id"], "ts", 30)


@query("ledger_pending", f"{_L} select job_id, table_name, partition_key, state from l where run_id = '{_RUN}' and phase = 'data' and state in ('PENDING', 'RETRYING')")
def ledger_pending(spark: SparkSession, d: str) -> DataFrame:
    return L.pending(ledger(spark, d), _RUN, "data").select("job_id", "table_name", "partition_key", "state")


@query("ledger_current", f"{_L} select table_name || ':' || partition_key as unit, arg_max(state, (started_at, job_id)) as state, count(*) filter (state = 'RUNNING') as attempts from l group by 1")
def ledger_current(spark: SparkSession, d: str) -> DataFrame:
    log = ledger(spark, d).select(F.concat_ws(":", "table_name", "partition_key").alias("unit"), "state", F.struct("started_at", "job_id").alias("seq"))
    return L.current(log, "unit", "seq")


@query("ledger_retry", f"{_L} select job_id, state in ('FAILED', 'RUNNING') as retried, case when state not in ('FAILED', 'RUNNING') then error_message end as error_message, case when state in ('FAILED', 'RUNNING') then 'RETRYING' else state end as state from l")
def ledger_retry(spark: SparkSession, d: str) -> DataFrame:
    return L.retry(ledger(spark, d)).select("job_id", "retried", "error_message", "state")


@query("ledger_completed", f"{_L} select job_id, table_name, partition_key, rows_copied from l where run_id = '{_RUN}' and phase = 'data' and state in ('COMPLETED', 'SKIPPED')")
def ledger_completed(spark: SparkSession, d: str) -> DataFrame:
    return L.completed_units(ledger(spark, d), _RUN)


_DONE = f"b as (select distinct table_name, partition_key from l where run_id = '{_BEFORE}' and phase = 'data' and state in ('COMPLETED', 'SKIPPED'))"


@query("incremental_skip", f"{_L}, {_DONE} select job_id, l.table_name, l.partition_key, b.table_name is not null and l.table_name in ('T01', 'T02', 'T03') as skip from l left join b on l.table_name = b.table_name and l.partition_key = b.partition_key where run_id = '{_RUN}'")
def incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger(spark, d)
    planned = rows.where(F.col("run_id") == _RUN).select("job_id", "table_name", "partition_key")
    return L.incremental_skip(planned, L.completed_units(rows, _BEFORE), ["T01", "T02", "T03"])


@query("ledger_fully_done", f"{_L}, {_DONE}, u as (select distinct table_name, partition_key from l where run_id = '{_RUN}') select u.table_name, count(*) as n_units, bool_and(b.table_name is not null) as all_done from u left join b on u.table_name = b.table_name and u.partition_key = b.partition_key group by 1")
def ledger_fully_done(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger(spark, d)
    return L.fully_done(rows.where(F.col("run_id") == _RUN), L.completed_units(rows, _BEFORE))


@query("ledger_keys", f"{_L} select job_id, table_name || case when job_id % 4 = 0 then '' else ':' || {_STRIP} end || case when job_id % 3 = 0 then '' else ':chunk:' || job_id % 5 end as unit from l")
def ledger_keys(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("job_id") % 4 == 0, "").otherwise(L.strip_chunk(F.col("partition_key")))
    chunk = F.when(F.col("job_id") % 3 != 0, F.col("job_id") % 5)
    return ledger(spark, d).select("job_id", L.unit_key(F.col("table_name"), part, chunk).alias("unit"))


@query("ledger_fingerprint", f"""{_L} select job_id, sha256('{{"run_id":"' || run_id || '","table_name":"' || table_name || '","partition_key":"' || partition_key || '","phase":"' || phase || '"}}') as fingerprint from l""")
def ledger_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).select("job_id", L.fingerprint(["run_id", "table_name", "partition_key", "phase"]).alias("fingerprint"))


@query("ledger_delete_run", f"{_L} select job_id, run_id from l where run_id <> '{_RUN}'")
def ledger_delete_run(spark: SparkSession, d: str) -> DataFrame:
    from ferryline.sources.sink import delete_where

    return delete_where(ledger(spark, d), F.col("run_id") == _RUN).select("job_id", "run_id")
