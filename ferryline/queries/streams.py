"""Progress-stream operators: batch twins, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.queries.registry import PROGRESS_SQL, as_progress, progress, query, table
from ferryline.sources.sink import scratch
from ferryline.streaming import ordered, view
from ferryline.streaming import progress as P

_P = f"with p as ({PROGRESS_SQL})"


_THROTTLED = f"""
with recursive p as ({PROGRESS_SQL}), s as (select *, row_number() over (partition by table_name, partition_key order by ts, event_id) as i from p),
w as (select table_name, partition_key, i, event_id, state, rows, ts, true as ok, ts as last from s where i = 1
  union all select table_name, partition_key, i, event_id, state, rows, ts, ok, case when ok then ts else last end
  from (select s.*, w.last, s.state in ('FAILED', 'STATS', 'COMPLETED') or epoch(s.ts) - epoch(w.last) >= 21600 as ok
        from w join s on s.table_name = w.table_name and s.partition_key = w.partition_key and s.i = w.i + 1))
select event_id, table_name, partition_key, state, rows from w where ok"""


@query("stream_throttle", _THROTTLED)
def stream_throttle(spark: SparkSession, d: str) -> DataFrame:
    """One event per unit and six hours, as the log's events are hours apart."""
    return P.throttled(progress(spark, d), 6 * 3600.0).select("event_id", "table_name", "partition_key", "state", "rows")


_PROGRESS = f"""{_P},
c as (select table_name, partition_key, arg_max(rows, (ts, event_id)) as rows, arg_max(speed, (ts, event_id)) as speed, arg_max(state, (ts, event_id)) as state, max((ts, event_id)) as newest from p group by 1, 2),
s as (select table_name, regexp_replace(partition_key, ':?chunk:.*$', '') as part, sum(rows)::bigint as rows, arg_max(speed, newest) as speed, count(*) as n_chunks,
  count(*) filter (state = 'RUNNING') as n_running, count(*) filter (state = 'COMPLETED') as n_done, count(*) filter (state = 'FAILED') as n_failed from c group by 1, 2)
select *, case when n_failed > 0 then 'FAILED' when n_done >= n_chunks then 'COMPLETED' else 'RUNNING' end as state from s"""


@query("stream_chunk_progress", _PROGRESS)
def stream_chunk_progress(spark: SparkSession, d: str) -> DataFrame:
    return P.chunk_progress(progress(spark, d))


@query("stream_classify", """
select event_id, case when contains(event_type, 'error') then 'FAILED' when event_id % 6 = 0 then 'STATS' when contains(event_type, 'purchase') then 'COMPLETED' else 'RUNNING' end as state,
  cast(event_id % 3 * 3600000 + event_id % 60 * 60000 + event_id % 50 * 1000 as bigint) as ms from events""")
def stream_classify(spark: SparkSession, d: str) -> DataFrame:
    props = F.when(F.col("event_id") % 6 == 0, F.lit('{"duration": 5}')).otherwise("{}")
    text = F.format_string("%dh%dm%ds", F.col("event_id") % 3, F.col("event_id") % 60, F.col("event_id") % 50)
    return table(spark, d, "events").select("event_id", P.classify(F.col("event_type"), props).alias("state"), P.duration_ms(text).alias("ms"))


_ROLLUP = f"""{_P},
u as (select table_name, partition_key, arg_max(rows, (ts, event_id)) as rows, arg_max(speed, (ts, event_id)) as speed, arg_max(percent, (ts, event_id)) as percent, arg_max(state, (ts, event_id)) as state from p group by 1, 2)
select table_name, sum(rows)::bigint as rows, sum(speed)::bigint as speed, round(avg(case when state = 'RUNNING' then percent end), 4) as percent from u group by 1"""


@query("live_rollup", _ROLLUP)
def live_rollup(spark: SparkSession, d: str) -> DataFrame:
    return P.live_rollup(progress(spark, d))


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream; the reader wants a folder, so the file is picked by its name."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet*").parquet(d) if table(spark, d, name).inputFiles()[0].endswith(f"/{name}.parquet") else spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet")


def _run(query) -> None:
    query.awaitTermination()


def _events(spark: SparkSession, d: str) -> DataFrame:
    return as_progress(_stream(spark, d, "events"))


@query("stream_chunk_progress_run", _PROGRESS)
def stream_chunk_progress_run(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream with the newest figures of each chunk as its state, run to its end."""
    path = scratch(spark, "progress")
    _run(view.kept_table(P.latest_units(_events(spark, d)), P.progress_of, path))
    return view.kept(spark, path)


def _appended(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """What a stream with keyed state appends until its end. Its state store is RocksDB; the session's setting stays."""
    path, setting = scratch(spark, name), "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _run(rows.writeStream.outputMode("append").format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    finally:
        spark.conf.set(setting, old)
    return spark.read.schema(rows.schema).parquet(f"{path}/table")


#: Events of the last hour wait for a later watermark.
_PASSED = "(select max(ts) - interval 1 hour from p)"


@query("stream_throttle_run", f"{_THROTTLED} and ts < {_PASSED}")
def stream_throttle_run(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream in whatever order its events come, up to its watermark."""
    rows = ordered.throttle_stream(_events(spark, d), 6 * 3600.0, watermark="1 hour")
    return _appended(spark, rows, "throttle").select("event_id", "table_name", "partition_key", "state", "rows")


@query("stall_stream_run", f"""{_P}, s as (select table_name, partition_key, ts, lead(ts) over (partition by table_name, partition_key order by ts) as later, {_PASSED} as passed from p)
select table_name, partition_key, ts as last_seen from s where ts < passed and epoch(least(later, passed)) - epoch(ts) > 86400""")
def stall_stream_run(spark: SparkSession, d: str) -> DataFrame:
    """Units without an event for more than a day, those that are silent to the end among them."""
    rows = ordered.stall_stream(_events(spark, d), 24 * 60, watermark="1 hour")
    return _appended(spark, rows, "stall").select("table_name", "partition_key", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query("live_rollup_run", _ROLLUP)
def live_rollup_run(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "rollup")
    _run(view.kept_table(P.latest_units(_events(spark, d)), P.rollup_of, path))
    return view.kept(spark, path)


_WINDOWS = "select cast(date_trunc('day', ts) as timestamp) as day, event_type, count(*) as n, sum(cast(value as decimal(18, 2))) as total from events group by 1, 2"


def _days(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.col("total").cast("decimal(38,2)").alias("total"))


@query("stream_windowed", _WINDOWS)
def stream_windowed(spark: SparkSession, d: str) -> DataFrame:
    """Run as a stream to its end, in update of a complete table."""
    path = scratch(spark, "windowed")
    _run(view.kept_table(P.windowed(_stream(spark, d, "events"), "1 day", ["event_type"]), _days, path))
    return view.kept(spark, path)


@query("stream_windowed_closed", f"with w as ({_WINDOWS}) select * from w where day + interval 1 day <= (select max(ts) - interval 2 hour from events)")
def stream_windowed_closed(spark: SparkSession, d: str) -> DataFrame:
    """Only windows that the watermark has closed are appended, each once; their state goes."""
    path = scratch(spark, "closed")
    rows = _days(P.windowed(_stream(spark, d, "events"), "1 day", ["event_type"], watermark="2 hours"))
    _run(rows.writeStream.outputMode("append").format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    return spark.read.schema(rows.schema).parquet(f"{path}/table")


@query("mv_incremental", "select user_id, cast(date_trunc('day', ts) as date) as day, count(*) as n, sum(cast(value as decimal(18, 2)))::decimal(38, 2) as value from events group by 1, 2")
def mv_incremental(spark: SparkSession, d: str) -> DataFrame:
    path, keys = scratch(spark, "view"), ["user_id", "day"]
    rows = _stream(spark, d, "events").withColumn("day", F.to_date("ts"))
    view.refresh_view(rows, f"{path}/view", f"{path}/state", keys, ["value"]).awaitTermination()
    return view.view(spark, f"{path}/view", keys, ["value"])
