"""Progress events: throttle, chunk progress, rollups and windows.

An event has table_name, partition_key, ts, state, rows, speed, percent and timings. Each stateful operator has a batch
twin over a finished log; both give the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.operators.ledger import strip_chunk
from ferryline.operators.walk import walked
from ferryline.streaming.ordered import EVENT, throttle_walk


def classify(message: Column, fields: Column) -> Column:
    """State of a log record: by its message, and STATS where it carries timings."""
    m = F.lower(message)
    return (
        F.when(m.contains("fail") | m.contains("error"), "FAILED").when(fields.isNotNull() & fields.contains("duration"), "STATS")
        .when(m.contains("complete") | m.contains("purchase"), "COMPLETED").otherwise("RUNNING")
    )


def duration_ms(text: Column) -> Column:
    """Milliseconds of durations such as 1h2m3.5s, 250ms, 90s."""
    part = lambda unit: F.coalesce(F.regexp_extract(text, rf"([0-9.]+){unit}(?![a-z])", 1).try_cast("double"), F.lit(0.0))
    return F.round(part("h") * 3_600_000 + part("m") * 60_000 + part("s") * 1000 + part("ms")).cast("long")


def throttled(events: DataFrame, seconds: float = 1.0) -> DataFrame:
    """At most one event per unit and interval, counted from the last one that passed; terminal events always pass.

    The rule is greedy, so the events of a unit are walked in order of time; events without a time are left out."""
    rows = events.select("table_name", "partition_key", F.col("ts").cast("timestamp").alias("ts"), "state", "rows", "event_id").where("ts is not null")

    def walk(last, part: pd.DataFrame):
        last, keep = throttle_walk(last, [(t.value // 1000, None, s, None) for t, s in zip(part["ts"], part["state"], strict=True)], round(seconds * 1_000_000))
        return last, part[keep]

    return walked(rows, ["table_name", "partition_key"], ["ts", "event_id"], walk, EVENT)


def latest_units(events: DataFrame) -> DataFrame:
    """The newest figures of each unit, and when they came. Works on streams; its state is a row for each unit."""
    newest = F.struct("ts", "event_id")
    figures = [c for c in ("rows", "speed", "percent", "state") if c in events.columns]
    return events.groupBy("table_name", "partition_key").agg(*[F.max_by(c, newest).alias(c) for c in figures], F.max(newest).alias("at"))


def progress_of(units: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """latest_units() summed per table and partition, with latest speed, counts by state, and state.

    planned (table_name, part, n_chunks) says how many chunks there will be; without it the chunks seen are all."""
    of = lambda s: F.count_if(F.col("state") == s)
    sums = units.groupBy("table_name", strip_chunk(F.col("partition_key")).alias("part")).agg(
        F.sum("rows").alias("rows"), F.max_by("speed", "at").alias("speed"), F.count(F.lit(1)).alias("n_chunks"),
        of("RUNNING").alias("n_running"), of("COMPLETED").alias("n_done"), of("FAILED").alias("n_failed"),
    )
    total = F.col("n_chunks")
    if planned is not None:
        sums = sums.join(planned.select("table_name", "part", F.col("n_chunks").alias("_planned")), ["table_name", "part"], "left")
        total = F.greatest(F.coalesce("_planned", F.lit(0)), total)
    state = F.when(F.col("n_failed") > 0, "FAILED").when(F.col("n_done") >= total, "COMPLETED").otherwise("RUNNING")
    return sums.withColumn("state", state).select("table_name", "part", "rows", "speed", "n_chunks", "n_running", "n_done", "n_failed", "state")


def chunk_progress(events: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """progress_of() over a finished log."""
    return progress_of(latest_units(events), planned)


def rollup_of(units: DataFrame) -> DataFrame:
    """latest_units() per table: rows, speed, mean percent of the running ones."""
    running = F.when(F.col("state") == "RUNNING", F.col("percent"))
    return units.groupBy("table_name").agg(F.sum("rows").alias("rows"), F.sum("speed").alias("speed"), F.round(F.avg(running), 4).alias("percent"))


def stats_totals(events: DataFrame, by: list[str], rounding: str = "truncate") -> DataFrame:
    """Rows, duration, read and write time, batches; shares of the duration, rows per second, rows per batch. Works on streams."""
    whole = (lambda c: F.floor(c)) if rounding == "truncate" else (lambda c: F.round(c))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    sums = events.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("rows", "duration_ms", "read_time_ms", "write_time_ms", "batches", "acquire_wait_ms")])
    d = F.col("duration_ms")
    return sums.withColumns({
        "read_percent": safe(F.col("read_time_ms") * 100.0, d).cast("double"), "write_percent": safe(F.col("write_time_ms") * 100.0, d).cast("double"),
        "rows_per_s": whole(safe(F.col("rows") * 1000.0, d)).cast("long"), "avg_batch": whole(safe(F.col("rows") * 1.0, F.col("batches"))).cast("long"),
    })


def bottleneck(stats: DataFrame) -> DataFrame:
    """read if more than half of the time goes there, else write; contention if waiting is over a tenth of the duration."""
    return stats.withColumns({"bottleneck": F.when(F.col("read_percent") > F.col("write_percent"), "read").otherwise("write"), "contention": F.col("acquire_wait_ms") * 10 > F.col("duration_ms")})


def live_rollup(events: DataFrame) -> DataFrame:
    """rollup_of() over a finished log."""
    return rollup_of(latest_units(events))


def windowed(events: DataFrame, window: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    """Event counts and sums per time window and key; with a watermark late rows go and state stays bounded."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    return rows.groupBy(F.window("ts", window), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
