"""Analytics over a run ledger: one row per unit of work (table, partition, chunk, phase) and run.

Columns used: job_id, run_id, table_name, partition_key, phase, state, rows_copied, rows_expected, attempt,
error_message, started_at, finished_at. A partition key may carry a chunk: `P1:chunk:3` or `chunk:3`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.operators.names import fresh_names
from ferryline.operators.scan import FIRST, LAST, SUM, scanned

CHUNK = r":?chunk:.*$"
#: Worst first.
WORST = ["FAILED", "RUNNING", "RETRYING", "PENDING"]
#: Parts in which the units of one table meet what holds for the table.
SALTS = 16


def strip_chunk(key: Column) -> Column:
    return F.regexp_replace(key, CHUNK, "")


def is_chunk(key: Column) -> Column:
    return F.coalesce(key.rlike(r"(^|:)chunk:"), F.lit(False))


def worst_state(count_of) -> Column:
    """State of a group: the worst active state present, COMPLETED if all are, else SKIPPED.

    count_of(state) is the number of the group's rows in that state."""
    out = F.when(count_of("FAILED") > 0, "FAILED")
    for s in WORST[1:]:
        out = out.when(count_of(s) > 0, s)
    return out.when(count_of("COMPLETED") == F.count(F.lit(1)), "COMPLETED").otherwise("SKIPPED")


def _states(state: str) -> Column:
    return F.count_if(F.col("state") == state)


def pending(ledger: DataFrame, run_id: str, phase: str) -> DataFrame:
    """Work left of a run's phase, in the order of job_id."""
    return ledger.where((F.col("run_id") == run_id) & (F.col("phase") == phase) & F.col("state").isin("PENDING", "RETRYING")).orderBy("job_id")


def current(events: DataFrame, key: str = "job_id", seq: str = "seq") -> DataFrame:
    """State and attempts of each job from an append-only log of transitions."""
    return events.groupBy(key).agg(F.max_by("state", seq).alias("state"), F.count_if(F.col("state") == "RUNNING").alias("attempts"))


def retry(ledger: DataFrame) -> DataFrame:
    """FAILED and RUNNING become RETRYING without their error; `retried` marks them."""
    again = F.col("state").isin("FAILED", "RUNNING")
    return ledger.withColumns({"retried": again, "error_message": F.when(~again, F.col("error_message")), "state": F.when(again, "RETRYING").otherwise(F.col("state"))})


def reset_tables(ledger: DataFrame) -> DataFrame:
    """If one chunk of a table in a run is RETRYING, all chunks of that table are, whatever partition they are of.

    The tables hit are one row each; they meet the units in SALTS parts, so a table of very many units is many tasks' work."""
    hit, salt = fresh_names(ledger, "hit", "salt")
    keys = ["run_id", "table_name", "phase"]
    chunk = is_chunk(F.col("partition_key"))
    other = {k: f"{hit}_{k}" for k in keys}
    hits = ledger.where((F.col("state") == "RETRYING") & chunk).select(*[F.col(k).alias(v) for k, v in other.items()]).distinct()
    hits = hits.withColumn(hit, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col(salt) == F.col(hit)
    for k, v in other.items():
        same = same & F.col(k).eqNullSafe(F.col(v))
    joined = ledger.withColumn(salt, F.pmod(F.xxhash64(*ledger.columns), F.lit(SALTS)).cast("int")).join(hits, same, "left")
    reset = F.col(hit).isNotNull() & chunk
    return joined.withColumns({"reset": reset, "state": F.when(reset, "RETRYING").otherwise(F.col("state"))}).select(*ledger.columns, "reset")


def completed_units(ledger: DataFrame, run_id: str) -> DataFrame:
    return ledger.where((F.col("run_id") == run_id) & (F.col("phase") == "data") & F.col("state").isin("COMPLETED", "SKIPPED")).select("job_id", "table_name", "partition_key", "rows_copied")


def incremental_skip(planned: DataFrame, done: DataFrame, incremental: list[str]) -> DataFrame:
    """planned units with `skip`: done before, for incremental tables only."""
    before = done.select("table_name", "partition_key").distinct().withColumn("_done", F.lit(True))
    on = (planned["table_name"] == before["table_name"]) & planned["partition_key"].eqNullSafe(before["partition_key"])
    joined = planned.join(before, on, "left").select(*[planned[c] for c in planned.columns], "_done")
    return joined.withColumn("skip", F.coalesce("_done", F.lit(False)) & F.col("table_name").isin(incremental)).drop("_done")


def fully_done(planned: DataFrame, done: DataFrame) -> DataFrame:
    """table_name, n_units, all_done: whether every planned unit was done before."""
    before = done.select("table_name", "partition_key").distinct().withColumn("_done", F.lit(True))
    units = planned.select("table_name", "partition_key").distinct()
    joined = units.join(before, (units["table_name"] == before["table_name"]) & units["partition_key"].eqNullSafe(before["partition_key"]), "left")
    return joined.groupBy(units["table_name"]).agg(F.count(F.lit(1)).alias("n_units"), F.bool_and(F.coalesce("_done", F.lit(False))).alias("all_done"))


def unit_key(table: Column, partition: Column, chunk: Column) -> Column:
    """table[:partition][:chunk:n]"""
    part = F.when(partition != "", partition)
    return F.concat_ws(":", table, part, F.when(chunk.isNotNull(), F.concat(F.lit("chunk:"), chunk.cast("string"))))


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def run_summary(ledger: DataFrame) -> DataFrame:
    """run_id, counts per state, total, first start, last finish (null while anything is active), rows of the data phase."""
    counts = {s.lower(): _states(s) for s in ("PENDING", "RUNNING", "COMPLETED", "FAILED", "RETRYING", "SKIPPED")}
    active = F.count_if(F.col("state").isin("PENDING", "RUNNING", "RETRYING"))
    return ledger.groupBy("run_id").agg(
        *[c.alias(n) for n, c in counts.items()], F.count(F.lit(1)).alias("total"), F.min("started_at").alias("started_at"),
        F.when(active == 0, F.max("finished_at")).alias("finished_at"), F.sum(F.when(F.col("phase") == "data", F.col("rows_copied")).otherwise(0)).alias("rows_copied"),
    )


def run_summary_chunked(ledger: DataFrame, by_partition: bool = False) -> DataFrame:
    """run_summary's counts where the chunks of a table and phase (and partition, if asked) count as one unit."""
    keys = ["run_id", "table_name", "phase"]
    chunk = is_chunk(F.col("partition_key"))
    whole = F.when(chunk, strip_chunk(F.col("partition_key")) if by_partition else F.lit("")).otherwise(F.concat_ws(":", "partition_key", F.col("job_id").cast("string")))
    units = ledger.groupBy(*keys, chunk.alias("chunked"), whole.alias("unit")).agg(worst_state(_states).alias("state"), F.sum("rows_copied").alias("rows_copied"))
    return units.groupBy("run_id").agg(*[_states(s).alias(s.lower()) for s in ("PENDING", "RUNNING", "COMPLETED", "FAILED", "RETRYING", "SKIPPED")], F.count(F.lit(1)).alias("total"))


def job_rollup(ledger: DataFrame) -> DataFrame:
    """Chunks rolled up to their partition: rows, worst state, first error, most attempts, first start, last finish."""
    error = F.min_by(F.when(F.col("error_message").isNotNull(), F.col("error_message")), F.when(F.col("error_message").isNotNull(), F.col("job_id")))
    copied = F.sum("rows_copied")
    return ledger.groupBy("run_id", "table_name", strip_chunk(F.col("partition_key")).alias("partition_key"), "phase").agg(
        F.count(F.lit(1)).alias("n_units"), worst_state(_states).alias("state"), copied.alias("rows_copied"), F.greatest(F.sum("rows_expected"), copied).alias("rows_expected"),
        error.alias("error_message"), F.max("attempt").alias("attempt"), F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"),
    )


def table_groups(ledger: DataFrame) -> DataFrame:
    """One row per table: phases, state, rows; the largest first, then by name."""
    some = lambda *s: F.count_if(F.col("state").isin(*s)) > 0
    state = (
        F.when(some("FAILED"), "FAILED").when(some("RUNNING"), "RUNNING").when(some("PENDING", "RETRYING"), "PENDING")
        .when(_states("SKIPPED") == F.count(F.lit(1)), "SKIPPED").otherwise("COMPLETED")
    )
    data = lambda c: F.sum(F.when(F.col("phase") == "data", F.col(c)).otherwise(0))
    return ledger.groupBy("table_name").agg(
        F.array_join(F.array_sort(F.collect_set("phase")), ",").alias("phases"), state.alias("state"), data("rows_expected").alias("rows_expected"), data("rows_copied").alias("rows_copied")
    ).orderBy(F.desc("rows_expected"), "table_name")


def copied_rows(ledger: DataFrame) -> DataFrame:
    return ledger.where((F.col("state") == "COMPLETED") & (F.col("phase") == "data")).groupBy("table_name").agg(F.sum("rows_copied").alias("rows_copied"))


def expected_rows(units: DataFrame, partition_rows: DataFrame, table_rows: DataFrame, n_chunks: str = "n_chunks") -> DataFrame:
    """units with rows_expected: the partition's rows, or else the table's, over the chunks (whole numbers)."""
    joined = units.join(partition_rows, ["table_name", "part"], "left").join(table_rows, "table_name", "left")
    rows = F.coalesce(F.nullif("part_rows", F.lit(0)), "table_rows", F.lit(0))
    return joined.select(*units.columns, F.floor(rows / F.greatest(F.col(n_chunks), F.lit(1))).cast("long").alias("rows_expected"))


def rollup_fallback(tables: DataFrame, parts: DataFrame, key: str, value: str) -> DataFrame:
    """A table's figure, or the sum over its parts where it is 0 or missing."""
    sums = parts.groupBy(key).agg(F.sum(value).alias("_sum"))
    return tables.join(sums, key, "left").select(key, F.coalesce(F.nullif(F.col(value), F.lit(0)), F.col("_sum"), F.lit(0)).cast("long").alias(value))


def percent_done(ledger: DataFrame) -> DataFrame:
    """run_id, percent of units COMPLETED or SKIPPED (rounded), percent of rows; above 100 shows as 99."""
    done = F.count_if(F.col("state").isin("COMPLETED", "SKIPPED"))
    rows = F.sum("rows_copied") * 100.0 / F.greatest(F.sum("rows_expected"), F.lit(1))
    return ledger.groupBy("run_id").agg(F.round(done * 100.0 / F.count(F.lit(1))).cast("long").alias("percent"), F.round(F.when(rows > 100, 99.0).otherwise(rows).cast("double"), 4).alias("row_percent"))


def interleave(units: DataFrame, bucket: str, seq: str) -> DataFrame:
    """units with round and bucket_start: the order (round, bucket_start) takes one unit of each bucket in turn.

    Units without seq come first in their bucket and have no bucket_start."""
    first, n = fresh_names(units, "first", "n")
    rows = scanned(units, [bucket], [seq], {n: (SUM, F.lit(1).cast("long")), first: (FIRST, F.col(seq))})
    return rows.select(*units.columns, (F.col(n) + 1).cast("int").alias("round"), F.coalesce(first, seq).alias("bucket_start"))


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by `order`."""
    newest = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*by).agg(newest).select("_row.*")


def failure_streaks(units: DataFrame, by: list[str], order: str, least: int = 5) -> DataFrame:
    """Runs of `least` or more failures in a row: by, first, last, n. Failures with equally many other units before them
    are one run."""
    (island,) = fresh_names(units, "island")
    failed = F.coalesce(F.col("state") == "FAILED", F.lit(False))
    rows = scanned(units.select(*by, order, "state"), by, [order], {island: (SUM, F.when(failed, 0).otherwise(1).cast("long"))})
    runs = rows.where(failed).groupBy(*by, island).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= least).drop(island)


def stalls(progress: DataFrame, by: list[str], ts: str, minutes: int = 30) -> DataFrame:
    """Events that came more than `minutes` after the one before: by, last_seen, ts."""
    rows = scanned(progress.select(*by, ts), by, [ts], {"last_seen": (LAST, F.col(ts))})
    return rows.select(*by, "last_seen", ts).where(F.col(ts) > F.col("last_seen") + F.expr(f"interval {minutes} minutes"))


def assign_sequence(numbered: DataFrame, row_no: str, last: int, increment: int = 1, into: str = "seq") -> DataFrame:
    """Next values of a sequence for rows numbered from 0."""
    return numbered.withColumn(into, (F.lit(last) + F.lit(increment) * (F.col(row_no) + 1)).cast("long"))
