"""Streams give the rows of their batch twins, however the input is split."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ferryline.queries.registry import progress
from ferryline.streaming import ordered, view
from ferryline.streaming import progress as P


@pytest.fixture(scope="module")
def events(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    rows = progress(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    for a, b in ((1, 12), (12, 20), (20, 32)):  # files in order of time
        rows.where((F.dayofmonth("ts") >= a) & (F.dayofmonth("ts") < b)).coalesce(1).write.mode("append").parquet(path)
    return path


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_throttle_stream_equals_batch(spark, events):
    batch = spark.read.parquet(events)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(events)
    key = lambda df: sorted(r["event_id"] for r in df.collect())
    end = batch.agg(F.max("ts") - F.expr("interval 1 hour")).first()[0]
    want = key(P.throttled(batch, 6 * 3600.0).where(F.col("ts") < F.lit(end)))
    assert 0 < len(want) < batch.count()
    assert key(_run(ordered.throttle_stream(stream, 6 * 3600.0, "1 hour"), "throttled")) == want


@pytest.mark.parametrize("batch", ["4", "10000"])
def test_streams_do_not_hang_on_order_or_chunks(spark, tmp_path, batch):
    """Shuffled rows in files that overlap in time, and chunks of four rows: what a walk in order of time gives."""
    import random

    r, t = random.Random(9), dt.datetime(2024, 1, 1)
    rows = [("T" if i % 3 else f"U{i % 5}", "P", t + dt.timedelta(seconds=3 * i), r.choice(["RUNNING"] * 5 + ["FAILED"]), i, i) for i in range(200) if not 90 < i < 140]
    rows.append(("end", "P", t + dt.timedelta(days=1), "RUNNING", 0, 1000))
    by_time = sorted(rows[:-1], key=lambda x: x[2] + dt.timedelta(seconds=r.randrange(60)))
    for part in (by_time[:60], by_time[60:110], by_time[110:], rows[-1:]):
        r.shuffle(part)
        spark.createDataFrame(part, ordered.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    passed, seen, quiet = {}, {}, []
    for table, _, ts, state, _, i in rows[:-1]:
        if state == "FAILED" or table not in passed or ts - passed[table][-1][0] >= dt.timedelta(seconds=10):
            passed.setdefault(table, []).append((ts, i))
        if table in seen and ts - seen[table] > dt.timedelta(minutes=1):
            quiet.append((table, seen[table]))
        seen[table] = ts
    quiet += list(seen.items())
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        stream = spark.readStream.schema(ordered.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = _run(ordered.throttle_stream(stream, 10, "5 minutes"), f"throttled{batch}")
        assert sorted(x["event_id"] for x in got.collect()) == sorted(i for p in passed.values() for _, i in p)
        got = _run(ordered.stall_stream(stream, 1, "5 minutes"), f"stalled{batch}")
        assert sorted((x["table_name"], x["last_seen"]) for x in got.collect()) == sorted(quiet)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_throttle_counts_from_the_last_passed(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("T", "P", t + dt.timedelta(milliseconds=ms), s, 1, i) for i, (ms, s) in enumerate([(0, "RUNNING"), (600, "RUNNING"), (1100, "RUNNING"), (1200, "COMPLETED"), (1900, "RUNNING"), (2200, "RUNNING")])]
    df = spark.createDataFrame(rows, ordered.EVENT)
    assert sorted(r["event_id"] for r in P.throttled(df).collect()) == [0, 2, 3, 5]


def test_stats_stream_equals_batch(spark, events):
    batch = spark.read.parquet(events)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(events)
    got = _run(P.stats_totals(stream, ["table_name"]), "stats", "complete")
    assert sorted(got.collect()) == sorted(P.stats_totals(batch, ["table_name"]).collect())


def test_progress_streams_equal_batch(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    for name, shape in (("progress", P.progress_of), ("rollup", P.rollup_of)):
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(events)
        view.kept_table(P.latest_units(stream), shape, str(tmp_path / name)).awaitTermination()
        got = view.kept(spark, str(tmp_path / name))
        assert sorted(map(str, got.collect())) == sorted(map(str, shape(P.latest_units(batch)).collect()))


def test_late_rows_go(spark, tmp_path):
    """A row behind the watermark is dropped, one within it counts, and a window is given once, when it is closed."""
    t = dt.datetime(2024, 1, 1)
    at = lambda h: (t + dt.timedelta(hours=h), "k", 1.0)
    for rows in ([at(1), at(2)], [at(20), at(3)], [at(30), at(2)], [at(31), at(29)], [at(60), at(5)], [at(61)]):
        spark.createDataFrame(rows, "ts timestamp, key string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, key string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _run(P.windowed(stream, "1 day", ["key"], watermark="1 hour"), "closed")
    assert sorted((r["window"]["start"], r["n"]) for r in got.collect()) == [(t, 5), (t + dt.timedelta(days=1), 3)]


def test_stall_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    at = lambda m, k: (k, "P", t + dt.timedelta(minutes=m))
    for rows in ([at(0, "A"), at(0, "B"), at(20, "A")], [at(45, "A")], [at(100, "C")], [at(101, "C")]):
        spark.createDataFrame(rows, "table_name string, partition_key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("table_name string, partition_key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r["table_name"], r["last_seen"]) for r in _run(ordered.stall_stream(stream, 30), "stalled").collect()}
    assert got == {("A", t + dt.timedelta(minutes=45)), ("B", t)}


def test_planned_chunks_decide_completion(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("T", "P:chunk:0", t, "COMPLETED", 5, 1, 1), ("T", "P:chunk:1", t, "COMPLETED", 6, 2, 2)], "table_name string, partition_key string, ts timestamp, state string, rows long, speed long, event_id long")
    planned = spark.createDataFrame([("T", "P", 3)], "table_name string, part string, n_chunks long")
    assert P.chunk_progress(rows).first()["state"] == "COMPLETED"
    assert P.chunk_progress(rows, planned).first()["state"] == "RUNNING"


def test_view_by_levels(spark, tmp_path):
    """Many batches: few tables to read, a repeated batch counts once, an older manifest still reads, no file changes."""
    path, want = str(tmp_path / "view"), {}
    with pytest.raises(FileNotFoundError):
        view.view(spark, path, ["k"], ["x"])
    most, seen = 0, {}
    for number in range(22):
        rows = [(f"k{(number + i) % 5}", i + 0.25) for i in range(4)]
        batch = spark.createDataFrame(rows, "k string, x double").coalesce(1)
        for _ in range(2 if number % 7 == 3 else 1):
            view.fold(batch, number, path, ["k"], ["x"])
        for k, x in rows:
            n, total = want.get(k, (0, 0))
            want[k] = n + 1, total + x
        tables = view.manifest(spark, path)["tables"]
        most = max(most, len(tables))
        now = {f: f.stat().st_mtime_ns for f in (tmp_path / "view" / "tables").glob("*/part-*")}
        assert all(now.get(f, at) == at for f, at in seen.items())
        seen = now
    assert most <= 7 and len(view.versions(spark, path)) == view.KEPT
    got = view.view(spark, path, ["k"], ["x"])
    assert {r["k"]: (r["n"], float(r["x"])) for r in got.collect()} == want
    before = view.manifest(spark, path, 20)
    assert view._read(spark, path, before["tables"]).agg(F.sum("n")).first()[0] == 21 * 4
