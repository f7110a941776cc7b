"""Ordered scans by monoid against pandas, with a hot group over many tasks."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ferryline.operators import ledger as L
from ferryline.operators.names import fresh_names
from ferryline.operators.order import numbered
from ferryline.operators.scan import FIRST, LAST, SUM, XOR, scanned


@pytest.fixture(autouse=True)
def many_tasks(spark):
    """Small ranges stay tasks of their own."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def table(n, seed):
    r = random.Random(seed)
    return [(None if r.random() < 0.05 else "hot" if r.random() < 0.5 else f"k{r.randrange(9)}", i if r.random() > 0.02 else None, None if r.random() < 0.2 else r.randrange(-(2**40), 2**40), r.choice(["a", "b", None])) for i in range(n)]


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_scans(spark, batch):
    rows = table(3000, 1)
    random.Random(2).shuffle(rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "key string, at long, x long, s string, _task long").repartition(3)
        out = scanned(df, ["key"], ["at", "_task"], {"n": (SUM, F.lit(1)), "total": (SUM, F.col("x")), "mark": (XOR, F.col("x")), "last": (LAST, F.col("s")), "first": (FIRST, F.col("x")), "share": (SUM, F.lit(0.5))})
        got = {r["_task"]: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(rows)
    state = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][1] is not None, rows[i][1] or 0, i)):
        key, _, x, s = rows[i]
        n, total, mark, last, first = state.get(key, (0, 0, 0, None, None))
        assert (got[i]["n"], got[i]["total"], got[i]["mark"], got[i]["last"], got[i]["first"], got[i]["share"]) == (n, total, mark, last, first, n / 2)
        state[key] = n + 1, total + (x or 0), mark ^ (x or 0), last if s is None else s, x if first is None else first


def test_a_hot_group_is_many_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id")
    out = scanned(df, ["key"], ["id"], {"n": (SUM, F.lit(1))})
    sizes = [r["n"] for r in out.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert out.agg(F.max("n")).first()[0] == df.where("key = 'hot'").count() - 1


def test_nothing(spark):
    assert scanned(spark.range(0), [], ["id"], {"n": (SUM, F.lit(1))}).collect() == []
    assert sorted(r["n"] for r in scanned(spark.range(9), [], ["id"], {"n": (SUM, F.lit(1))}).collect()) == list(range(9))


def units(n, seed):
    r = random.Random(seed)
    return pd.DataFrame({"table_name": [r.choice(["hot", "hot", "a", "b"]) for _ in range(n)], "job_id": r.sample(range(10 * n), n), "state": [r.choice(["FAILED", "FAILED", "FAILED", "COMPLETED"]) for _ in range(n)]})


def test_streaks_and_rounds_of_a_hot_table(spark):
    pdf = units(2000, 3)
    df = spark.createDataFrame(pdf).repartition(5)
    want, rounds = [], []
    for name, g in pdf.sort_values("job_id").groupby("table_name"):
        run = []
        for k, (job, state) in enumerate(zip([*g["job_id"], None], [*g["state"], "END"], strict=True)):
            if job is not None:
                rounds.append((job, k + 1, g["job_id"].min()))
            if state == "FAILED":
                run.append(job)
            else:
                if len(run) >= 5:
                    want.append((name, run[0], run[-1], len(run)))
                run = []
    assert sorted(tuple(r) for r in L.failure_streaks(df, ["table_name"], "job_id").collect()) == sorted(want)
    got = L.interleave(df.select("job_id", "table_name"), "table_name", "job_id")
    assert sorted((r["job_id"], r["round"], r["bucket_start"]) for r in got.collect()) == sorted(rounds)


def test_reset_of_a_hot_table(spark):
    rows = [(i, "r1", "hot" if i % 3 else f"t{i % 9}", "data", None if i % 7 == 0 else f"p{i % 4}:chunk:{i}", "RETRYING" if i in (4, 5, 7) else "COMPLETED") for i in range(600)]
    df = spark.createDataFrame(rows, "job_id long, run_id string, table_name string, phase string, partition_key string, state string")
    got = {r["job_id"]: r["state"] for r in L.reset_tables(df).collect()}
    hit = {(r[1], r[2], r[3]) for r in rows if r[5] == "RETRYING" and r[4]}
    assert got == {r[0]: "RETRYING" if r[4] and (r[1], r[2], r[3]) in hit else r[5] for r in rows}


def test_helper_names_stay_apart(spark):
    df = spark.createDataFrame([(2, "x", 1), (1, "y", 2)], "_input long, _task string, _place long")
    assert fresh_names(df, "input", "Task", "other") == ["__input", "__Task", "_other"]
    assert sorted((r["_input"], r["row_no"]) for r in numbered(df, "_input").collect()) == [(1, 0), (2, 1)]
