"""Merges, loads in batches, rings, pruned scans and statistics."""

import os
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from ferryline.operators import chunks, partitions, rings, statistics
from ferryline.sources import batches, merge, scan, sink


def plan(df):
    return df._jdf.queryExecution().toString()


def test_upsert_of_repeated_and_null_keys(spark):
    target = spark.createDataFrame([(1, "a", None), (2, "b", 5), (None, "n", 1)], "k int, s string, _row int")
    changes = spark.createDataFrame([("c", 2, 7), ("d", 3, None), ("m", None, 2), ("m", None, 3)], "s string, k int, _row int")
    assert sorted(map(tuple, merge.upsert(target, changes, ["k"]).collect()), key=str) == sorted([(1, "a", None), (2, "c", 7), (None, "n", 1), (3, "d", None), (None, "m", 2), (None, "m", 3)], key=str)
    with pytest.raises(Exception, match="several changes of the key"):
        merge.upsert(target, changes.unionByName(changes), ["k"]).collect()


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(400).select("id", (F.col("id") * 2).alias("v"), (F.col("id") % 8).alias("part")).write.partitionBy("part").parquet(path)
    files = lambda: {f.relative_to(tmp_path) for f in (tmp_path / "t").rglob("part-*.parquet")}
    before = files()
    changes = spark.createDataFrame([(8, -1, 0), (17, -2, 5), (1000, -3, 20), *((i, -4, 20) for i in range(3, 400, 8))], "id long, v long, part long")
    assert merge.merge_partitions(spark, path, changes, ["id"], "part") == ["0", "1", "20", "3", "5"]
    kept = {f for f in before if not re.search(r"part=(0|1|3|5|20)/", str(f))}
    assert kept <= files() and len(kept) > 0 and not (tmp_path / "t" / "part=3").exists()
    want = {i: (2 * i, i % 8) for i in range(400)} | {r["id"]: (r["v"], r["part"]) for r in changes.collect()}
    assert {r["id"]: (r["v"], r["part"]) for r in spark.read.parquet(path).collect()} == want
    with pytest.raises(Exception, match="several changes"):
        merge.merge_partitions(spark, path, changes.unionByName(changes), ["id"], "part")
    assert spark.read.parquet(path).count() == len(want)


def test_batches_go_on_after_a_failure(spark, tmp_path):
    """A task dies in the middle of a batch: the next load commits the rest, nothing is lost or doubled."""
    path, mark = str(tmp_path / "db"), str(tmp_path / "died")

    def connect():
        return sqlite3.connect(path, timeout=60)

    def dying():
        db = sqlite3.connect(path, timeout=60)
        if not os.path.exists(mark):
            db.execute("create temp trigger boom before insert on t when new.k = 777 begin select raise(abort, 'boom'); end")
        return db

    db = connect()
    db.execute("create table t (k integer, s text, d text)")
    rows = batches.staged(spark.range(1000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("s"), F.lit("2024-01-01").cast("date").alias("d")).repartition(3))
    with pytest.raises(ValueError, match="staged"):
        batches.load_batches(spark.range(3), connect, "t", "one")
    with pytest.raises(Exception, match="boom"):
        batches.load_batches(rows, dying, "t", "one", batch_rows=64)
    some = db.execute("select count(*) from t").fetchone()[0]
    assert 0 < some < 1000 and some == db.execute("select sum(n_rows) from load_batches").fetchone()[0]
    open(mark, "w").close()
    for _ in range(2):
        batches.load_batches(rows, dying, "t", "one", batch_rows=64)
    assert db.execute("select count(*), count(distinct k), sum(k), min(d) from t").fetchone() == (1000, 1000, 499_500, "2024-01-01")
    assert db.execute("select max(n_rows) from load_batches").fetchone()[0] == 64
    batches.load_batches(rows, connect, "t", "two", batch_bytes=2000)
    assert db.execute("select count(*), max(n_bytes) < 2040, count(*) > 10 from load_batches where load = 'two'").fetchone()[1:] == (1, 1)
    sink.drop(rows)


def test_batches_end_by_rows_or_bytes():
    got = [(len(b), n) for b, n in batches.batched(iter([("x" * 10, None)] * 7), 3, 10**6)]
    assert got == [(3, 42), (3, 42), (1, 14)]
    assert [len(b) for b, _ in batches.batched(iter([("x" * 10, 1)] * 5), 100, 50)] == [2, 2, 1]


def brute_levels(nodes, edges):
    below = {n: {p for a, p in edges if a == n and p in nodes and p != n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for p in below[todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        reach[n] = seen
    comp = {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in nodes}
    up = {c: {comp[p] for n in nodes if comp[n] == c for p in below[n]} - {c} for c in set(comp.values())}
    level = {}

    def of(c):
        if c not in level:
            level[c] = 1 + max(map(of, up[c])) if up[c] else 0
        return level[c]

    return sorted((n, comp[n], of(comp[n])) for n in nodes)


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_through_rings(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(40)]
    edges = [(r.choice(nodes), r.choice([*nodes, "missing"])) for _ in range(34)] + [("n00", "n01"), ("n01", "n02"), ("n02", "n00"), ("n03", "n00")]
    got = rings.levels_through_rings(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "node string, parent string"))
    assert sorted(map(tuple, got.collect())) == brute_levels(set(nodes), edges)


def test_filters_of_partitions_are_pushed(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 10).alias("part")).write.partitionBy("part").parquet(str(tmp_path / "t"))
    bounds = spark.createDataFrame([("a", None, 10), ("b", 10, 20), ("c", 500, 510)], "part string, lower long, upper long")
    df = spark.read.parquet(str(tmp_path / "t"))
    asked = df.where(partitions.range_filter(bounds, "id", "long"))
    assert sorted(r["id"] for r in asked.collect()) == [*range(20), *range(500, 510)]
    assert re.search(r"PushedFilters: \[[^]]*LessThan\(id,20\)", plan(asked)) and "GreaterThanOrEqual(id,500)" in plan(asked)
    assert partitions.range_filter(bounds.limit(0), "id", "long")._jc.toString() == "false"
    one = scan.scan(spark, str(tmp_path / "t"), ["id"], "part = 3")
    assert re.search(r"PartitionFilters: \[[^]]*part", plan(one)) and one.count() == 100
    assert set(one.select(F.regexp_extract(F.input_file_name(), "part=([0-9]+)", 1)).distinct().collect()) == {("3",)}
    parts = scan.chunk_predicates(chunks.range_chunks(df, "id", 4), "id")
    assert [df.where(p).count() for _, p in parts] == [250] * 4 and "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,250), LessThanOrEqual(id,499)]" in plan(df.where(parts[1][1]))


def test_sketches_unite(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("k"), (F.col("id") % 13).alias("part"), F.lit(None).cast("string").alias("none"))
    kept = statistics.collected(df, ["part"], ["k", "none"])
    got = statistics.united(kept, [], ["k", "none"]).first()
    assert got["n_rows"] == 60_000 and abs(got["n_k"] - 20_000) <= 4 * 1.04 / 128 * 20_000 and got["n_none"] == 0
    two = statistics.merged(kept.withColumn("half", F.col("part") % 2), ["half"], ["k"])
    assert statistics.united(two, [], ["k"]).first()["n_k"] == got["n_k"]
