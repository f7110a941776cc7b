"""Properties: chunks part the rows, tiles are even, greedy batches keep their bounds."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferryline.operators import chunks, shape
from ferryline.operators.order import numbered, tile


@pytest.mark.parametrize("strategy", ["range", "hash", "page", "auto"])
def test_chunks_part_the_rows(spark, strategy):
    df = spark.range(0, 1003).select((F.col("id") * 37 % 1003).alias("k"))
    got = chunks.assign_chunks(df, "k", 9, strategy, page_size=100)
    assert got.count() == 1003 and got.select("k").distinct().count() == 1003
    assert got.where("chunk_id is null").isEmpty()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), max_size=40))
def test_row_numbers(spark, keys):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    got = [(r["k"], r["i"]) for r in numbered(df, "k", ["i"]).orderBy("row_no").collect()]
    assert got == sorted(((k, i) for i, k in enumerate(keys)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_tiles_match_ntile(spark):
    for total, n in [(10, 3), (7, 7), (3, 5), (100, 8)]:
        got = [r[0] for r in spark.range(total).select(tile(F.col("id"), F.lit(total), n)).collect()]
        want = [t for t in range(1, n + 1) for _ in range(total // n + (t <= total % n))]
        assert got == want


def test_batches_keep_bounds(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("c", (F.col("doc_id") % 3).cast("int"))
    got = shape.batches_by_bytes(docs, "c", "doc_id", 10, 20_000).join(docs.select("doc_id", shape.row_bytes(docs).alias("b")), "doc_id")
    sums = got.groupBy("c", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"), F.max("b").alias("m")).collect()
    assert sum(r["n"] for r in sums) == docs.count() and all(r["n"] <= 10 and r["b"] - r["m"] < 20_000 for r in sums)
