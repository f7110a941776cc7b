"""Registered corpus queries against SQL, and the pipeline."""

import hashlib
import math
from collections import Counter

import pytest
from parity import connect, duck_rows, spark_rows
from pyspark.sql import functions as F
from test_operators import brute_classes, brute_passages, brute_quality, split

import corpus_pipeline
from ferryline.llm import shared
from ferryline.llm.queries import ORACLES, QUERIES
from ferryline.llm.shared import cut


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, con, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf_dir)
        assert left.columns == docs.columns
        seen.append(left.select("doc_id").distinct().count())
    assert docs.count() > seen[0] > seen[1] >= seen[2]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == left.count() and out.where(F.size("piece_ids") != F.col("n_pieces")).isEmpty()
    assert out.select("doc_id").join(docs, "doc_id", "left_anti").isEmpty()


def test_stages_by_brute_force(spark, sf_dir):
    """What each stage keeps of its own input, in plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = lambda df: [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]
    (_, good), (_, once), (_, fresh), (_, mixed), (_, coded) = corpus_pipeline.STAGES
    a = cut(good(spark, docs, sf_dir), "a")
    assert {r["doc_id"] for r in a.select("doc_id").collect()} == brute_quality([x[:3] for x in table(docs)])
    b = cut(once(spark, a, sf_dir), "b")
    classes = brute_classes([x[:2] for x in table(a)])
    assert sorted(x[0] for x in table(b)) == sorted(i for i, c in classes.items() if i == c)
    c = cut(fresh(spark, b, sf_dir), "c")
    assert sorted((x[0], " ".join(split(x[1]))) for x in table(c)) == sorted((i, k) for i, n, m, k in brute_passages([x[:2] for x in table(b)]) if m < n or not n)
    d, size = cut(mixed(spark, c, sf_dir), "d"), Counter()
    for _, t, _, source in table(c):
        size[source] += len((t or "").encode())
    whole = sum(n**0.5 for n in size.values())
    want = []
    for i, t, _, source in table(c):
        rate = size[source] ** 0.5 / whole * sum(size.values()) / size[source]
        u = (int(hashlib.md5(f"{i}:0:copies".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        want += [(i, t)] * n
    assert sorted(x[:2] for x in table(d)) == sorted(want)
    out = coded(spark, d, sf_dir)
    assert sorted((r["doc_id"], r["round_trip"]) for r in out.collect()) == sorted((i, True) for i, _ in want)


def test_stages_leave_no_tables(spark, sf_dir, tmp_path, monkeypatch):
    """A stage removes what the one before left, but nothing that its docs read; run() leaves its result alone."""
    folder = tmp_path / "stages"
    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(folder))
    tables = lambda: [p.name.split("-")[0] for p in (folder / "ferryline").iterdir()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lazy = corpus_pipeline.good(spark, docs, sf_dir)
    assert corpus_pipeline.once(spark, lazy, sf_dir).count() <= lazy.count() and tables().count("quality") == 1
    corpus_pipeline.good(spark, docs, sf_dir).write.parquet(str(tmp_path / "good"))
    assert tables().count("quality") == 2
    corpus_pipeline.once(spark, spark.read.parquet(str(tmp_path / "good")), sf_dir)
    assert tables().count("quality") == 1 and lazy.count() == spark.read.parquet(str(tmp_path / "good")).count()
    folder = tmp_path / "run"
    out = corpus_pipeline.run(spark, sf_dir)
    assert tables() == ["stage4"] and out.count() > 0


def test_pipeline_of_odd_tables(spark, odd, prose, make, tmp_path):
    more = make([(100 + i, f"the of and to in a is that {prose(100, 500 + i)} it for on", "en", None if i % 2 else "s") for i in range(12)])
    rows = odd.unionByName(more).select("doc_id", "text", "lang", "source", "n_chars", F.col("label").alias("_id"), F.lit(1).alias("text_md5"), F.lit("x").alias("_starts"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got and got <= {r["doc_id"] for r in rows.collect()}


def test_pipeline_of_an_empty_table(spark, make, tmp_path):
    make([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_decodes_its_pieces(spark, make, prose):
    out = corpus_pipeline.coded(spark, make([(1, prose(60, 1)), (2, "é ß あ\n🙂 ▁  x "), (3, ""), (4, None)]), "")
    assert [r["round_trip"] for r in out.select("round_trip").collect()] == [True] * 4
