"""Incremental views: partial sums of a stream's batches, merged by levels under a manifest.

Each batch adds a table of partial sums on level 0. FANOUT tables of a level are merged to one of the next, so after n
batches a reader adds up at most FANOUT - 1 tables on each of log(n) levels. Tables never change. What the view consists of
is said by the newest manifest, a small file that appears whole by a rename: a reader sees the view before a batch or after
it, never between. A batch that a manifest has counted is not counted again. Tables go when the manifests that name them
are older than KEPT versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: Tables of one level that become one of the next, and manifests whose tables stay for readers.
FANOUT, KEPT = 4, 3


def _fs(spark: SparkSession, path: str) -> tuple[Any, Callable[[str], Any]]:
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests, in order."""
    fs, at = _fs(spark, path)
    folder = at(f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, Any] | None:
    """A manifest, the newest if no version is given; nothing where there is none."""
    found = versions(spark, path)
    if not found:
        return None
    fs, at = _fs(spark, path)
    file = fs.open(at(f"{path}/manifests/{found[-1] if version is None else version:012d}.json"))
    try:
        return json.loads(bytes(file.readAllBytes()).decode())
    finally:
        file.close()


def publish(spark: SparkSession, path: str, version: int, content: dict[str, Any]) -> None:
    """Make content the manifest of this version, then let go of manifests and tables that are KEPT versions old."""
    fs, at = _fs(spark, path)
    hidden = at(f"{path}/manifests/.{uuid.uuid4().hex}")
    file = fs.create(hidden)
    file.write(json.dumps(content).encode())
    file.close()
    final = at(f"{path}/manifests/{version:012d}.json")
    fs.delete(final, False)  # left by a run that did not come to its end
    if not fs.rename(hidden, final):
        raise OSError(f"no manifest {version} in {path}")
    found = versions(spark, path)
    kept = {t for v in found[-KEPT:] for t in manifest(spark, path, v)["tables"]}
    for v in found[:-KEPT]:
        for t in set(manifest(spark, path, v)["tables"]) - kept:
            fs.delete(at(f"{path}/tables/{t}"), True)
        fs.delete(at(f"{path}/manifests/{v:012d}.json"), False)


def _written(df: DataFrame, path: str, level: int) -> str:
    name = f"level{level}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/tables/{name}")
    return name


def _merged(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,2)").alias(c) for c in sums])


def _read(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/tables/{n}" for n in names])


def fold(batch: DataFrame, number: int, path: str, keys: list[str], sums: list[str]) -> None:
    """Add a batch's counts (n) and sums per key to the view, unless a manifest has counted its number."""
    spark = batch.sparkSession
    state = manifest(spark, path) or {"batch": -1, "tables": [], "levels": []}
    if number <= state["batch"]:
        return
    rows = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("decimal(38,2)")).cast("decimal(38,2)").alias(c) for c in sums])
    tables = [*zip(state["levels"], state["tables"], strict=True), (0, _written(rows.sortWithinPartitions(*keys), path, 0))]
    level = 0
    while len(full := [t for at, t in tables if at == level]) >= FANOUT:
        merged = _written(_merged(_read(spark, path, full), keys, sums).sortWithinPartitions(*keys), path, level + 1)
        tables = [(at, t) for at, t in tables if at != level] + [(level + 1, merged)]
        level += 1
    publish(spark, path, number, {"batch": number, "tables": [t for _, t in tables], "levels": [at for at, _ in tables]})


def refresh_view(stream: DataFrame, path: str, checkpoint: str, keys: list[str], sums: list[str]) -> StreamingQuery:
    """Fold what is new of a stream into the view, each batch once."""
    return stream.writeStream.foreachBatch(lambda batch, number: fold(batch, number, path, keys, sums)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def view(spark: SparkSession, path: str, keys: list[str], sums: list[str]) -> DataFrame:
    """The view as the newest manifest has it: keys, n, sums."""
    state = manifest(spark, path)
    if state is None:
        raise FileNotFoundError(f"no view in {path}")
    return _merged(_read(spark, path, state["tables"]), keys, sums)


def kept_table(units: DataFrame, shape: Callable[[DataFrame], DataFrame], path: str) -> StreamingQuery:
    """Keep shape(rows) of a complete streaming aggregate under `path`; after each batch kept() is as of then."""

    def keep(batch: DataFrame, number: int) -> None:
        publish(batch.sparkSession, path, number, {"batch": number, "tables": [_written(shape(batch), path, 0)]})

    return units.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The table that kept_table keeps."""
    return _read(spark, path, manifest(spark, path)["tables"])
