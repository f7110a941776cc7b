"""Sharding by rendezvous hashing of record keys over weighted shards, in DataFrame functions only.

Each key draws a uniform number per shard from a hash of (key, shard); the shard with the smallest -ln(u) / weight takes
it. Adding a shard adds one draw, so a key either stays or moves to the new shard. The law is `key`: nothing but the key
and the shards decides.

Slots number the rows of a shard without gaps. Rows equal in key and text are counted first, so that copies, and texts
under a null key, are no one task's work. The counts are spread over BUCKETS hash buckets per shard by key and text, summed
inside each bucket, and offset by the sums of the buckets before; only these (shards x BUCKETS rows) are broadcast. At last
each count becomes rows again, RUN at a time.

Defined results: a null text has size 1 and CRC 0; a null key is the key 'null'; rows equal in key share a shard and get
slots of their own, by CRC and size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.llm.shared import cut

BUCKETS = 4096
RUN = 65_536


def uniform(*parts: Column | str) -> Column:
    """52 hashed bits as a number strictly between 0 and 1."""
    text = F.concat_ws(":", *[F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int) of a key; weights are positive, one for each shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    draws = [F.struct((-F.log(uniform(key, str(i))) / float(w)).alias("d"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def sharded(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", grown_weight: float | None = 1.0) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard)."""
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    grown = rendezvous(F.col("doc_id"), [*weights, grown_weight]) if grown_weight else F.lit(None).cast("int")
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    bucket = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("slot"), "text_crc32")), 1, 3), 16, 10).cast("int")
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    alike = cut(alike.select("*", rendezvous(F.col("doc_id"), weights).alias("shard"), grown.alias("grown_shard"), bucket.alias("bucket")), "shards")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = alike.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    offsets = sums.select("shard", "bucket", F.coalesce(F.sum("n").over(before(Window.partitionBy("shard").orderBy("bucket"))), F.lit(0)).alias("offset"))
    inside = before(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    placed = alike.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), ["shard", "bucket"]).withColumn("first", F.col("first") + F.col("offset"))
    runs = placed.withColumn("low", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1, F.lit(RUN).cast("long"))))
    slots = F.sequence("low", F.least(F.col("low") + (RUN - 1), F.col("first") + F.col("n") - 1))
    return runs.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(slots).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], id_col: str = "doc_id") -> None:
    """docs as Parquet in one folder per shard, whole rows; each shard in as many files as tasks hold rows of it.

    A column `shard` of docs gives way to the folders' number."""
    docs.withColumn("shard", rendezvous(F.col(id_col), weights)).write.partitionBy("shard").parquet(path)
