"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

The rate of a source is its target share of the mix over its share of the corpus, times `epochs`. Each document draws its
number of copies by inverting the Poisson distribution of that mean at a number hashed from its id and the seed: rare
copies, no coordination, the same draw on every run. Copies are exploded and sorted by a hash of id and copy, which
shuffles the mix globally and evenly, whatever the sizes of the sources.

The distribution function of a source is an array over the counts around its rate that a hashed number can reach, about
24 * sqrt(rate) of them, made by windows over rows (source, count). The arrays are broadcast if they hold
BROADCAST_VALUES numbers at most in all, else joined over salted keys. Keys are hashes, so their first digits deal them
evenly to the partitions in order, without a sample of the keys.

Defined results: a null source is a source of its own; sources without text or without a target have rate 0 and go; a null
text has 0 bytes and follows its source; rows equal in id draw equal numbers and keep their copies apart by `copy`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.llm.shared import cut, fresh_names
from ferryline.llm.shards import uniform

#: Up to so many numbers the distributions are broadcast (16 MB); beyond that they are joined over salted keys.
BROADCAST_VALUES = 1 << 21
SALTS = 64
#: Copies listed at once.
COPIES = 4096


def poisson_tables(rates: DataFrame) -> DataFrame:
    """rates (source, ..., rate) with `least` and `table`: P(X <= k) for k = least, least + 1, ... while a hashed number can
    lie between them. P(X < least) is below what a hashed number can reach."""
    spread = 12 * F.sqrt("rate") + 40
    least = F.greatest(F.lit(0), F.floor(F.col("rate") - spread)).cast("long")
    counts = rates.select("source", "rate", least.alias("least"), F.explode(F.sequence(least, F.ceil(F.col("rate") + spread).cast("long"))).alias("k"))
    first = Window.partitionBy("source").orderBy("k")
    step = F.when(F.col("k") > F.col("least"), F.log(F.col("rate") / F.col("k"))).when(F.col("least") == 0, -F.col("rate")).otherwise(0.0)
    log_p = counts.withColumn("log_p", F.sum(step).over(first))
    # From 0 the logarithms are the distribution's; else they are known up to a sum that is 1.
    top = F.when(F.col("least") == 0, F.lit(0.0)).otherwise(F.max("log_p").over(Window.partitionBy("source")))
    summed = log_p.withColumn("w", F.exp(F.col("log_p") - top)).withColumn("p", F.sum("w").over(first)).withColumn("whole", F.sum("w").over(Window.partitionBy("source")))
    share = F.when(F.col("least") == 0, F.col("p")).otherwise(F.col("p") / F.col("whole"))
    tables = summed.groupBy("source").agg(F.max("least").alias("least"), F.array_sort(F.collect_list(F.struct("k", share.alias("p")))).alias("t"))
    tables = tables.select(F.col("source").alias("s"), "least", F.transform("t", lambda x: x["p"]).alias("table"))
    return rates.join(tables, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per source: source, n_docs, n_bytes, rate, least, table. Without targets a source weighs n_bytes ** alpha."""
    size = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long")
    found = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("n_bytes"))
    if targets is None:
        weight = F.pow(F.col("n_bytes").cast("double"), F.lit(alpha))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1]))]), F.coalesce("source", F.lit(""))), F.lit(0.0))
    sized = cut(found.withColumn("weight", F.when(F.col("n_bytes") > 0, weight).otherwise(0.0)), "sources")
    whole = sized.agg(F.sum(F.col("weight").cast("decimal(38,12)")).cast("double").alias("w"), F.sum("n_bytes").alias("b")).first()
    share = F.col("weight") / F.lit(whole["w"] or 1.0)
    rate = F.when(F.col("n_bytes") > 0, share * float(epochs) * F.lit(float(whole["b"] or 0)) / F.col("n_bytes")).otherwise(0.0)
    rated = sized.select("source", "n_docs", "n_bytes", rate.alias("rate")).where("rate > 0")
    return cut(poisson_tables(cut(rated, "shares")), "rates")


def mix(
    docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The columns of docs with `mix_rate`, `mix_copy` (from 0) and `mix_key`, sorted by the key; these three replace
    columns of the same names."""
    docs = docs.drop("mix_rate", "mix_copy", "mix_key")
    src, least, table, salt, own, n, run = fresh_names(docs, "source", "least", "table", "salt", "own", "n", "run")
    found = source_rates(docs, targets, alpha, epochs, source_col, text_col)
    rates = found.select(F.col("source").alias(src), F.col("rate").alias("mix_rate"), F.col("least").alias(least), F.col("table").alias(table))
    few = (found.agg(F.sum(F.size("table"))).first()[0] or 0) <= BROADCAST_VALUES
    same = F.col(source_col).cast("string").eqNullSafe(F.col(src))
    if few:
        joined = docs.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(salted, same & (F.col(own) == F.col(salt)))
    draw = uniform(F.col(id_col), str(seed), "copies")
    drawn = joined.withColumn(n, (F.col(least) + F.size(F.filter(table, lambda p: p <= draw))).cast("int")).where(F.col(n) > 0)
    runs = drawn.withColumn(run, F.explode(F.sequence(F.lit(0), F.col(n) - 1, F.lit(COPIES))))
    copies = runs.withColumn("mix_copy", F.explode(F.sequence(F.col(run), F.least(F.col(run) + (COPIES - 1), F.col(n) - 1))))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "mix_copy", F.lit(str(seed))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * parts / float(1 << 32)).cast("int")
    mixed = copies.withColumn("mix_key", key).select(*docs.columns, "mix_rate", "mix_copy", "mix_key")
    return mixed.repartitionById(parts, place).sortWithinPartitions("mix_key")
