"""Which texts contain which passages, as an equi-join on something that a text must hold to contain the passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.operators.ranges import few
from ferryline.sources.sink import cut, drop

_SPACE = r"[\x20\x09-\x0D]+"
#: Characters of the keys of passages that have no whole word inside.
GRAM = 3
#: Keys, and pairs to test, that are broadcast to the texts; more are shuffled.
BROADCAST_ROWS = 200_000


def _words(text: str) -> Column:
    return F.array_distinct(F.filter(F.split(text, _SPACE), lambda w: w != ""))


def _grams(text: str, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    size = F.char_length(text)
    return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substr(F.col(text), i, F.lit(n)))))


def _few(df: DataFrame) -> DataFrame:
    """df, broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if few(df, BROADCAST_ROWS) else df


def _by_rarest(texts: DataFrame, passages: DataFrame, of_text: Column, of_passage: Column) -> DataFrame:
    """(text_id, item_id) that share the passage's rarest key: the one in the fewest texts, so that hot keys are not met.
    One pass over the texts keeps what they hold of the keys asked for; a key in none has no row, as its passage is in no
    text."""
    asked = cut(passages.select("item_id", F.explode(of_passage).alias("key")), "contain-asked")
    each = cut(asked.select("key").distinct(), "contain-distinct")
    held = cut(texts.select("text_id", F.explode(of_text).alias("key")).join(_few(each), "key", "left_semi"), "contain-held")
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ranked = asked.join(counts, "key", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k"))
    rarest = cut(ranked.where("k.n > 0").select("item_id", F.col("k.key").alias("key")), "contain-keys")
    met = cut(held.join(_few(rarest), "key").select("text_id", "item_id"), "contain-met")
    drop(asked, each, held, rarest)
    return met


def containing(texts: DataFrame, id_col: str, text_col: str, passages: DataFrame, item_col: str, passage_col: str) -> DataFrame:
    """id_col, item_col of each text and passage that it contains. Null and empty passages are in no text.

    The words at a passage's ends may go on in the text, so its keys are the whole words between them; passages without
    such a word have the runs of up to GRAM characters as keys."""
    rows = texts.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text"))
    items = passages.select(F.col(item_col).alias("item_id"), F.col(passage_col).alias("passage")).where(F.col("passage") != "")
    split = F.filter(F.split("passage", _SPACE), lambda w: w != "")
    cutoff = lambda name, edge: F.when(F.col("passage").rlike(edge), 0).otherwise(1).alias(name)
    inner = items.withColumns({"w": split, "a": cutoff("a", r"^[\x20\x09-\x0D]"), "b": cutoff("b", r"[\x20\x09-\x0D]$")})
    inner = inner.withColumn("w", F.array_distinct(F.slice("w", F.col("a") + 1, F.greatest(F.size("w") - F.col("a") - F.col("b"), F.lit(0)))))
    found = [_by_rarest(rows, inner.where(F.size("w") > 0), _words("text"), F.col("w"))]
    short = cut(inner.where(F.size("w") == 0).select("item_id", "passage", F.least(F.char_length("passage"), F.lit(GRAM)).alias("n")), "contain-short")
    for n in sorted(r["n"] for r in short.select("n").distinct().collect()):  # GRAM values at most
        found.append(_by_rarest(rows, short.where(F.col("n") == n), _grams("text", n), _grams("passage", n)))
    met = found[0]
    for x in found[1:]:
        met = met.unionByName(x)
    pairs = rows.join(_few(met), "text_id").join(items, "item_id").where(F.contains("text", F.col("passage")))
    return pairs.select(F.col("text_id").alias(id_col), F.col("item_id").alias(item_col))
