"""Levels and paths over edge tables, by repeated joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.sources.sink import cut


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _chains(one: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ends of chains of single parents, from (node, top): (node, top, dist) with a top that has none or several, and
    (node) of those that run into a ring. Chains double in each round."""
    inside = one.select(F.col("node").alias("top"), F.lit(True).alias("inner"))
    step = cut(one.join(inside, "top", "left").select("node", "top", F.lit(1).cast("long").alias("dist"), F.coalesce("inner", F.lit(False)).alias("inner")), "chains")
    done, last = [step.where("not inner")], None
    while True:
        above = step.where("inner")
        n = above.count()
        # Chains have nodes at every distance: if no chain ended, none will.
        if n in (0, last):
            return _union(done).drop("inner"), above.select("node")
        last = n
        far = _union([*done, above]).select(F.col("node").alias("top"), F.col("top").alias("up"), F.col("dist").alias("more"), F.col("inner").alias("on"))
        step = cut(above.join(far, "top").select("node", F.col("up").alias("top"), (F.col("dist") + F.col("more")).alias("dist"), F.col("on").alias("inner")), "chains")
        done.append(step.where("not inner"))


def _branches(links: DataFrame) -> DataFrame:
    """(node, level) from links (node, top, dist, level), level null where the top's is open: nodes are settled when all
    their links are, until none is left or the rest refers to a ring."""
    found = []
    while True:
        new = cut(links.groupBy("node").agg(F.max("level").alias("level"), F.every(F.col("level").isNotNull()).alias("settled")).where("settled").select("node", "level"), "settled")
        found.append(new)
        if new.isEmpty():
            return _union(found)
        tops = new.select(F.col("node").alias("top"), F.col("level").alias("l"))
        left = links.join(new.select("node"), "node", "left_anti").join(tops, "top", "left")
        links = cut(left.select("node", "top", "dist", F.coalesce("level", F.col("dist") + F.col("l")).alias("level")), "links")


def dependency_levels(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, level: the longest chain of references below a node; 0 refers to nothing.

    edges are (node, parent). Missing parents and edges to oneself are ignored. Chains of single parents take about
    log2(length) rounds, nodes of several parents one round for each such node on a chain. A node that refers to a ring
    has no longest chain: its level is null. With max_depth, levels above it and those of rings become max_depth."""
    known = nodes.select("node").distinct()
    edges = edges.where("node <> parent").join(known.select(F.col("node").alias("parent")), "parent", "left_semi").join(known, "node", "left_semi")
    edges = cut(edges.select("node", "parent").distinct(), "edges")
    degree = edges.groupBy("node").agg(F.min("parent").alias("top"), F.count(F.lit(1)).alias("n"))
    chains, ring = _chains(cut(degree.where("n = 1").select("node", "top"), "one"))
    many = cut(degree.where("n > 1").select("node"), "many")
    ringed = ring.select("node", F.lit(None).cast("long").alias("level"))
    if many.isEmpty():
        levels = chains.select("node", F.col("dist").alias("level")).unionByName(ringed)
    else:
        ends = chains.select("node", "top", "dist", F.lit(False).alias("ring")).unionByName(ring.select("node", F.col("node").alias("top"), F.lit(0).cast("long").alias("dist"), F.lit(True).alias("ring")))
        up = edges.join(many, "node", "left_semi").join(ends.withColumnRenamed("node", "parent"), "parent", "left")
        links = up.select("node", F.coalesce("top", "parent").alias("top"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist"), F.coalesce("ring", F.lit(False)).alias("ring"))
        branching = many.select(F.col("node").alias("top"), F.lit(True).alias("open"))
        waiting = F.col("ring") | F.col("open").isNotNull()
        links = links.join(branching, "top", "left").select("node", "top", "dist", F.when(~waiting, F.col("dist")).alias("level"))
        settled = cut(many.join(_branches(cut(links, "links")), "node", "left"), "branches")
        tops = settled.select(F.col("node").alias("top"), F.col("level").alias("l"), F.lit(True).alias("open"))
        below = chains.join(tops, "top", "left").select("node", F.when(F.col("open"), F.col("dist") + F.col("l")).otherwise(F.col("dist")).alias("level"))
        levels = below.unionByName(settled).unionByName(ringed)
    out = nodes.join(levels.withColumn("deep", F.lit(True)), "node", "left").select("node", F.when(F.col("deep"), F.col("level")).otherwise(F.lit(0)).cast("int").alias("level"))
    return out if max_depth is None else out.select("node", F.least(F.coalesce("level", F.lit(max_depth)), F.lit(max_depth)).alias("level"))


def descend(edges: DataFrame, node: str, parent: str, sep: str = "/") -> DataFrame:
    """node, level (1 for roots), path, is_leaf: all walks from rows without a parent; a node met again on its path ends it.

    Walks double in each round: those of 2^k rows that end at no root yet are put behind the walks that end at their top,
    so the rounds are about log2(depth) and neither depth nor rows have a limit."""
    rows = edges.select(F.col(node).alias("node"), F.col(parent).alias("top"), F.array(F.col(node).cast("string")).alias("path"))
    walks = cut(rows.where("top is null or node <> top"), "walks")
    done = [walks.where("top is null")]
    while True:
        above = walks.where("top is not null")
        if above.isEmpty():
            break
        far = _union([*done, above]).select(F.col("node").alias("top"), F.col("top").alias("up"), F.col("path").alias("head"))
        longer = above.join(far, "top").where(~F.arrays_overlap("head", "path"))
        walks = cut(longer.select("node", F.col("up").alias("top"), F.concat("head", "path").alias("path")), "walks")
        done.append(walks.where("top is null"))
    walked = _union(done).select("node", F.size("path").alias("level"), F.when(F.col("node").isNotNull(), F.array_join("path", sep)).alias("path"))
    parents = edges.where(F.col(parent).isNotNull()).select(F.col(parent).alias("node")).distinct().withColumn("_p", F.lit(True))
    return walked.join(parents, "node", "left").select("node", "level", "path", F.col("_p").isNull().alias("is_leaf"))
