"""Order of references that may run in rings: strongly connected components, and levels above them.

Colouring, forwards and backwards: every node takes the largest name among the nodes that lead to it; a node that keeps its
own name is a root, and the nodes of its colour that lead back to it are its component. Components found go, and what is
left is coloured again. Before, nodes that no ring leads to or that lead to no ring are set aside by levels of the graph
and of its reverse, which takes rounds by the logarithm of chains; colouring takes rounds by the length of the rings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.operators.hierarchy import dependency_levels
from ferryline.sources.sink import cut, drop


def _spread(labels: DataFrame, edges: DataFrame, largest: bool) -> DataFrame:
    """(node, label): the largest label among the nodes that lead to a node; without `largest`, nodes that have none take
    the label of any they lead to, if it is their colour (edges carry it)."""
    while True:
        if largest:
            sent = edges.join(labels.select("node", "label"), "node").groupBy(F.col("parent").alias("node")).agg(F.max("label").alias("new"))
            step = labels.join(sent, "node", "left").select("node", F.greatest("label", F.coalesce("new", "label")).alias("now"), "label")
        else:
            sent = edges.join(labels.where("label is not null").select(F.col("node").alias("parent"), F.col("label").alias("new")), "parent").where("new = colour").groupBy("node").agg(F.max("new").alias("new"))
            step = labels.join(sent, "node", "left").select("node", F.coalesce("label", "new").alias("now"), "label")
        old, labels = labels, cut(step.select("node", F.col("now").alias("label"), (~F.col("now").eqNullSafe(F.col("label"))).alias("moved")), "colours")
        drop(old)
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each node's strongly connected component, itself where it is in no ring."""
    known = nodes.select("node").where("node is not null").distinct()
    edges = edges.select("node", "parent").where("node <> parent").distinct()
    edges = cut(edges.join(known, "node", "left_semi").join(known.select(F.col("node").alias("parent")), "parent", "left_semi"), "edges")
    up = dependency_levels(known, edges).where("level is null").select("node")
    down = dependency_levels(known, edges.select(F.col("parent").alias("node"), F.col("node").alias("parent"))).where("level is null").select("node")
    left = cut(up.join(down, "node", "left_semi"), "rings")
    inside = cut(edges.join(left, "node", "left_semi").join(left.select(F.col("node").alias("parent")), "parent", "left_semi"), "inside")
    found = []
    while not left.isEmpty():
        colour = cut(_spread(left.select("node", F.col("node").alias("label")), inside, True), "coloured")
        of = colour.select(F.col("node"), F.col("label").alias("colour"))
        own = cut(inside.join(of, "node").join(of.select(F.col("node").alias("parent"), F.col("colour").alias("other")), "parent").where("colour = other").select("node", "parent", "colour"), "own")
        back = _spread(colour.select("node", F.when(F.col("node") == F.col("label"), F.col("label")).alias("label")), own, False)
        done = cut(back.where("label is not null").select("node", F.col("label").alias("root")), "components")
        found.append(done)
        left, old = cut(left.join(done, "node", "left_anti"), "rings"), left
        inside, gone = cut(inside.join(left, "node", "left_semi").join(left.select(F.col("node").alias("parent")), "parent", "left_semi"), "inside"), inside
        drop(old, gone, colour, own)
    if not found:
        return known.select("node", F.col("node").alias("component"))
    rooted = found[0]
    for f in found[1:]:
        rooted = rooted.unionByName(f)
    least = rooted.groupBy("root").agg(F.min("node").alias("component"))
    named = rooted.join(least, "root").select("node", "component")
    return known.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def levels_through_rings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component, level: the longest chain of references below a node's component, a ring counting as one step; 0
    refers to nothing outside itself. Missing parents and edges to oneself are ignored; equal levels may go at once, lower
    ones first (or last, to take down)."""
    of = cut(components(nodes, edges), "component")
    up = edges.select("node", "parent").join(of.withColumnRenamed("component", "c"), "node").join(of.select(F.col("node").alias("parent"), F.col("component").alias("p")), "parent")
    steps = up.where("c <> p").select(F.col("c").alias("node"), F.col("p").alias("parent")).distinct()
    levels = dependency_levels(of.select(F.col("component").alias("node")).distinct(), steps)
    return of.join(levels.withColumnRenamed("node", "component"), "component").select("node", "component", "level")
