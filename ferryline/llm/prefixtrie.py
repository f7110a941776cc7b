"""A trie of conversations' common prefixes, measured by an Euler tour.

A node of depth d is a distinct sequence of d turns (role, text) with which some conversation starts; the root has none.
A node is named by its least member and its depth. Prefixes are told apart by two 64-bit sums (exclusive or) of hashes of
(place, role, text), which an ordered scan gives for conversations of any length, a conversation that is a third of all
turns included.

Euler tour: every node has an enter and an exit arc. After enter comes the enter of the first child, or the node's exit;
after exit comes the enter of the next sibling, or the parent's exit. List ranking: tasks hold nodes by ranges of (conv,
depth), as arcs that follow each other mostly belong to conversations that do too. Each task joins the arcs that follow
each other within it to segments, by pointer jumps on arrays of CHUNK nodes; the segments, few, are ranked by pointer jumps
between tables. Both carry weighted sums along: a node's subtree is what lies between its two arcs, so the difference of
two prefix sums gives its leaves, its savings and its size.

Defined results: rows without conv_id take no part; null role and text are empty; turns come by turn (null first), then
role, then the text's MD5; repeated rows are repeated turns. Without any conversation there is no node. What members end at a node
is hashed in pieces of PIECE ids that tasks join, so that no group is held in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.shared import bounded_batches, cut, drop
from ferryline.operators.scan import LAST, SUM, XOR, scanned

#: A rebuilt conversation takes fewer turns than HEADS from the first of its FAMILY ids.
FAMILY, HEADS = 5, 9
#: Nodes that a task ranks at a time, and ids in a piece of a member list.
CHUNK, PIECE = 1 << 18, 4096
NODE = ["conv", "depth"]


def turns_of(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, at (from 0), two hashes and the bytes of each turn."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = table.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), of(role).alias("role"), of(text).alias("text"))
    rows = rows.withColumns({"md5": F.unhex(F.md5("text")), "g1": F.xxhash64("role", "text"), "bytes": F.octet_length("text").cast("long")}).drop("text")
    rows = rows.withColumn("g2", F.xxhash64(F.lit(1), "md5", "role"))
    placed = scanned(rows, ["conv"], ["turn", "role", "md5"], {"at": (SUM, F.lit(1).cast("long"))})
    return placed.select("conv", "at", "g1", "g2", "bytes")


def heads(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the first turns of the first of their family: all conv, and their turns."""
    sizes = cut(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "sizes")
    convs = sizes.select("conv", heads(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    known = convs.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    # What of the head the first of the family is too short for, shifts the turns after it.
    short = known.withColumn("short", F.col("h") - F.least("h", F.coalesce("n_base", F.lit(0)))).where("short > 0").select("conv", "short")
    later = turns.where(F.col("at") >= heads(F.col("conv")))
    own = later.join(short, "conv", "left").withColumn("at", F.col("at") - F.coalesce("short", F.lit(0))).select("conv", "at", "g1", "g2", "bytes")
    first = turns.where(F.col("at") < HEADS - 1).withColumnRenamed("conv", "base")
    head = first.join(convs, "base").where(F.col("at") < F.col("h")).select("conv", "at", "g1", "g2", "bytes")
    return sizes.select("conv"), own.unionByName(head)


def nodes_of(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv, depth, k1, k2, n_convs, bytes, parent), and where each conversation ends (conv, depth, k1, k2)."""
    mark = lambda g: F.xxhash64("at", g)
    before = scanned(turns.select("conv", "at", "g1", "g2", "bytes"), ["conv"], ["at"], {"p1": (XOR, mark("g1")), "p2": (XOR, mark("g2"))})
    steps = cut(before.select("conv", (F.col("at") + 1).alias("depth"), "p1", "p2", F.col("p1").bitwiseXOR(mark("g1")).alias("k1"), F.col("p2").bitwiseXOR(mark("g2")).alias("k2"), "bytes"), "steps")
    key = ["depth", "k1", "k2"]
    deep = steps.groupBy(*key).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    top = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv", "n_convs", zero.alias("bytes"), zero.alias("p1"), zero.alias("p2"))
    found = cut(deep.unionByName(top), "prefixes")
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    nodes = cut(found.join(above, ["depth", "p1", "p2"], "left").select("conv", *key, "n_convs", "bytes", "parent"), "nodes")
    last = steps.groupBy("conv").agg(F.max_by(F.struct(*key), "depth").alias("end"))
    ends = convs.join(last, "conv", "left").select("conv", *[F.coalesce(F.col(f"end.{c}"), zero).alias(c) for c in key])
    drop(found)
    return nodes, ends


def _find(conv: np.ndarray, depth: np.ndarray, at_conv: np.ndarray, at_depth: np.ndarray) -> np.ndarray:
    """Place of each (at_conv, at_depth) among the sorted (conv, depth), or -1."""
    ids = np.unique(conv)
    code = np.searchsorted(ids, conv) * (depth.max() + 2) + depth
    which = np.minimum(np.searchsorted(ids, at_conv), len(ids) - 1)
    want = which * (depth.max() + 2) + at_depth
    place = np.minimum(np.searchsorted(code, want), len(code) - 1)
    return np.where((ids[which] == at_conv) & (code[place] == want), place, -1)


def _segments(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Joins the arcs of these nodes (sorted by conv and depth) to segments. Arc 2i enters node i and arc 2i + 1 leaves it.

    Gives each node the segments of its arcs, by their first arcs, and the sums up to the arcs; and the segments that begin
    at its arcs, with the arcs that follow them. An arc is named by conv and 2 * depth, and 1 more for an exit."""
    conv, depth, leaf, saved = (batch.column(c).to_numpy() for c in ("conv", "depth", "leaf", "saved"))
    held = {c: (batch.column(c).fill_null(0).to_numpy(), batch.column(c).is_valid().to_numpy(zero_copy_only=False)) for c in ("parent", "child", "sibling")}
    m = len(conv)
    (child, has_child), (sibling, has_sibling), (parent, has_parent) = held["child"], held["sibling"], held["parent"]
    # The arc after each arc: its node's conv and place, and whether it is here.
    to_conv, to_place, ends = np.empty(2 * m, np.int64), np.empty(2 * m, np.int64), np.zeros(2 * m, dtype=bool)
    to_conv[0::2], to_place[0::2] = np.where(has_child, child, conv), np.where(has_child, 2 * depth + 2, 2 * depth + 1)
    to_conv[1::2] = np.where(has_sibling, sibling, parent)
    to_place[1::2] = np.where(has_sibling, 2 * depth, 2 * depth - 1)
    ends[1::2] = ~has_sibling & ~has_parent
    node = _find(conv, depth, to_conv, to_place >> 1)
    after = np.where((node >= 0) & ~ends, 2 * node + (to_place & 1), -1)
    # Sums back to the first arc of each segment, by jumps over the arcs before.
    none = 2 * m
    back = np.full(none + 1, none)
    back[after[after >= 0]] = np.flatnonzero(after >= 0)
    head = np.arange(none + 1)
    sums = np.zeros((3, none + 1), dtype=np.int64)
    sums[0, :none], sums[1, 0:none:2], sums[2, 0:none:2] = 1, leaf, saved
    while (back < none).any():
        sums = sums + sums[:, back]
        head = np.where(back < none, head[back], head)
        back = back[back]
    tails = np.flatnonzero(after < 0)
    tail_of = np.full(none, -1)
    tail_of[head[tails]] = tails
    name = lambda arc: (conv[arc >> 1], 2 * depth[arc >> 1] + (arc & 1))
    out = {"conv": conv, "depth": depth}
    for kind, arcs in (("enter", np.arange(0, none, 2)), ("exit", np.arange(1, none, 2))):
        out[f"{kind}_conv"], out[f"{kind}_place"] = name(head[arcs])
        out |= {f"{kind}_{s}": sums[i, arcs] for i, s in enumerate(("n", "leaves", "saved"))}
    starts = np.flatnonzero(tail_of >= 0)
    tail = tail_of[starts]
    start_conv, start_place = name(starts)
    begun = pa.StructArray.from_arrays([
        pa.array(start_conv), pa.array(start_place), pa.array(to_conv[tail], mask=ends[tail]), pa.array(to_place[tail], mask=ends[tail]), *(pa.array(sums[i, tail]) for i in range(3)),
    ], ["conv", "place", "next_conv", "next_place", "n", "leaves", "saved"])
    offsets = pa.array(np.searchsorted(starts, np.arange(0, none + 1, 2)), pa.int32())
    return pa.RecordBatch.from_arrays([*(pa.array(v) for v in out.values()), pa.ListArray.from_arrays(offsets, begun)], names=[*out, "begun"])


_SEGMENT = "conv long, place long, next_conv long, next_place long, n long, leaves long, saved long"
_ARCS = "conv long, depth long, " + ", ".join(f"{k}_{c} long" for k in ("enter", "exit") for c in ("conv", "place", "n", "leaves", "saved")) + f", begun array<struct<{_SEGMENT.replace(' ', ': ').replace(',:', ',')}>>"


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield _segments(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held = []
    held = [b for b in held if b.num_rows]
    if held:
        yield _segments(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _suffixes(segments: DataFrame) -> DataFrame:
    """Each segment's sums up to the end of the tour, by pointer jumps."""
    at = cut(segments, "segments")
    while not at.where("next_conv is not null").isEmpty():
        far = at.select(F.col("conv").alias("next_conv"), F.col("place").alias("next_place"), F.struct("next_conv", "next_place", "n", "leaves", "saved").alias("far"))
        more = at.where("next_conv is not null").join(far, ["next_conv", "next_place"])
        jumped = more.select("conv", "place", "far.next_conv", "far.next_place", *[(F.col(c) + F.col(f"far.{c}")).alias(c) for c in ("n", "leaves", "saved")])
        old, at = at, cut(jumped.unionByName(at.where("next_conv is null")), "segments")
        drop(old)
    return at


def toured(nodes: DataFrame) -> DataFrame:
    """nodes (conv, depth, parent, n_convs, bytes) with n_children, and n_leaves, saved_tokens, n_nodes of their subtrees."""
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"), F.min("conv").alias("child"))
    below = nodes.where("parent is not null").select("conv", "depth", "parent", F.bitwise_not("conv").alias("down"))
    siblings = scanned(below, ["depth", "parent"], ["down"], {"sibling": (LAST, F.col("conv"))}).select("conv", "depth", "sibling")
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    linked = nodes.join(kids, NODE, "left").join(siblings, NODE, "left").select(
        *NODE, "parent", "child", "sibling", F.when(F.col("child").isNull(), 1).otherwise(0).cast("long").alias("leaf"), saved.alias("saved"), F.coalesce("n_children", F.lit(0)).alias("n_children"),
    )
    linked = cut(linked, "linked")
    arcs = cut(linked.repartitionByRange(*NODE).sortWithinPartitions(*NODE).mapInArrow(_ranked, _ARCS), "arcs")
    ends = _suffixes(arcs.select(F.explode("begun").alias("s")).select("s.*"))
    sums = ("n", "leaves", "saved")
    # Within one segment the sums up to both arcs are enough; else what follows each segment's start is needed.
    one = F.expr("enter_conv = exit_conv and enter_place = exit_place")
    side = lambda k: ends.select(F.col("conv").alias(f"{k}_conv"), F.col("place").alias(f"{k}_place"), *[F.col(c).alias(f"{k}_rest_{c}") for c in sums])
    apart = arcs.where(~one).join(side("enter"), ["enter_conv", "enter_place"]).join(side("exit"), ["exit_conv", "exit_place"])
    between = lambda c, rest: (F.col(f"exit_{c}") - F.col(f"enter_{c}") + rest).alias(c)
    spans = arcs.where(one).select(*NODE, *[between(c, F.lit(0)) for c in sums]).unionByName(apart.select(*NODE, *[between(c, F.col(f"enter_rest_{c}") - F.col(f"exit_rest_{c}")) for c in sums]))
    out = linked.join(spans.select(*NODE, F.col("n").alias("span"), F.col("leaves").alias("span_leaves"), F.col("saved").alias("span_saved")), NODE)
    return out.select(
        *NODE, "n_children", (F.col("span_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("span_saved") + F.col("saved")).alias("saved_tokens"),
        F.expr("(span + 1) div 2").alias("n_nodes"),
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to pieces of comma-joined ids of one node."""
    for batch in batches:
        node = [batch.column(c).to_numpy() for c in ("depth", "k1", "k2")]
        conv = batch.column("conv").to_numpy()
        new = np.zeros(len(conv), dtype=bool)
        new[::PIECE] = True
        for x in node:
            new[1:] |= x[1:] != x[:-1]
        first = np.flatnonzero(new)
        joined = [",".join(map(str, part.tolist())) for part in np.split(conv, first[1:])] if len(conv) else []
        yield pa.RecordBatch.from_arrays([*(pa.array(x[first]) for x in node), pa.array(conv[first]), pa.array(joined, pa.string())], names=["depth", "k1", "k2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node of its sorted pieces."""
    key, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), pa.array([digest.hexdigest()])], names=["depth", "k1", "k2", "ends_sha256"])

    for batch in batches:
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids")), strict=True):
            if node != key:
                if key is not None:
                    yield row()
                key, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if key is not None:
        yield row()


def ends_hashed(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the nodes where conversations end."""
    key = ["depth", "k1", "k2"]
    pieces = ends.select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(_pieces, "depth long, k1 long, k2 long, first long, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(table: DataFrame, rebuild: bool = True, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_nodes.

    With `rebuild` conversations first get the opening turns of their family; without, they are as they stand."""
    bounded_batches(table.sparkSession)
    turns = turns_of(table, conv, turn, role, text)
    convs, rows = rebuilt(turns) if rebuild else (turns.select("conv").distinct(), turns)
    nodes, ends = nodes_of(convs, rows)
    measured = toured(nodes)
    out = nodes.join(measured, NODE).join(ends_hashed(ends), ["depth", "k1", "k2"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "n_nodes",
    )
