"""MinHash near-dedup: BagMinHash signatures over word shingles, banding, exact check of the multiset overlap.

Two texts are linked if the weighted Jaccard similarity of their multisets of 5-word shingles is 0.8 or more; a class
is a connected component of links, equal texts included. Words are `[^\\x20\\x09-\\x0D]+`; a text of one to four words
has one shingle, all of it.

Signature: each shingle has Poisson processes on a weight axis cut at the integers and grouped in octaves [0,1), [1,2),
[2,4), [4,8) ... A point is (time, level, component); a shingle found w times owns the points below level w. Component
values are the earliest times owned. Points come in time order and stop at the largest component so far; a point of an
octave that w only partly covers counts if its level is below w. Two signatures agree in a component with probability
equal to the weighted Jaccard similarity.

252 of 256 components make 42 bands of 6: a pair at 0.8 shares no band with probability 3e-6, one at 0.4 shares one with
probability 0.16. Within a band bucket no pairs are listed: every text is checked against the most central text of its
buckets, the one with the largest buckets in all (star). What the stars leave open is settled exactly. Each text of a
cluster is compared with the cluster's pivot: x lacks `gone` of its elements and has `fresh` others. A link between x and
y of different components needs a fresh element of both within their prefixes, or else counts that allow it,
(1 + t) min(gone) >= gone + gone' + t (fresh + fresh') - (1 - t) |pivot|. Texts for which neither holds are done; the few
others are compared in blocks of bounded size, by what they differ in from the pivot: x and y share
|pivot| - gone - gone' elements, those that are gone from both and the fresh ones of both.

Every distinct text is a node: the least id of its rows is its number, or, where ids repeat and that id has several
texts, a hashed number that no other node has.

Defined results: rows without an id are classes of their own (class_id null); null texts and texts without words too
(class_id = doc_id); class_id is the smallest id of the class. Texts under one id are one document, so their classes are
one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm import words
from ferryline.llm.shared import cut, cut_counting, drop, fresh_names, keyed

THRESHOLD = 0.8
SHINGLE = 5
COMPONENTS = 256
ROWS_PER_BAND = 6
#: Elements of a block of texts; a text counts as TEXT_ELEMENTS more than it has.
BLOCK_ELEMENTS, TEXT_ELEMENTS = 32_768, 32
_STEP = 0x9E3779B97F4A7C15


def _shingles(t: words.Texts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their texts and their counts, sorted by text and hash."""
    values, owner = t.word_hashes(), t.text_of_word()
    h, at = words.windows(values, owner, k)
    short = np.flatnonzero((t.n_words > 0) & (t.n_words < k))
    h = np.concatenate([h, words.spans_hash(values, t.first[short], t.first[short + 1], words.WINDOW_BASE)])
    who = np.concatenate([owner[at], short])
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    at = np.flatnonzero(new)
    return h[at], who[at], np.diff(np.append(at, len(h)))


def signatures(h: np.ndarray, who: np.ndarray, weight: np.ndarray, n_texts: int, m: int = COMPONENTS) -> np.ndarray:
    """BagMinHash: m times for each text; infinite for a text without shingles. m is a power of two."""
    low = np.full(n_texts * m, np.inf)
    octaves = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    el = np.repeat(np.arange(len(h)), octaves)
    octave = np.arange(len(el)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    floor = np.where(octave == 0, 0, 1 << np.maximum(octave - 1, 0))
    length = np.maximum(floor, 1)
    seed = words.mix(h[el] + (octave.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    text, limit, time = who[el], weight[el], np.zeros(len(el))
    k = 0
    while len(text):
        k += 1
        u = words.mix(seed + np.uint64(k * _STEP % (1 << 64)))
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (length * m)
        alive = time < low.reshape(n_texts, m).max(axis=1)[text]
        u, seed, time, text, limit, floor, length = (x[alive] for x in (u, seed, time, text, limit, floor, length))
        u = words.mix(u ^ np.uint64(0xE7037ED1A0B428DB))
        level = floor + ((u >> np.uint64(32)).astype(np.int64) & (length - 1))
        own = level < limit
        np.minimum.at(low, text[own] * m + (u[own] & np.uint64(m - 1)).astype(np.int64), time[own])
    return low.reshape(n_texts, m)


def _bands(sig: np.ndarray, rows: int) -> np.ndarray:
    n = sig.shape[1] // rows
    parts = np.ascontiguousarray(sig[:, : n * rows]).view(np.uint64).reshape(len(sig), n, rows)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        key = words.mix(key * np.uint64(_STEP) + parts[:, :, r])
    return words.signed(key)


def _sign(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, counts = [], []
            for t in words.texts(batch.column("text")):
                n = len(t.first) - 1
                h, who, weight = _shingles(t, k)
                has = t.n_words > 0
                rows = _bands(signatures(h, who, weight, n), ROWS_PER_BAND)
                bands += [x if ok else None for x, ok in zip(rows, has, strict=True)]
                counts.append(np.where(has, np.maximum(t.n_words - k + 1, 1), 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_md5"), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_md5", "n", "bands"])

    return scan


def _elements(k: int):
    """The multiset of shingles as a sorted set of hashes: the second find of a shingle is another element."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in words.texts(batch.column("text")):
                h, who, weight = _shingles(t, k)
                nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                e, of = words.mix(np.repeat(h, weight) + nth.astype(np.uint64) * np.uint64(_STEP)), np.repeat(who, weight)
                edge = np.searchsorted(of, np.arange(len(t.first)))
                out += [np.sort(words.signed(e[edge[i] : edge[i + 1]])) for i in range(len(t.first) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.list_(pa.int64()))], names=["node", "elements"])

    return scan


def _similar(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _check(threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("ea"), batch.column("eb")
            ok = pa.array([_similar(x[i].values.to_numpy(), y[i].values.to_numpy()) >= threshold for i in range(len(x))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(ok)

    return scan


def _against_pivot(threshold: float):
    """How a text differs from its cluster's pivot: elements gone and fresh, how many, and the fresh part of its prefix.

    A prefix is what any text of similarity threshold must share one element of, fresh elements first, then by hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("gone", "fresh", "pivot_size", "bounded", "prefix", "differs")}
            for e, p in zip(batch.column("elements"), batch.column("pivot_elements"), strict=True):
                e, p = e.values.to_numpy(), p.values.to_numpy()
                new = e[~np.isin(e, p, assume_unique=True)]
                size = len(e) - int(np.ceil(threshold * len(e) - 1e-9)) + 1
                lost = p[~np.isin(p, e, assume_unique=True)]
                for c, v in zip(out, (len(lost), len(new), len(p), len(new) < size, new[:size], np.concatenate([lost, new])), strict=True):
                    out[c].append(v)
            kinds = {"bounded": pa.bool_(), "prefix": pa.list_(pa.int64()), "differs": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "node", "comp")), *(pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items())], names=["cluster", "node", "comp", *out])

    return scan


def overlaps(node: np.ndarray, e: np.ndarray, of: np.ndarray, node2: np.ndarray, e2: np.ndarray, of2: np.ndarray) -> np.ndarray:
    """Shared elements of each text on the left with each on the right: frequent elements by a matrix product, the rest by counting."""
    both = np.zeros((len(node), len(node2)), dtype=np.int64)
    shared = np.intersect1d(e, e2)
    keep, keep2 = np.isin(e, shared), np.isin(e2, shared)
    c, c2 = np.searchsorted(shared, e[keep]), np.searchsorted(shared, e2[keep2])
    of, of2 = of[keep], of2[keep2]
    n, n2 = np.bincount(c, minlength=len(shared)), np.bincount(c2, minlength=len(shared))
    many = np.flatnonzero(n * n2 > 64)
    column = np.full(len(shared), -1)
    for at in range(0, len(many), 1024):
        column[:] = -1
        column[many[at : at + 1024]] = np.arange(len(many[at : at + 1024]))
        x, y = np.zeros((len(node), 1024), np.float32), np.zeros((len(node2), 1024), np.float32)
        x[of[column[c] >= 0], column[c[column[c] >= 0]]] = 1
        y[of2[column[c2] >= 0], column[c2[column[c2] >= 0]]] = 1
        both += np.rint(x @ y.T).astype(np.int64)
    few = n * n2 <= 64
    c, of, c2, of2 = c[few[c]], of[few[c]], c2[few[c2]], of2[few[c2]]
    order = np.argsort(c2)
    c2, of2 = c2[order], of2[order]
    lo = np.searchsorted(c2, c, "left")
    m = np.searchsorted(c2, c, "right") - lo
    at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo, m)
    return both + np.bincount(np.repeat(of, m) * len(node2) + of2[at], minlength=both.size).reshape(both.shape)


def _uniting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of pairs that connect what the pairs before them did not: the others add nothing to the components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[x] = y
            out.append(i)
    return np.array(out, dtype=np.int64)


def _compare(threshold: float):
    """Links between texts of different components in two blocks, as many as connect all that are linked."""

    def flat(block: pa.Array) -> tuple[np.ndarray, ...]:
        lists = block.field("differs")
        size = np.diff(lists.offsets.to_numpy())
        number = lambda c: block.field(c).to_numpy()
        return number("node"), number("comp"), number("pivot_size"), number("gone"), number("fresh"), lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                node, comp, pivot, gone, fresh, e, of = flat(batch.column("left")[i].values)
                node2, comp2, _, gone2, fresh2, e2, of2 = flat(batch.column("right")[i].values)
                both = overlaps(node, e, of, node2, e2, of2) + (pivot - gone)[:, None] - gone2[None, :]
                size, size2 = pivot - gone + fresh, pivot[0] - gone2 + fresh2
                a, b = np.nonzero((both >= threshold * (size[:, None] + size2[None, :] - both)) & (comp[:, None] != comp2[None, :]))
                keep = _uniting(comp[a], comp2[b])
                a, b = a[keep], b[keep]
                yield pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node2[b], pa.int64())], names=["a", "b"])

    return scan


def roots(parents: DataFrame) -> DataFrame:
    """(node, label): the end of each node's chain of parents (one a for each b, no cycles), by pointer jumps."""
    labels = parents.select(F.col("b").alias("node"), F.col("a").alias("label"))
    while True:
        old, jump = labels, labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = labels.select("node", "label").join(jump, "label", "left").select("node", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("moved"))
        labels, moved = cut_counting(step, "roots", "moved")
        drop(old)
        if not moved:
            return labels.select("node", "label")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's connected component, by least labels and pointer jumps."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("mid"))
        old, jump = labels, labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        labels, moved = cut_counting(step.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("label"), "old"), "labels", "label <> old")
        drop(old)
        if not moved:
            drop(both)
            return labels.select("node", "label")


def _at_roots(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """Edges between different labels, and whether there are any; a node without a label is its own."""
    one = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a", "left").select("b", F.coalesce("x", "a").alias("a"))
    both = one.join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b", "left").select("a", F.coalesce("y", "b").alias("b"))
    return cut_counting(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "between")


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after edges have tied some labels together."""
    between, found = _at_roots(edges, labels)
    if not found:
        return labels
    tied = components(between)
    own = labels.join(tied.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return cut(own.unionByName(tied.where("node <> label")).groupBy("node").agg(F.min("label").alias("label")), "tied")


def _pairs_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of a text's first pivot and its others, within the task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        others, first = batch.column("pivots"), batch.column("a").to_numpy()
        size = np.diff(others.offsets.to_numpy())
        pairs = np.unique(np.stack([np.repeat(first, size), others.flatten().to_numpy()], axis=1), axis=0)
        fresh = [p for p in map(tuple, pairs[pairs[:, 0] != pairs[:, 1]].tolist()) if p not in seen]
        seen.update(fresh)
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in fresh], pa.int64()), pa.array([p[1] for p in fresh], pa.int64())], names=["a", "b"])
        if len(seen) > 1_000_000:
            seen.clear()


def _links(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    left = elements.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    right = elements.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(_check(threshold), "a long, b long")


def _rest(star: DataFrame, comp: DataFrame, elements: DataFrame, threshold: float) -> DataFrame | None:
    """Links between texts of one cluster (connected through shared bands) that the stars left in different components."""
    cluster = _joined(roots(star), star.select("a", "pivots").mapInArrow(_pairs_once, "a long, b long")).withColumnRenamed("label", "cluster")
    cluster = cluster.unionByName(cluster.select(F.col("cluster").alias("node"), "cluster")).distinct()
    nodes = cut(cluster.join(comp, "node", "left").select("node", "cluster", F.coalesce("label", "node").alias("comp")), "nodes")
    by_comp = nodes.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    split, n_split = cut_counting(by_comp.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster", "main"), "split")
    if not n_split:
        return None
    some = nodes.join(split, "cluster").join(elements, "node")
    pivot = elements.select(F.col("node").alias("cluster"), F.col("elements").alias("pivot_elements"))
    shaped = cut(some.join(pivot, "cluster").mapInArrow(_against_pivot(threshold), "cluster long, node long, comp long, gone long, fresh long, pivot_size long, bounded boolean, prefix array<bigint>, differs array<bigint>"), "shaped")
    # Texts that share a fresh element with another component,
    fresh = shaped.select("cluster", "node", "comp", F.explode("prefix").alias("element"))
    mixed = cut(fresh.groupBy("cluster", "element").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("cluster", "element"), "mixed")
    sharing = fresh.join(mixed, ["cluster", "element"]).select("cluster", "node", "comp")
    # and texts whose counts alone allow a link that shares none: at most min(gone, gone) elements are gone from both.
    classes = cut(shaped.where("bounded").groupBy("cluster", "gone", "fresh", "pivot_size").agg(F.min("comp").alias("x"), F.max("comp").alias("y")), "classes")
    other = classes.select("cluster", F.col("gone").alias("gone2"), F.col("fresh").alias("fresh2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    may = (1 + threshold) * F.least("gone", "gone2") + 1e-6 >= (threshold - 1) * F.col("pivot_size") + F.col("gone") + F.col("gone2") + threshold * (F.col("fresh") + F.col("fresh2"))
    able = classes.join(other, (classes["cluster"] == other["cluster"]) & (F.least("x", "x2") < F.greatest("y", "y2")) & may, "left_semi").select("cluster", "gone", "fresh")
    counted = shaped.where("bounded").join(cut(able, "able"), ["cluster", "gone", "fresh"]).select("cluster", "node", "comp")
    live = cut(sharing.unionByName(counted).distinct(), "live")
    drop(mixed, classes)
    sized = cut(shaped.drop("bounded", "prefix").join(live, ["cluster", "node", "comp"]).join(split, "cluster"), "sized")
    drop(shaped, live)
    count = cut(sized.groupBy("cluster").agg(F.ceil(F.sum(F.size("differs") + TEXT_ELEMENTS) / BLOCK_ELEMENTS).cast("int").alias("blocks")), "blocks")
    dealt = sized.join(count, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    item = F.struct("node", "comp", "pivot_size", "gone", "fresh", "differs")
    right = dealt.groupBy("cluster", "block").agg(F.collect_list(item).alias("right"))
    outer = dealt.where("comp <> main").groupBy("cluster", "blocks", "block").agg(F.collect_list(item).alias("left"))
    left = outer.select("cluster", "left", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    links, n_links = cut_counting(left.join(right, ["cluster", "block"]).select("left", "right").mapInArrow(_compare(threshold), "a long, b long"), "more-links")
    drop(sized, count)
    return links if n_links else None


def _numbered(texts: DataFrame) -> DataFrame:
    """texts (text_md5, first) with `node`: `first` for the least text of that id, else a hashed number of its own."""
    owners, shared = cut_counting(texts.groupBy("first").agg(F.min("text_md5").alias("text_md5"), F.count(F.lit(1)).alias("n")), "owners", "n > 1")
    if not shared:
        drop(owners)
        return texts.withColumn("node", F.col("first"))
    others, salt = texts.join(owners, ["first", "text_md5"], "left_anti"), 0
    taken = owners.select(F.col("first").alias("node"))
    while True:
        made = cut(others.withColumn("node", F.xxhash64("text_md5", F.lit(salt))), "numbers")
        if made.unionByName(taken, allowMissingColumns=True).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return made.unionByName(owners.select("text_md5", "first", F.col("first").alias("node")))
        drop(made)
        salt += 1


def _ties(usable: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(a, b): nodes of one id."""
    several, n_several = cut_counting(usable.groupBy("doc_id").agg(F.min("text_md5").alias("x"), F.max("text_md5").alias("y")).where("x < y").select("doc_id"), "several")
    if not n_several:
        return None
    each = cut(usable.select("doc_id", "text_md5").join(several, "doc_id").join(nodes, "text_md5").select("doc_id", "node").distinct(), "tied")
    least = each.groupBy("doc_id").agg(F.min("node").alias("a"))
    return each.join(least, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")


def _links_of(rows: DataFrame, usable: DataFrame, nodes: DataFrame, threshold: float, shingle: int) -> DataFrame | None:
    """(node, label) of the nodes that are linked; nothing if none share a band."""
    firsts = usable.join(nodes.withColumnRenamed("first", "doc_id"), ["doc_id", "text_md5"]).dropDuplicates(["node"])
    banded = firsts.select(F.col("node").alias("b"), F.explode("bands").alias("band"))
    buckets = cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    inside = cut(banded.join(buckets, "band"), "inside")
    central = cut(inside.groupBy("b").agg(F.sum("n").alias("s")), "central")
    ranked = inside.select("b", "band").join(central, "b").select("band", "b", F.struct("s", (-F.col("b")).alias("z")).alias("rank"))
    pivots = cut(ranked.groupBy("band").agg(F.max("rank").alias("top")), "pivots")
    best = F.max("top")
    star, n_star = cut_counting(inside.select("b", "band").join(pivots, "band").groupBy("b").agg(best.alias("top"), F.collect_set(-F.col("top.z")).alias("pivots")).select("b", (-F.col("top.z")).alias("a"), "pivots").where("a <> b"), "star")
    drop(buckets, inside, pivots)
    if not n_star:
        return None
    members = central.select(F.col("b").alias("node")).join(nodes, "node").withColumnRenamed("first", "doc_id")
    texts = rows.join(members, ["doc_id", "text_md5"]).dropDuplicates(["node"]).select("node", "text")
    elements = cut(texts.mapInArrow(_elements(shingle), "node long, elements array<bigint>"), "elements")
    drop(central)
    found = roots(cut(_links(star.select("a", "b"), elements, threshold), "links"))
    more = _rest(star, found, elements, threshold)
    if more is not None:
        found = _joined(found, more)
    drop(star, elements)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, text_md5, class_id, n_shingles."""
    rows = keyed(docs, id_col, text_col)
    signed = cut(rows.mapInArrow(_sign(shingle), "doc_id long, text_md5 binary, n long, bands array<bigint>"), "signatures")
    usable = signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    nodes = cut(_numbered(cut(usable.groupBy("text_md5").agg(F.min("doc_id").alias("first")), "equal-texts")), "nodes")
    found, ties = _links_of(rows, usable, nodes, threshold, shingle), _ties(usable, nodes)
    if ties is not None:
        found = _joined(ties.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0) if found is None else found, ties)
    classes = nodes.select("text_md5", F.col("first").alias("class"))
    if found is not None:
        own = found.select("node", "label").unionByName(found.select(F.col("label").alias("node"), "label")).distinct().join(nodes, "node")
        least = own.groupBy("label").agg(F.min("first").alias("class"))
        named = own.join(least, "label").select("text_md5", "class")
        classes = nodes.join(named, "text_md5", "left").select("text_md5", F.coalesce("class", "first").alias("class"))
    classes, ids = cut(classes, "classes"), cut(signed.select("doc_id", "text_md5", "n"), "ids")
    drop(signed, nodes)
    in_class = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    out = ids.join(classes, "text_md5", "left")
    return out.select("doc_id", "text_md5", F.when(in_class, F.col("class")).otherwise(F.col("doc_id")).alias("class_id"), F.col("n").alias("n_shingles"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that have no near-duplicate of a smaller id; rows under one id stay or go together."""
    (key,) = fresh_names(docs, "id")
    found = near_duplicates(docs, id_col, text_col, threshold, shingle).where("class_id < doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(found, F.col(id_col) == F.col(key), "left_anti").select(*docs.columns)
