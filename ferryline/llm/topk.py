"""Exact top-k search by a pivot-distance index.

Vectors become integers, floor(scale * x). The search is for the largest inner product; one more coordinate,
sqrt(M - |v|^2) with M the largest squared norm, makes all rows equally long, so that the largest inner product is the
least distance and the triangle inequality holds. Every row is keyed by its nearest pivot and the distance to it, sorted
by both, and packed in blocks (annuli) of bounded size; a hot vector fills as many blocks as it needs. A block carries
the least and largest distance of its rows to its own pivot and to the first OUTPOSTS pivots; GROUP_BLOCKS neighbours
make a group, the unit in which packs and blocks meet, so a hot pivot is spread over its groups.

A query starts from its k-th best in the sample and first visits the annuli of its home pivot, then every other annulus
that the bounds leave: rows at distances [lo, hi] of a pivot p can be among the k best only if [lo, hi] meets
[d(q, p) - r, d(q, p) + r], r the radius of the k-th best so far. Queries travel in packs of neighbours: a pack goes to
the groups that the bound leaves to one of its queries, and there each query is tested against each block, by all of the
block's pivots, before any product is taken. Scores are matrix products.

Pivots come from the SAMPLE rows with the least hashed ids (a bounded, documented sample), farthest first, as many as a
quarter of the root of the rows, PIVOTS of them at least and MOST_PIVOTS at most; every row is indexed and the result is
exact whatever the sample.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors are padded
with zeros; equal scores go to the smaller id. Of rows that share an id each is a query, and none is a candidate of the
others. Integer components saturate at 2**53, beyond which a double has no fraction to lose; scores are compared exactly,
and given as the ends of long where they lie beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.llm.shared import bounded_batches, cut

SAMPLE, PIVOTS, MOST_PIVOTS, OUTPOSTS = 4096, 64, 1024, 64
#: The longest vector; all rows are padded to the longest one, and the sample on the driver too (512 MB at most).
MOST_DIMS = 16_384
#: Components of a block of rows; a pack of queries has half as many rows.
BLOCK_VALUES = 1 << 15
GROUP_BLOCKS = 16
LARGEST = 1 << 53


def integers(vector: Column, scale: int) -> Column:
    bound = float(LARGEST)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), x.cast("double") * float(scale)))).cast("long"))


def clean(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and integer vector v of the rows that take part."""
    finite = lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    kept = vectors.where(F.col(id_col).isNotNull() & F.coalesce(F.forall(vector_col, finite), F.lit(False)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), scale).alias("v"))


class Space:
    """Pivots and sample in the lengthened space. Integer products are exact in floats while they stay below 2**53, in
    whole numbers of 64 bits below 2**63, and else in Python's."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, dims: int, longest: float, largest: int, pivots: int = PIVOTS):
        self.dims, self.longest = dims, longest
        most = dims * largest * largest
        self.kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
        self.stored = "<i4" if largest < 2**31 else "<i8"
        self.block = min(max(BLOCK_VALUES // dims, 16), 512)
        order = np.argsort(ids, kind="stable")
        self.ids, self.sample = ids[order], sample[order].astype(self.kind)
        far, chosen, points = None, [0], self.lengthened(sample[order])
        while len(points) and len(chosen) < min(pivots, len(points)):
            d = ((points - points[chosen[-1]]) ** 2).sum(axis=1)
            far = d if far is None else np.minimum(far, d)
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.pivots = points[chosen] if len(points) else np.zeros((1, dims + 1))

    def matrix(self, lists: pa.Array) -> np.ndarray:
        size = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(size), self.dims), dtype=np.int64)
        at = np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[at] = lists.flatten().to_numpy()
        return out

    def rows(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype=self.stored).reshape(-1, self.dims)

    def products(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x.astype(self.kind) @ y.astype(self.kind).T

    def lengthened(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.concatenate([v, np.sqrt(np.maximum(self.longest - (v * v).sum(axis=1), 0))[:, None]], axis=1)

    def distances(self, x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
        return np.sqrt(np.maximum(d, 0))

    def query_distances(self, v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        return self.distances(np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], axis=1), pivots)

    def radius(self, v: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance of a row with that score, rounded up by what sums of squares in doubles may lose; infinite while there are fewer than k."""
        v = v.astype(np.float64)
        squares = (v * v).sum(axis=1) + self.longest
        far = np.sqrt(np.maximum(squares - 2 * np.maximum(score, -1e300), 0))
        return np.where(np.isfinite(score), far + 1e-6 * np.sqrt(squares * (1 + self.dims / 64)), np.inf)

    def keeps(self, v: np.ndarray, r: np.ndarray, pivot: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which queries of radius r may have a result in a block of that pivot: low and high hold its own distances first."""
        d = self.query_distances(v, np.concatenate([self.pivots[pivot : pivot + 1], self.pivots[:OUTPOSTS]]))
        return ((d - r[:, None] <= high) & (d + r[:, None] >= low)).all(axis=1)


def _key(space_of):
    """Nearest pivot and distance of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = space_of.value
        for batch in batches:
            d = space.distances(space.lengthened(space.matrix(batch.column("v"))), space.pivots)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near]), *batch.columns], names=["pivot", "dist", "vec_id", "v"])

    return scan


def _annuli(space_of):
    """Blocks of sorted rows of one pivot, with their distances to it and to the outposts, in groups of neighbours."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = space_of.value
        number, last, group = 0, -1, TaskContext.get().partitionId() << 32
        for batch in batches:
            pivot, dist, ids = (batch.column(c).to_numpy() for c in ("pivot", "dist", "vec_id"))
            v = space.matrix(batch.column("v"))
            edges = np.flatnonzero(np.diff(pivot, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for i in range(a, b, space.block):
                    j = min(i + space.block, b)
                    number = 0 if pivot[i] != last else number + 1
                    group, last = group + (number % GROUP_BLOCKS == 0), pivot[i]
                    far = space.distances(space.lengthened(v[i:j]), space.pivots[:OUTPOSTS])
                    low, high = [dist[i:j].min(), *far.min(axis=0)], [dist[i:j].max(), *far.max(axis=0)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pivot[i : i + 1]), pa.array([group]), pa.array([low], pa.list_(pa.float64())), pa.array([high], pa.list_(pa.float64())), pa.array([ids[i:j].tolist()], pa.list_(pa.int64())), pa.array([v[i:j].astype(space.stored).tobytes()], pa.binary())],
                        names=["pivot", "grp", "low", "high", "ids", "rows"],
                    )

    return scan


def _packs(space_of, k: int):
    """Packs of queries with the k-th best score and id in the sample."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = space_of.value
        pack = TaskContext.get().partitionId() << 32
        for whole in batches:
            for a in range(0, len(whole), space.block // 2):
                batch = whole.slice(a, space.block // 2)
                ids, v = batch.column("vec_id").to_numpy(), space.matrix(batch.column("v"))
                score = np.full(len(ids), -np.inf)
                if len(space.ids):
                    s = space.products(v, space.sample).astype(np.float64)
                    s[ids[:, None] == space.ids[None, :]] = -np.inf
                    if s.shape[1] >= k:
                        score = np.partition(s, -k, axis=1)[:, -k]
                if space.kind is object:
                    score = np.nextafter(score, -np.inf)  # a sum that a double has rounded up
                homes = np.unique(space.query_distances(v, space.pivots).argmin(axis=1)).astype(np.int32)
                pack += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pack]), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([v.astype(space.stored).tobytes()], pa.binary()), pa.array([score.tolist()], pa.list_(pa.float64())), pa.array([homes.tolist()], pa.list_(pa.int32()))],
                    names=["pack", "qids", "queries", "score", "homes"],
                )

    return scan


def _reach(space_of, home: bool):
    """For each pack and pivot the distances within which an annulus may hold a result."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = space_of.value
        for batch in batches:
            for i in range(len(batch)):
                v, score = space.rows(batch.column("queries")[i].as_py()), batch.column("score")[i].values.to_numpy()
                d, r = space.query_distances(v, space.pivots), space.radius(v, score)
                near, far = (d - r[:, None]).min(axis=0), (d + r[:, None]).max(axis=0)
                at = np.flatnonzero(np.isin(np.arange(d.shape[1]), batch.column("homes")[i].values.to_numpy()) == home).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("pack").take(pa.array(np.full(len(at), i))), pa.array(at), pa.array(near[at]), pa.array(far[at])], names=["pack", "pivot", "near", "far"])

    return scan


def _match(space_of, k: int, visited: Accumulator | None):
    """The k best rows of a block for each query of a pack that the block's bounds leave, none below the query's k-th best so far."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = space_of.value
        for batch in batches:
            for i in range(len(batch)):
                take = lambda c: batch.column(c)[i]  # noqa: E731, B023
                q, least = space.rows(take("queries").as_py()), take("score").values.to_numpy()
                some = np.flatnonzero(space.keeps(q, space.radius(q, least), take("pivot").as_py(), take("low").values.to_numpy(), take("high").values.to_numpy()))
                if not len(some):
                    continue
                v, ids = space.rows(take("rows").as_py()), take("ids").values.to_numpy()
                if visited is not None:
                    visited.add(len(some) * len(v))
                qids, least, place = take("qids").values.to_numpy()[some], least[some], some + (take("pack").as_py() << 10)
                s = space.products(q[some], v)
                a, b = np.nonzero(s >= least[:, None])
                a, b = (x[qids[a] != ids[b]] for x in (a, b))
                found = s[a, b]
                order = np.lexsort((ids[b], -np.unique(found, return_inverse=True)[1], a))
                a, b, found = a[order], b[order], found[order]
                top = np.arange(len(a)) - np.searchsorted(a, a) < k
                a, b, found = a[top], b[top], found[top]
                score = pa.array([int(x) for x in found], pa.decimal128(38, 0)) if space.kind is object else pa.array(found.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(place[a]), pa.array(qids[a]), pa.array(ids[b]), score], names=["query", "query_id", "vec_id", "score"])

    return scan


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _tightened(packs: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """packs with the k-th best score found so far where there are k."""
    kth = best.where(F.col("rank") == k).select(F.col("query").alias("q"), F.col("score").cast("double").alias("s"))
    each = packs.select("pack", F.posexplode("score").alias("pos", "score")).withColumn("q", F.col("pack") * 1024 + F.col("pos"))
    new = each.join(kth, "q", "left").select("pack", "pos", F.greatest("s", "score").alias("score"))
    lists = new.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("pos", "score"))).alias("x"))
    return packs.drop("score").join(lists, "pack").select("pack", "qids", "queries", F.col("x.score").alias("score"), "homes")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, visited: Accumulator | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows for each query row, rows of its own id left out.

    is_query is a condition on the column vec_id. `visited` is raised by the pairs of query and row that are scored."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = cut(clean(vectors, id_col, vector_col, scale), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.max(squares).alias("longest"), F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0))).alias("largest")).first()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    dims = int(size["dims"] or 1)
    if dims > MOST_DIMS:
        raise ValueError(f"a vector has {dims} components, more than {MOST_DIMS}")
    values = np.zeros((sample.num_rows, dims), dtype=np.int64)
    for i, x in enumerate(sample["v"].to_pylist()):
        values[i, : len(x)] = x
    n_pivots = min(max(PIVOTS, int(size["n"] ** 0.5) // 4), MOST_PIVOTS)
    space = spark.sparkContext.broadcast(Space(sample["vec_id"].to_numpy().astype(np.int64), values, dims, float(size["longest"] or 0), int(size["largest"] or 0), n_pivots))
    keyed = rows.mapInArrow(_key(space), "pivot int, dist double, vec_id long, v array<bigint>")
    dealt = keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    index = cut(dealt.mapInArrow(_annuli(space), "pivot int, grp long, low array<double>, high array<double>, ids array<bigint>, rows binary"), "annuli")
    groups = cut(index.groupBy("grp", "pivot").agg(F.min(F.get("low", F.lit(0))).alias("lo"), F.max(F.get("high", F.lit(0))).alias("hi")), "groups")
    asked = rows.where(is_query).mapInArrow(_key(space), "pivot int, dist double, vec_id long, v array<bigint>").repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    packs = cut(asked.select("vec_id", "v").mapInArrow(_packs(space, k), "pack long, qids array<bigint>, queries binary, score array<double>, homes array<int>"), "packs")
    score = "decimal(38,0)" if space.value.kind is object else "long"

    def found(some: DataFrame, home: bool) -> DataFrame:
        near = some.mapInArrow(_reach(space, home), "pack long, pivot int, near double, far double")
        met = near.join(groups, "pivot").where((F.col("lo") <= F.col("far")) & (F.col("hi") >= F.col("near"))).select("pack", "grp")
        pairs = met.join(some.select("pack", "qids", "queries", "score"), "pack").join(index, "grp")
        return pairs.select("pack", "qids", "queries", "score", "pivot", "low", "high", "ids", "rows").mapInArrow(_match(space, k, visited), f"query long, query_id long, vec_id long, score {score}")

    first = cut(_best(found(packs, True), k), "home")
    rest = found(_tightened(packs, first, k), False)
    best = _best(first.drop("rank").unionByName(rest), k)
    held = F.greatest(F.lit(-(2**63)).cast("decimal(38,0)"), F.least(F.lit(2**63 - 1).cast("decimal(38,0)"), F.col("score"))).cast("long") if space.value.kind is object else F.col("score")
    return best.select("query_id", "rank", "vec_id", held.alias("score"))
