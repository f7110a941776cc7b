"""Ranked lexical search over bit-sliced Bloom signatures.

Terms are the maximal runs of ASCII letters, digits and bytes above 127, A-Z in lower case. The index has a row for each
block of documents of like size. Each document has a Bloom signature: every term sets HASHES bits, and again for each level
of LEVELS that its count reaches. Signatures are stored by slices: row b of a block's bit matrix holds bit b of all its
documents. The row also holds the documents' lengths and the block's terms with their document counts, from which the
figures of the corpus come without reading a text again.

A query term's slices, and-ed, say which documents may hold it: all that do, and a few others. By the levels reached they
bound its count from above, and so its score, as the score grows with the count; sums over an item's terms bound the
document's score. Two rounds follow. The documents of the highest bounds are scored exactly: the last of them gives a score
that the answer reaches at least. Then every document whose bound reaches that score, and so every document that is not
proven to be outside, is scored exactly from its text. A task keeps the best of each item only.

Items are read in groups of bounded size, so what tasks are sent is bounded whatever the table of items holds.

Defined results: null and empty texts have no term and no rank; items without terms, or with no term that a document
holds, have no row; equal scores rank by doc_id (null first), and repeated rows are documents of their own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferryline.llm import words
from ferryline.llm.shared import bounded_batches, cut, drop, keyed

#: Bits set for a key, and bits of signature for each key of the largest document of a block.
HASHES, KEY_BITS = 4, 12
#: Counts of a term that are keys of their own.
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256, 1024, 1 << 14, 1 << 20])
#: Bits of a block's matrix, most documents of a block, and widest signature; a wider one would only be more exact.
BLOCK_BITS, BLOCK_DOCS, MOST_BITS = 1 << 23, 4096, 1 << 20
#: Items, and bytes of their texts, that are looked up together; a longer item is a group of its own.
GROUP_ITEMS, GROUP_BYTES = 512, 1 << 22
#: Candidate documents that are broadcast to their texts; more are joined by a shuffle.
BROADCAST_DOCS = 200_000

_GAP = np.ones(256, dtype=bool)
_GAP[128:] = _GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False


def _chunks(column: pa.Array) -> Iterator[words.Texts]:
    for t in words.texts(column, _GAP):
        t.data = words.LOWER[t.data]
        yield t


def _terms(t: words.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text, their texts and their counts, sorted by text and hash."""
    h, owner = t.word_hashes(), t.text_of_word()
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return h[at], owner[at], np.diff(np.append(at, len(h)))


def _bits(h: np.ndarray, level: np.ndarray | int, width: int) -> np.ndarray:
    """HASHES bit places of each key (term, level)."""
    x = words.mix(h + np.asarray(level, dtype=np.uint64) * np.uint64(words.WORD_BASE))
    step = words.mix(x) | np.uint64(1)
    return ((x[..., None] + np.arange(HASHES, dtype=np.uint64) * step[..., None]) % np.uint64(width)).astype(np.int64)


@dataclass
class _Doc:
    doc_id: int | None
    md5: bytes
    n: int
    terms: np.ndarray
    counts: np.ndarray


def _block(docs: list[_Doc], width: int) -> dict:
    size = -(-len(docs) // 8) * 8
    matrix = np.zeros(width * size, dtype=bool)
    for i, d in enumerate(docs):
        for level, least in enumerate(LEVELS):
            h = d.terms[d.counts >= least]
            if not len(h):
                break
            matrix[_bits(h, level, width).ravel() * size + i] = True
    terms, df = np.unique(np.concatenate([d.terms for d in docs]), return_counts=True)
    return {
        "doc_ids": [d.doc_id for d in docs], "md5s": [d.md5 for d in docs], "lengths": np.array([d.n for d in docs]), "width": width,
        "slices": np.packbits(matrix.reshape(width, size), axis=1).tobytes(), "terms": words.signed(terms), "df": df,
    }


_INDEX = "doc_ids array<bigint>, md5s array<binary>, lengths array<bigint>, width long, slices binary, terms array<bigint>, df array<bigint>"
_KINDS = {"doc_ids": pa.list_(pa.int64()), "md5s": pa.list_(pa.binary()), "lengths": pa.list_(pa.int64()), "width": pa.int64(), "slices": pa.binary(), "terms": pa.list_(pa.int64()), "df": pa.list_(pa.int64())}


def _rows(block: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block[c]], kind) for c, kind in _KINDS.items()], names=list(_KINDS))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents gather by the power of two of their number of keys until a block is full."""
    waiting: dict[int, list[_Doc]] = {}
    plan = lambda k: (min(KEY_BITS << k, MOST_BITS), min(BLOCK_DOCS, max(8, BLOCK_BITS // min(KEY_BITS << k, MOST_BITS))))
    for batch in batches:
        ids, md5s, row = batch.column("doc_id"), batch.column("text_md5"), 0
        for t in _chunks(batch.column("text")):
            h, owner, count = _terms(t)
            keys = np.searchsorted(LEVELS, count, "right")
            edge = np.searchsorted(owner, np.arange(len(t.first)))
            for i, n in enumerate(t.n_words.tolist()):
                if n:
                    own = slice(edge[i], edge[i + 1])
                    k = int(keys[own].sum() - 1).bit_length()
                    width, size = plan(k)
                    docs = waiting.setdefault(k, [])
                    docs.append(_Doc(ids[row + i].as_py(), md5s[row + i].as_py(), n, h[own].copy(), count[own].copy()))
                    if len(docs) == size:
                        yield _rows(_block(waiting.pop(k), width))
            row += len(t.n_words)
    for k in list(waiting):
        yield _rows(_block(waiting.pop(k), plan(k)[0]))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of a table of documents, written to the shared folder; it serves any number of searches."""
    bounded_batches(docs.sparkSession)
    return cut(keyed(docs, id_col, text_col).mapInArrow(_index, _INDEX), "signatures")


@dataclass
class _Items:
    """A group of items. Item i has the terms terms[of[first[i]:first[i + 1]]], found times[...] times in it."""

    ids: list
    terms: np.ndarray
    of: np.ndarray
    times: np.ndarray
    first: np.ndarray
    weights: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0

    def shares(self, tf: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """What a term found tf times in a document of n terms adds for each point of weight."""
        m = 25 + (75 * np.asarray(n, dtype=np.int64) * self.n_docs) // self.n_terms
        return np.where(tf > 0, (1_000_000_000 * tf) // np.maximum(1000 * tf + 8 * m, 1), 0)


def _groups(items: DataFrame, id_col: str, text_col: str) -> Iterator[_Items]:
    def group(rows: list) -> _Items:
        found = [_terms(t) for t in _chunks(pa.array([r["text"] for r in rows], pa.string()))]
        sizes = [len(t.first) - 1 for t in _chunks(pa.array([r["text"] for r in rows], pa.string()))]
        owner = np.concatenate([o + sum(sizes[:k]) for k, (_, o, _) in enumerate(found)])
        terms, of = np.unique(np.concatenate([h for h, _, _ in found]), return_inverse=True)
        return _Items([r["id"] for r in rows], terms, of, np.concatenate([c for _, _, c in found]), np.searchsorted(owner, np.arange(len(rows) + 1)))

    rows, size = [], 0
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").toLocalIterator():
        rows.append(r)
        size += len(r["text"].encode())
        if len(rows) == GROUP_ITEMS or size >= GROUP_BYTES:
            yield group(rows)
            rows, size = [], 0
    if rows:
        yield group(rows)


def _counts(wanted: np.ndarray):
    """Documents, their terms, and documents of each wanted term, over a task's blocks; a row for each number."""
    order = words.signed(wanted)
    sorter = np.argsort(order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = length = 0
        df = np.zeros(len(order), dtype=np.int64)
        for batch in batches:
            lengths = batch.column("lengths").flatten().to_numpy()
            docs, length = docs + len(lengths), length + int(lengths.sum())
            terms, n = batch.column("terms").flatten().to_numpy(), batch.column("df").flatten().to_numpy()
            at = np.minimum(np.searchsorted(order, terms, sorter=sorter), max(len(order) - 1, 0))
            if len(order):
                at = sorter[at]
                hit = order[at] == terms
                df += np.bincount(at[hit], n[hit], len(order)).astype(np.int64)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some]), pa.int64()), pa.array(np.concatenate([[docs, length], df[some]]), pa.int64())], names=["what", "n"])

    return scan


def _bounds(block: pa.RecordBatch, row: int, items: _Items) -> Iterator[tuple[int, np.ndarray]]:
    """Upper bounds of the scores of a block's documents, item by item."""
    lengths, width = block.column("lengths")[row].values.to_numpy(), block.column("width")[row].as_py()
    slices = np.frombuffer(block.column("slices")[row].as_buffer(), np.uint8).reshape(width, -1)
    most = np.append(LEVELS[1:] - 1, np.iinfo(np.int32).max)
    shares = np.zeros((len(LEVELS) + 1, len(lengths)), dtype=np.int64)
    for level, up in enumerate(most):
        shares[level + 1] = items.shares(np.minimum(up, lengths), lengths)
    may = np.bitwise_and.reduce(slices[_bits(items.terms, 0, width)], axis=1)
    useful = may.any(axis=1) & (items.weights > 0)
    for i in range(len(items.ids)):
        own = slice(items.first[i], items.first[i + 1])
        keep = useful[items.of[own]]
        of, times = items.of[own][keep], items.times[own][keep]
        if not len(of):
            continue
        held = may[of]
        level = np.unpackbits(held, axis=1)[:, : len(lengths)].astype(np.int64)
        up, live = 1, np.arange(len(of))
        while up < len(LEVELS):
            held = held & np.bitwise_and.reduce(slices[_bits(items.terms[of[live]], up, width)], axis=1)
            some = held.any(axis=1)
            live, held = live[some], held[some]
            if not len(live):
                break
            level[live] += np.unpackbits(held, axis=1)[:, : len(lengths)]
            up += 1
        yield i, (items.weights[of] * times) @ shares[level, np.arange(len(lengths))]


def _best_bounds(items: _Items, k: int):
    """The k documents of the highest bounds of each item, of a task's blocks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, md5s = batch.column("doc_ids")[row].as_py(), batch.column("md5s")[row].as_py()
                for i, bound in _bounds(batch, row, items):
                    top = np.argsort(-bound, kind="stable")[:k]
                    mine = best.setdefault(i, [])
                    mine += [(int(bound[j]), ids[j], md5s[j]) for j in top.tolist() if bound[j] > 0]
                    best[i] = heapq.nlargest(k, mine, key=lambda x: x[0])
        out = [(i, *x) for i, mine in best.items() for x in mine]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["item", "bound", "doc_id", "text_md5"])

    return scan


def _reaching(items: _Items, least: np.ndarray):
    """All documents whose bound reaches what their item's answer reaches."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = [(i, np.flatnonzero(bound >= max(least[i], 1))) for i, bound in _bounds(batch, row, items)]
                at = pa.array(np.concatenate([x for _, x in found]) if found else [], pa.int64())
                item = pa.array(np.concatenate([np.full(len(x), i) for i, x in found]) if found else [], pa.int64())
                yield pa.RecordBatch.from_arrays([item, batch.column("doc_ids")[row].values.take(at), batch.column("md5s")[row].values.take(at)], names=["item", "doc_id", "text_md5"])

    return scan


def _score(items: _Items, k: int):
    """Exact scores of documents for the items that they are candidates of; the best k of each item are kept."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in batches:
            ids, row = batch.column("doc_id"), 0
            for t in _chunks(batch.column("text")):
                h, owner, count = _terms(t)
                edge = np.searchsorted(owner, np.arange(len(t.first)))
                for d, n in enumerate(t.n_words.tolist()):
                    own = slice(edge[d], edge[d + 1])
                    at = np.minimum(np.searchsorted(h[own], items.terms), n and edge[d + 1] - edge[d] - 1)
                    tf = np.where(h[own][at] == items.terms, count[own][at], 0) if n else np.zeros(len(items.terms), np.int64)
                    share = items.weights * items.shares(tf, n)
                    doc = ids[row + d].as_py()
                    for i in batch.column("items")[row + d].as_py():
                        score = int(share[items.of[items.first[i] : items.first[i + 1]]] @ items.times[items.first[i] : items.first[i + 1]])
                        if score > 0:
                            mine = best.setdefault(i, [])
                            mine.append((-score, doc is not None, doc or 0))
                            if len(mine) > 4 * k:
                                best[i] = heapq.nsmallest(k, mine)
                row += len(t.n_words)
        out = [(i, doc if known else None, -score) for i, mine in best.items() for score, known, doc in heapq.nsmallest(k, mine)]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["item", "doc_id", "score"])

    return scan


def _exact(texts: DataFrame, candidates: DataFrame, items: _Items, k: int) -> DataFrame:
    """item, doc_id, score, rank: the k best of each item's candidates."""
    asked = cut(candidates.groupBy("doc_id", "text_md5").agg(F.collect_set("item").alias("items")), "asked")  # at most a group's items
    asked = F.broadcast(asked) if asked.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS else asked
    other = asked.select(F.col("doc_id").alias("other"), F.col("text_md5").alias("md5"), "items")
    pairs = texts.join(other, F.col("doc_id").eqNullSafe(F.col("other")) & (F.col("text_md5") == F.col("md5")))
    scored = pairs.select("doc_id", "text", "items").mapInArrow(_score(items, k), "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)  # k of each task and item meet


def _weighted(signatures: DataFrame, items: _Items) -> bool:
    """Fill in the figures of the corpus; whether any item can have an answer."""
    found = signatures.select("lengths", "terms", "df").mapInArrow(_counts(items.terms), "what long, n long").groupBy("what").agg(F.sum("n").alias("n"))
    n = {r["what"]: r["n"] for r in found.collect()}  # a number for each term of the group
    items.n_docs, items.n_terms = n.get(-2, 0), n.get(-1, 0)
    weight = lambda df: math.floor(1000 * math.log((2 * items.n_docs + 2) / (2 * df + 1))) if df else 0
    items.weights = np.array([weight(n.get(i, 0)) for i in range(len(items.terms))], dtype=np.int64)
    return bool((items.weights > 0).any())


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", signatures: DataFrame | None = None) -> DataFrame:
    """The k documents of the highest scores for each item: item_col, rank (from 1), doc_id, score.

    signatures: index(docs), if it is there."""
    spark = docs.sparkSession
    own = signatures is None
    signatures = index(docs, id_col, text_col) if own else signatures
    texts = keyed(docs, id_col, text_col)
    schema = items.select(F.col(item_col).alias("id")).schema.simpleString()[7:-1].replace("id:", f"`{item_col}` ", 1)
    out = spark.createDataFrame([], f"{schema}, rank int, doc_id long, score long")
    for group in _groups(items, item_col, item_text_col):
        if not len(group.terms) or not _weighted(signatures, group):
            continue
        slices = signatures.select("doc_ids", "md5s", "lengths", "width", "slices")
        bounds = slices.mapInArrow(_best_bounds(group, k), "item long, bound long, doc_id long, text_md5 binary")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id", "text_md5"))
        top = bounds.withColumn("place", place).where(F.col("place") <= k)
        least = np.zeros(len(group.ids), dtype=np.int64)
        for r in _exact(texts, top, group, k).where(F.col("rank") == k).collect():  # one row an item
            least[r["item"]] = r["score"]
        near = slices.mapInArrow(_reaching(group, least), "item long, doc_id long, text_md5 binary")
        found = cut(_exact(texts, near, group, k), "ranked")
        named = spark.createDataFrame([(i, x) for i, x in enumerate(group.ids)], f"item long, {schema}")
        out = out.unionByName(found.join(F.broadcast(named), "item").select(item_col, F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if own:
        drop(signatures)
    return out
