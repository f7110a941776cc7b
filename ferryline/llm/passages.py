"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is `window` consecutive words of one document. A word goes if it lies in a window whose word sequence also
starts in a document with a smaller id. Steps, each a Spark job over files in the shared folder:

1. One scan hashes every 20-word run and keeps, per document, the minimum over each window (the window's anchor).
   Equal windows have equal anchors, so a window whose anchor is in one document only is already counted: once.
2. Equal texts are one text; anchors are counted over distinct texts (map-side minimum and maximum of the id).
3. Documents with a shared anchor are hashed again, and every window under a shared anchor is counted: the smallest
   id of each window hash. The pair (window hash, anchor) makes 128 bits.
4. Windows found in a smaller id come back to their document and merge into maximal removal intervals.

repeated_passages() reports the intervals and the kept words; remove_passages() cuts them out of the texts and leaves
lines and spaces around them as they are.

Defined results: a null text has no words; null ids neither remove nor lose anything; rows equal in id and text get
the same result; texts shorter than a window stay whole; column names of the input other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm import words
from ferryline.llm.shared import cut, drop, fresh_names, keyed

WINDOW = 50
ANCHOR = 20
_KEY = ["doc_id", "text_md5"]


def _anchors(t: words.Texts, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, their texts, and for every window its start and anchor."""
    values, owner = t.word_hashes(), t.text_of_word()
    n = len(values) - window + 1
    if n <= 0:
        return values, owner, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    every = words.spans_hash(values, np.arange(len(values) - run + 1), np.arange(run, len(values) + 1), words.WINDOW_BASE)
    low = words.sliding_min(every, window - run + 1)[:n]
    at = np.flatnonzero(owner[:n] == owner[window - 1 :])
    return values, owner, at, low[at]


def _profile(window: int, run: int):
    import hashlib

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, digest, anchors = [], [], []
            for t in words.texts(batch.column("text")):
                _, owner, at, low = _anchors(t, window, run)
                new = np.ones(len(at), dtype=bool)
                new[1:] = (low[1:] != low[:-1]) | (owner[at][1:] != owner[at][:-1])
                low, whose = low[new], owner[at[new]]
                edge = np.searchsorted(whose, np.arange(len(t.first)))
                n_words.append(t.n_words)
                for i in range(len(t.first) - 1):
                    digest.append(hashlib.sha256(t.joined(i)).hexdigest())
                    anchors.append(words.signed(np.unique(low[edge[i] : edge[i + 1]])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_md5"), pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(digest, pa.string()), pa.array(anchors, pa.list_(pa.int64()))],
                names=["doc_id", "text_md5", "n_words", "words_sha256", "anchors"],
            )

    return scan


def _windows(window: int, run: int, column: str):
    """Rows (hash, anchor, doc_id, text_md5, start) of the windows whose anchor is in the list of that name."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            for t in words.texts(batch.column("text")):
                values, owner, at, low = _anchors(t, window, run)
                edge = np.searchsorted(owner[at], np.arange(len(t.first)))
                hit = np.zeros(len(at), dtype=bool)
                for i in range(len(t.first) - 1):
                    wanted = lists[t.rows.start + i]
                    if wanted.is_valid and len(wanted) and edge[i] < edge[i + 1]:
                        hit[edge[i] : edge[i + 1]] = np.isin(words.signed(low[edge[i] : edge[i + 1]]), wanted.values.to_numpy())
                at, low = at[hit], low[hit]
                row = pa.array(owner[at] + t.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.signed(words.spans_hash(values, at, at + window, words.WORD_BASE))), pa.array(words.signed(low)), batch.column("doc_id").take(row), batch.column("text_md5").take(row), pa.array((at - t.first[owner[at]]).astype(np.int32))],
                    names=["hash", "anchor", "doc_id", "text_md5", "start"],
                )

    return scan


def _intervals(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 words of the maximal runs that windows at these starts cover."""
    s = np.sort(starts)
    gap = np.flatnonzero(np.diff(s) > window)
    return s[np.r_[0, gap + 1]], s[np.r_[gap, len(s) - 1]] + window


def _merge(window: int):
    """Removal intervals and kept words of each document from the starts of its repeated windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, spans, removed, kept = batch.column("starts"), [], [], []
            for t in words.texts(batch.column("text")):
                for i, n in enumerate(t.n_words):
                    first, last = _intervals(starts[t.rows.start + i].values.to_numpy(), window)
                    mark = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(mark, first, 1)
                    np.add.at(mark, last, -1)
                    keep = np.cumsum(mark[:-1]) == 0
                    spans.append([{"from": int(a), "to": int(b)} for a, b in zip(first, last, strict=True)])
                    removed.append(int(n - keep.sum()))
                    kept.append(t.joined(i, keep).decode("utf-8", "replace"))
            kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_md5"), pa.array(spans, kind), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "text_md5", "spans", "n_removed", "kept_text"])

    return scan


def without(t: words.Texts, i: int, first: np.ndarray, last: np.ndarray) -> bytes:
    """Text i without the words of the intervals. Of the white space before and behind an interval one stays: that before
    it, or that behind it if it breaks a line."""
    low, text = t.first[i], t.data[t.edge[i] : t.edge[i + 1]].tobytes()
    start, end = (x[low : t.first[i + 1]] - t.edge[i] for x in (t.start, t.end))
    out, at = [], 0
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        behind = int(start[b]) if b < len(start) else len(text)
        if a and (b == len(start) or b"\n" in text[end[b - 1] : behind]):
            out.append(text[at : end[a - 1]])
            at = int(end[b - 1])
        else:
            out.append(text[at : start[a]])
            at = behind
    return b"".join([*out, text[at:]])


def _without(window: int, text: str, starts: str):
    """Batches with the repeated windows cut out of their texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, place = batch.column(starts), batch.schema.get_field_index(text)
            hit = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            columns = list(batch.columns)
            if len(hit):
                new = columns[place].to_pylist()
                for t in words.texts(columns[place].take(pa.array(hit))):
                    for i in range(len(t.first) - 1):
                        row = hit[t.rows.start + i]
                        new[row] = without(t, i, *_intervals(lists[row].values.to_numpy(), window)).decode()
                columns[place] = pa.array(new, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return scan


def _repeats(rows: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cut tables: profile of each row; keys of texts that a smaller id has too; the texts with windows that may repeat;
    starts of the windows that a smaller id has."""
    run = min(ANCHOR, window)
    profile = cut(rows.mapInArrow(_profile(window, run), "doc_id long, text_md5 binary, n_words long, words_sha256 string, anchors array<bigint>"), "passages-profile")
    known = profile.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    rep = cut(known.groupBy("text_md5").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").select("text_md5", "rep"), "passages-texts")
    copies = cut(known.select(*_KEY).join(rep, "text_md5").where("doc_id > rep").select(*_KEY).distinct(), "passages-copies")

    firsts = known.join(rep, "text_md5", "left").where("rep is null or rep = doc_id").select("doc_id", "text_md5", F.explode("anchors").alias("anchor"))
    shared = cut(firsts.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"), "passages-anchors")
    lists = firsts.join(shared, "anchor").groupBy(*_KEY).agg(
        F.collect_set(F.when(F.col("low") < F.col("doc_id"), F.col("anchor"))).alias("asks"),
        F.collect_set(F.when(F.col("high") > F.col("doc_id"), F.col("anchor"))).alias("tells"),
    )
    some = cut(rows.where(F.col("doc_id").isNotNull()).join(lists, _KEY).dropDuplicates(_KEY), "passages-candidates")
    drop(shared, rep)
    row = "hash long, anchor long, doc_id long, text_md5 binary, start int"
    seen = some.where(F.size("tells") > 0).select(*_KEY, "text", "tells").mapInArrow(_windows(window, run, "tells"), row)
    first_id = cut(seen.groupBy("hash", "anchor").agg(F.min("doc_id").alias("low")), "passages-windows")
    asked = some.where(F.size("asks") > 0).select(*_KEY, "text", "asks").mapInArrow(_windows(window, run, "asks"), row)
    starts = cut(asked.join(first_id, ["hash", "anchor"]).where("low < doc_id").groupBy(*_KEY).agg(F.collect_list("start").alias("starts")), "passages-starts")
    drop(first_id)
    return profile, copies, some, starts


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, text_md5, n_words, words_sha256 (of all its words joined by a space), spans
    (array of {from, to} word positions to remove), n_removed, kept_text (its words joined by a space; null where nothing
    is removed)."""
    profile, copies, some, starts = _repeats(keyed(docs, id_col, text_col), window)
    merged = some.select(*_KEY, "text").join(starts, _KEY).mapInArrow(_merge(window), "doc_id long, text_md5 binary, spans array<struct<from:int,to:int>>, n_removed long, kept_text string")
    gone = copies.select(*_KEY, F.lit(True).alias("copy"))
    out = profile.drop("anchors").join(merged, _KEY, "left").join(gone, _KEY, "left")
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to")))
    return out.select(
        "doc_id", "text_md5", "n_words", "words_sha256",
        F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<from:int,to:int>>)"))).alias("spans"),
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the repeated passages cut out of text_col, lines and spaces around them kept; documents that this leaves
    without words go. Other texts stay as they are."""
    key, md5, starts, copy, own = fresh_names(docs, "id", "md5", "starts", "copy", "own")
    profile, copies, some, at = _repeats(keyed(docs, id_col, text_col), window)
    found = cut(at.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True), "passages-found")
    drop(profile, some, copies, at)
    found = found.select(F.col("doc_id").alias(key), F.col("text_md5").alias(md5), F.col("starts").alias(starts), F.col("copy").alias(copy))
    text = F.col(text_col).cast("string")
    rows = docs.withColumn(text_col, text).withColumn(own, F.unhex(F.md5(F.coalesce(text, F.lit("")))))
    joined = rows.join(found, (F.col(id_col).cast("long") == F.col(key)) & (F.col(own) == F.col(md5)), "left").where(F.col(copy).isNull() | ~F.col(copy))
    shaped = joined.select(*[F.col(c) for c in docs.columns], starts)
    changed = shaped.mapInArrow(_without(window, text_col, starts), shaped.schema)
    return changed.where(F.col(starts).isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
