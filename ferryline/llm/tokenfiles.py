"""Token-ID output: Parquet files of token lists in ascending id order, and reads of them.

The corpus is range-partitioned and sorted by id, encoded with a tokenizers file, and written by Spark: ids are
dictionary-encoded lists, counts and ids of rows delta-encoded (writer version 2), with set row groups and pages and the
column and offset indexes that Parquet then carries. `tokens` reads rows and columns selectively; `token_rows` gives
each row's place in the token stream.

Encoding shares work between equal pieces of text. A text is cut at single spaces between two characters that are no
white space: the byte-level pre-tokenizer always starts a token there, so pieces can be encoded apart, each distinct one
once in a while, by the library itself.

Defined results: a null text is empty and has the end id alone; rows equal in id follow each other in the order of their
texts; null ids come first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferryline.llm import words
from ferryline.llm.shared import bounded_batches, new_path

END_ID = 0
ROW_GROUP_BYTES, PAGE_BYTES = 16 << 20, 256 << 10
#: Slots of a worker's memory of pieces (half of them are filled), tails remembered, and words encoded in one string.
MEMORY_BITS, TAILS, JOINED = 21, 1 << 16, 64
#: Lead bytes of the multi-byte characters that are white space.
_WIDE = np.zeros(256, dtype=bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_tokenizers: dict[str, object] = {}
_encoders: dict[str, Encoder] = {}


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """s, s + 1, ... s + n - 1 of each pair, one after another."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[s:s+n] of each pair, one after another."""
    return flat[spread(start, length)] if len(length) else flat[:0]


def _tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _alphabet() -> np.ndarray:
    """The character that the byte-level alphabet has for each byte: its own if it can be seen, else one from 256 on; then a space."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.full(257, 32, dtype="<u4")
    out[seen] = seen
    rest = [b for b in range(256) if b not in seen]
    out[rest] = 256 + np.arange(len(rest))
    return out


def pieces(data: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts data[edge[i]:edge[i + 1]], text starts included."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    if n > 2:
        at = np.flatnonzero(data[1:-1] == 32) + 1
        wide = _WIDE[data]
        ok = (data[at - 1] > 32) & (data[at + 1] > 32) & ~wide[at + 1]
        ok &= ~((data[at - 1] >= 0x80) & (wide[np.maximum(at - 2, 0)] | wide[np.maximum(at - 3, 0)]))
        cut[at[ok]] = True
    cut[edge] = True
    return np.flatnonzero(cut[:n])


def _letter_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which spans are a space or none, letters of ASCII or U+00C0 to U+023F, and then nothing or an ASCII character that
    is no letter; and where the letters end."""
    wide = (data >= 0xC3) & (data <= 0xC8)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    letter[1:] |= wide[:-1] & (data[1:] >= 0x80) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    letter[:-1] |= wide[:-1] & letter[1:] & (data[1:] >= 0x80)
    other = np.append(np.flatnonzero(~letter), len(data))
    begin = np.minimum(start + (data[start] == 32), end)
    stop = np.minimum(other[np.searchsorted(other, begin)], end)
    return (stop > begin) & ((stop == end) | (data[np.minimum(stop, len(data) - 1)] < 0x80)), stop


class Memory:
    """Ids of pieces by two 64-bit hashes: a hash table with linear probing that doubles up to 2**MEMORY_BITS slots."""

    def __init__(self, bits: int = 16):
        self.bits, self.n, self.used = bits, 0, 0
        self.keys, self.checks = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.begin, self.length = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.flat = np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where there is none. Keys are not 0."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(open_):
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = at[hit]
            more = ~hit & (found != 0)
            open_, at = open_[more], (at[more] + 1) & (len(self.keys) - 1)
        return out

    def _place(self, keys: np.ndarray, checks: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        at, left = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]  # of keys that meet in a slot one stays
            won = self.keys[at] == keys[left]
            slot, who = at[won], left[won]
            self.checks[slot], self.begin[slot], self.length[slot] = checks[who], begin[who], length[who]
            left, at = left[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def add(self, keys: np.ndarray, checks: np.ndarray, flat: np.ndarray, length: np.ndarray) -> None:
        """Put in distinct keys that are not there yet."""
        while 2 * (self.n + len(keys)) > len(self.keys):
            old = np.flatnonzero(self.keys)
            rows = [x[old] for x in (self.keys, self.checks, self.begin, self.length)]
            self.bits += 1
            self.keys, self.checks = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
            self.begin, self.length = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
            self._place(*rows)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self._place(keys, checks, self.used + np.cumsum(length) - length, length)
        self.flat[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(keys), self.used + len(flat)


class Encoder:
    """Encodes texts piece by piece and remembers distinct pieces for as long as the worker lives."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():  # the byte alphabet has one character for each byte
            self.width[i] = len(token)
        if any(t.content[:1].isalpha() or " " in t.content for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("an added token begins with a letter or holds a space")
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        if hasattr(self.words.model, "_resize_cache"):  # not in all versions; the memory below is larger
            self.words.model._resize_cache(0)
        self.alphabet = _alphabet()
        self.memory, self.tails = Memory(), {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of spans that are each one word of the pre-tokenizer: many to a string of the model's alphabet,
        which has no white space; their tokens are told apart by the bytes that each token stands for."""
        size = end - start
        mark = np.cumsum(size + 1) - 1
        row = np.full(len(start) + int(size.sum()), 256, dtype=np.int64)
        row[spread(mark - size, size)] = gather(data, start, size)
        text = self.alphabet[row].tobytes().decode("utf-32-le")
        edge = [0, *(mark[JOINED - 1 :: JOINED] + 1).tolist(), len(text)]
        coded = self.words.encode_batch_fast([text[a:b] for a, b in zip(edge, edge[1:], strict=False)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x.ids for x in coded), np.int32)
        return ids, np.diff(np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size), "right"), prepend=0)

    def _new(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of pieces: of their runs of letters, and of what follows the runs, equal tails once."""
        raw, (plain, stop) = data.tobytes(), _letter_runs(data, start, end)
        stop = np.where(plain, stop, start)
        if len(self.tails) > TAILS:
            self.tails.clear()
        tailed = np.flatnonzero(stop < end)
        tails = [raw[a:b] for a, b in zip(stop[tailed].tolist(), end[tailed].tolist(), strict=True)]
        unseen = list({t for t in tails if t not in self.tails})
        self.tails.update(zip(unseen, self._ids([t.decode() for t in unseen]), strict=True))
        found = [self.tails[t] for t in tails]
        words_at = np.flatnonzero(plain)
        head, n = self._words(data, start[words_at], stop[words_at])
        before, after = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        before[words_at], after[tailed] = n, np.fromiter(map(len, found), np.int64, len(found))
        length = before + after
        at = np.cumsum(length) - length
        flat = np.empty(int(length.sum()), np.int32)
        flat[spread(at, before)] = head
        flat[spread(at + before, after)] = np.fromiter(chain.from_iterable(found), np.int32, int(after.sum()))
        return flat, length

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and the number of ids of each text."""
        out, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for t in words.texts(column):
            start = pieces(t.data, t.edge)
            end = np.append(start[1:], len(t.data))[: len(start)]
            value = words.BYTE_VALUES[t.data]
            keys = words.spans_hash(value, start, end, words.WORD_BASE) | np.uint64(1)
            checks = words.spans_hash(value, start, end, words.WINDOW_BASE)
            if self.memory.n > 1 << (MEMORY_BITS - 1):
                self.memory = Memory()
            slot = self.memory.find(keys)
            unknown, known = np.flatnonzero(slot < 0), slot >= 0
            fresh, first, which = np.unique(keys[unknown], return_index=True, return_inverse=True)
            first = unknown[first]
            if (checks[unknown] != checks[first][which]).any() or (self.memory.checks[slot[known]] != checks[known]).any():  # two pieces under one hash
                flat, length = self._new(t.data, start, end)
                out.append(flat)
            else:
                self.memory.add(fresh, checks[first], *self._new(t.data, start[first], end[first]))
                slot = self.memory.find(keys) if len(fresh) else slot
                length = self.memory.length[slot].astype(np.int64)
                out.append(gather(self.memory.flat, self.memory.begin[slot].astype(np.int64), length))
            total = np.concatenate([[0], np.cumsum(length)])
            counts.append(np.diff(total[np.searchsorted(start, t.edge)]))
        return np.concatenate(out), np.concatenate(counts)


def _encoder(path: str) -> Encoder:
    """The worker's encoder: later tasks find the pieces of earlier ones."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode(path: str, end_id: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for whole in batches:
            size = pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False)
            block = np.cumsum(size, dtype=np.int64) // (4 * words.CHUNK_BYTES)
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(whole)] if len(whole) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                batch = whole.slice(a, b - a)
                ids, n = encoder(batch.column("text"))
                offset = np.concatenate([[0], np.cumsum(n + 1)])
                full = np.full(int(offset[-1]), end_id, dtype=np.int32)
                mine = np.ones(len(full), dtype=bool)
                mine[offset[1:] - 1] = False
                full[mine] = ids
                lists = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(full))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n + 1, pa.int64()), lists], names=["doc_id", "n_tokens", "ids"])

    return scan


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write doc_id, n_tokens, ids, part and pos (place in the part) in ascending id order; parts follow each other.

    Rows of one id stay in the order of their places in the input, which deal them to parts, however many they are."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    coded = dealt.mapInArrow(_encode(tokenizer, end_id), "doc_id long, n_tokens long, ids array<int>")
    part = F.spark_partition_id()
    pos = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    options = {"parquet.writer.version": "v2", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.enable.dictionary": "true", "compression": "zstd"}
    coded.select("doc_id", "n_tokens", "ids", part.alias("part"), pos.alias("pos")).write.options(**options).parquet(path)


def tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offset, flat = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy().astype("<u4"))
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(offset[:-1], offset[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "pos")), pa.array(np.diff(offset), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "pos", "n_tokens", "ids_crc32"])


def token_rows(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, from the files. Sums per part are as many rows as parts."""
    bounded_batches(spark)
    read = tokens(spark, path)
    rows = read.select("doc_id", "part", "pos", "ids").mapInArrow(_crc, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = read.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("offset"))
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("pos"))), F.lit(0)))
    return placed.join(F.broadcast(parts), "part").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def written(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write docs to the shared folder and read each row's place and checksum back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, id_col, text_col, end_id)
    return token_rows(spark, path)
