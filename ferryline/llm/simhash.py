"""SimHash near-dedup: 64-bit fingerprints that meet by Golay-code fuzzy hashing.

A text, A-Z in lower case, has the 3-word shingles of its words `[^\\x20\\x09-\\x0D]+`, repeats included, space-joined (all
its words, if fewer). A fingerprint bit is 1 if it is set in over half of the shingles' XXH64 (seed 42). Fingerprints link at
2 or fewer differing bits; a component is connected by links.

A fingerprint is cut into segments of 22, 21 and 21 bits. Of two wrong bits at least one segment has none, and of the
three choices of (clean segment, the one after it) at least one has at most one wrong bit in the latter. That one is
decoded, padded to 23 bits, by the binary Golay code: every word lies within 3 bits of one codeword, so words one bit
apart are both within 4 bits of a codeword. The keys of a segment are all codewords that near: one, or six if the nearest
is 3 away. So any two fingerprints that link share a key (segment, its bits, codeword index), and about 16 keys a
fingerprint make buckets of 33 bits. Pairs of a bucket are verified by their bits.

Buckets of more than BUCKET fingerprints list no pairs. Their fingerprints are listed once for each fingerprint one bit
away (and as they are): two of them link exactly if they meet there, and what meets there, 65 at most, is all linked, so
links to the least are enough.

Only distinct fingerprints are compared; rows of equal fingerprints share a component without any link.

Defined results: a null text is empty; a text without words has fingerprint zero, linked like any other. Rows without an
id, and rows that share one, are rows like others: they link by their fingerprints only, and component_id is the least id
of the component that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm import words
from ferryline.llm.neardup import components
from ferryline.llm.shared import bounded_batches, cut, drop

SHINGLE, SEED = 3, 42
#: Start and width of each segment, from the lowest bit.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
#: Most fingerprints of a bucket whose pairs are verified.
BUCKET = 32
#: Shingles hashed at a time.
BLOCK = 1 << 16
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the 12 data bits, and by syndrome: the data bits of the error, and those that lead from the nearest
    codeword to the five others within 4 bits (-1 where there are none)."""

    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY << (i - 11)
        return x

    parity = np.array([remainder(d << 11) for d in range(1 << 12)])
    error = np.zeros(1 << 11, dtype=np.int64)
    places = {}
    for weight in range(4):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            places[bits] = s = remainder(e)
            error[s] = e >> 11
    near = np.full((1 << 11, 5), -1, dtype=np.int64)
    filled = np.zeros(1 << 11, dtype=np.int64)
    for d in range(1 << 12):
        codeword = d << 11 | int(parity[d])
        if codeword.bit_count() == 7:
            for bits in combinations([b for b in range(23) if codeword >> b & 1], 3):
                s = places[bits]
                near[s, filled[s]] = d
                filled[s] += 1
    return parity, error, near


PARITY, ERROR, NEAR = _golay()


def codewords(word: np.ndarray) -> np.ndarray:
    """Indices of the codewords within 4 bits of 23-bit words: one column, and five more that may be -1."""
    data = word >> 11
    syndrome = PARITY[data] ^ (word & 0x7FF)
    nearest = data ^ ERROR[syndrome]
    others = NEAR[syndrome]
    return np.concatenate([nearest[:, None], np.where(others < 0, -1, nearest[:, None] ^ others)], axis=1)


def keys(fingerprints: np.ndarray) -> np.ndarray:
    """Bucket keys of unsigned fingerprints: three times six columns, -1 where there is none."""
    parts = [((fingerprints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    out = []
    for i, clean in enumerate(parts):
        index = codewords(parts[(i + 1) % 3])
        out.append(np.where(index < 0, -1, (i << 34) | (clean[:, None] << 12) | index))
    return np.concatenate(out, axis=1)


def fingerprints(t: words.Texts, k: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text of a chunk."""
    n_texts, size = len(t.first) - 1, t.end - t.start + 1
    at = np.cumsum(size) - size
    joined = words.LOWER[t.data[np.minimum(np.repeat(t.start - at, size) + np.arange(int(size.sum())), max(len(t.data) - 1, 0))]] if len(size) else np.zeros(0, np.uint8)
    if len(size):
        joined[at + size - 1] = 32
    text = joined.tobytes()
    n_words = t.n_words
    count = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(n_texts), count)
    begin = np.repeat(t.first[:-1] - (np.cumsum(count) - count), count) + np.arange(len(owner))
    until = begin + np.minimum(n_words[owner], k) - 1
    a, b = at[begin], at[until] + size[until] - 1
    bits = np.zeros((n_texts, 64), dtype=np.int64)
    for i in range(0, len(owner), BLOCK):
        spans = zip(a[i : i + BLOCK].tolist(), b[i : i + BLOCK].tolist(), strict=True)
        h = np.fromiter((xxhash.xxh64_intdigest(text[x:y], SEED) for x, y in spans), dtype="<u8")
        own = owner[i : i + BLOCK]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        bits[own[first]] += np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), first, axis=0, dtype=np.int64)
    return np.packbits(2 * bits > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _sign(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(t, k) for t in words.texts(batch.column("text"))]
            all_ = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(all_.astype(np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return scan


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        found = keys(fp.view(np.uint64))
        row, column = np.nonzero(found >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(found[row, column]), pa.array(fp[row])], names=["key", "fp"])


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): pairs of distinct fingerprints `fp` at most 2 bits apart, as many as connect all that are linked."""
    keyed = cut(prints.select("fp").mapInArrow(_keyed, "key long, fp long"), "keys")
    sized = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    small = keyed.join(sized.where(F.col("n") <= bucket).select("key"), "key")
    x, y = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    pairs = x.join(y, "key").where(near).select("a", "b")
    # Hot buckets: all that a fingerprint one bit away is near to is linked.
    hot = keyed.join(sized.where(F.col("n") > bucket).select("key"), "key").select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = hot.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("hub"))
    met = around.groupBy("hub").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    out = cut(pairs.unionByName(stars).distinct(), "links")
    drop(keyed, sized)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(rows.mapInArrow(_sign(shingle), "doc_id long, fp long"), "fingerprints")
    prints = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = links(prints)
    named = prints.withColumnRenamed("first", "component_id")
    if not found.isEmpty():
        labels = components(found).withColumnRenamed("node", "fp")
        own = prints.join(labels, "fp")
        least = own.groupBy("label").agg(F.min("first").alias("component_id"))
        changed = own.join(least, "label").select("fp", F.col("component_id").alias("least"))
        named = prints.join(changed, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    named = cut(named, "components")
    drop(found, prints)
    return signed.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
