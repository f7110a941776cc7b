"""Language ID by error-correcting output codes over byte n-gram classifiers.

Each language has a codeword of +1 and -1; each position is a binary linear classifier over hashed byte 2- and 3-grams
of the lower-cased text (log odds of the smoothed n-gram distributions of the languages on either side). A text's margin
per position is the mean log odds of its n-grams; decoding takes the codeword of least exponential loss, each position
weighted by the least margin that it reaches on a training language. Up to seven languages have the exhaustive code,
more have random columns from a hash, drawn again until any two codewords differ in a quarter of them.

Training counts n-grams of every labelled row; what comes to the driver is languages x DIMENSIONS counts, and the model
is as large, so it can be broadcast. More than MAX_LANGUAGES labels are an error: nothing is dropped.

Defined results: a null text or one without a letter is `und` with score 0; with no labelled rows everything is `und`;
with one language every text with a letter is that language, score 1; null labels teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm import words
from ferryline.llm.shared import bounded_batches

DIMENSIONS = 1 << 14
MAX_LANGUAGES = 256
SMOOTHING = 0.5
SHARPNESS = 1.0
AMBIGUOUS = 0.2
UNKNOWN = "und"


def ngrams(t: words.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 2- and 3-grams of the texts' bytes and their texts; all ASCII that is no letter is a space."""
    flat = _FOLD[t.data].astype(np.uint32)
    size = np.diff(t.edge)
    owner = np.repeat(np.arange(len(size)), size)
    out, who = [], []
    for n, salt in ((2, 0x2545F491), (3, 0x9E3779B1)):
        if len(flat) < n:
            continue
        code = np.zeros(len(flat) - n + 1, dtype=np.uint32)
        for k in range(n):
            code = code * np.uint32(257) + flat[k : len(flat) - n + 1 + k]
        inside = owner[: len(code)] == owner[n - 1 :]
        out.append(((code * np.uint32(salt)) >> np.uint32(18))[inside])
        who.append(owner[: len(code)][inside])
    return (np.concatenate(out), np.concatenate(who)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for t in words.texts(batch.column("text")):
            code, who = ngrams(t)
            named = langs[t.rows]
            for lang in set(named.tolist()):
                mine = np.bincount(code[(named == lang)[who]], minlength=DIMENSIONS)
                totals[lang] = totals.get(lang, 0) + mine
    for lang, n in totals.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "feature", "n"])


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1 that differ pairwise; columns are never constant."""
    if k <= 7:
        cols = [[1, *(1 if (c >> i) & 1 else -1 for i in range(k - 1))] for c in range(2 ** (k - 1) - 1)]
    else:
        n, least, seed = int(np.ceil(10 * np.log2(k))), 0, 0
        while 4 * least < n:  # of random codewords any two differ in nearly half of the columns
            bits = words.mix(np.arange(1, 1 + k * n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) & np.uint64(1)
            cols, seed = [c for c in (bits.reshape(-1, k).astype(int) * 2 - 1).tolist() if abs(sum(c)) < k], seed + 1
            rows = np.array(cols, dtype=np.int64).T
            least = int((len(cols) - rows @ rows.T)[~np.eye(k, dtype=bool)].min()) // 2
    return np.array(cols, dtype=np.int8).T.reshape(k, -1)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss of each codeword (columns) for each text's margins (rows)."""
        return np.exp(np.clip(-SHARPNESS * margins[:, None, :] * self.code[None, :, :], -30, 30)) @ self.trust


def train(docs: DataFrame, labelled: Column, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of the languages of the rows where `labelled` holds and lang_col is not null."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(labelled & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.lower(F.col(text_col).cast("string")).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").agg(F.collect_list(F.struct("feature", "n")).alias("counts")).limit(MAX_LANGUAGES + 1).toArrow().sort_by("lang")
    if found.num_rows > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = found["lang"].to_pylist()
    share = np.full((len(names), DIMENSIONS), SMOOTHING)
    for row, x in zip(share, found["counts"], strict=True):
        row[x.values.field("feature").to_numpy()] += x.values.field("n").to_numpy()
    share /= share.sum(axis=1, keepdims=True)
    code = codewords(len(names)) if names else np.zeros((0, 0), np.int8)
    weights = np.zeros((DIMENSIONS, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        weights[:, b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    trust = np.abs(share @ weights).min(axis=0) if names else np.zeros(0)
    return Model(names, code, weights, trust / max(trust.sum(), 1e-12))


def _predict(model: Model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            has = batch.column("letters").to_numpy(zero_copy_only=False)
            picked, score, doubt = [], [], []
            for t in words.texts(batch.column("text")):
                n = len(t.edge) - 1
                code, who = ngrams(t)
                margins = np.zeros((n, model.code.shape[1]))
                for b in range(model.code.shape[1]):
                    margins[:, b] = np.bincount(who, weights=model.weights[code, b], minlength=n)
                margins /= np.maximum(np.bincount(who, minlength=n), 1)[:, None]
                loss = model.losses(margins)
                sure = np.exp(-loss) / np.exp(-loss).sum(axis=1, keepdims=True) if len(model.languages) else np.zeros((n, 1))
                best = sure.argmax(axis=1)
                top = np.sort(sure, axis=1)[:, ::-1]
                ok = has[t.rows].astype(bool) & (len(model.languages) > 0)
                picked.append(np.where(ok, best, len(names) - 1))
                score.append(np.where(ok, top[:, 0], 0.0))
                doubt.append(ok & (top.shape[1] > 1) & (top[:, 0] - top[:, min(1, top.shape[1] - 1)] < AMBIGUOUS))
            flat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
            lang = pa.array(names[np.concatenate(picked)] if picked else [], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lang, flat(score, pa.float64()), flat(doubt, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return scan


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (0 to 1), ambiguous."""
    bounded_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text).alias("text"), letters.alias("letters"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, ambiguous boolean")
