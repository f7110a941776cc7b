"""A training corpus from `documents`: rules, near-dedup, substring dedup, mixing, encoding and decoding. Each
stage is an operator of ferryline.llm over all rows that the stage before it kept; stages are cut by Parquet files in the
shared folder. A stage called right after the one before it in STAGES begins by removing the tables that that one left in
the shared folder, those that `docs` reads apart: once its rows are Parquet, nothing else needs them."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.llm import mixing, neardup, passages, pieces, quality
from ferryline.llm.shared import cut, drop, drop_unread, noted, tokenizer_path

#: Sources weigh their bytes to the power ALPHA in the mix, which is as large as what it is drawn from.
ALPHA, EPOCHS, SEED = 0.5, 1.0, 0

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_last = threading.local()


def _tidy(docs: DataFrame, place: int) -> None:
    """Remove what this thread's last stage left and docs does not read, if it is the stage before the one at `place`."""
    if getattr(_last, "place", None) == place - 1:
        drop_unread(_last.paths, docs)
    _last.place, _last.paths = None, []


def _stage(place: int) -> Callable[[Stage], Stage]:
    def wrap(operator: Stage) -> Stage:
        @wraps(operator)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            _tidy(docs, place)
            with noted() as paths:
                out = operator(spark, docs, sf_dir)
            _last.place, _last.paths = place, paths
            return out

        return stage

    return wrap


@_stage(0)
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


@_stage(1)
def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near-duplicates."""
    return neardup.keep_first(docs)


@_stage(2)
def fresh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that a smaller id has; n_chars follows the text."""
    return passages.remove_passages(docs).withColumn("n_chars", F.char_length("text").cast("long"))


@_stage(3)
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents in the target mix of sources, in shuffled order."""
    return mixing.mix(docs, alpha=ALPHA, epochs=EPOCHS, seed=SEED).select(*docs.columns)


@_stage(4)
def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every copy, and whether their text is the copy's."""
    model = pieces.load(tokenizer_path("piece_bpe_32k.model"))
    rows = pieces.decoded(pieces.encoded(docs.select("doc_id", "lang", "source", "text"), model), model)
    round_trip = F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip")
    return rows.select("doc_id", "lang", "source", F.size("piece_ids").alias("n_pieces"), "piece_ids", round_trip)


STAGES = [
    ("quality rules", good),
    ("minhash near-dedup", once),
    ("substring dedup", fresh),
    ("mixing sources to target weights", mixed),
    ("sentencepiece encoding and decoding", coded),
]

#: Signatures, hash order and Viterbi have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"stage{i}")
        drop(before)
    _tidy(docs, len(STAGES))
    return docs
