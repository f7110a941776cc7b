"""Tables written to the folder that driver and executors share, to cut lineage between jobs."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_noted = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder where that is unset and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or f"{tempfile.gettempdir()}/checkpoints").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ferryline/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later jobs restart from the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if getattr(_noted, "paths", None) is not None:
        _noted.paths.append(path)
    return out


def cut_counting(df: DataFrame, name: str, which: str = "true") -> tuple[DataFrame, int]:
    """cut(df), and how many of its rows hold `which`: counted while they are written, by no job of its own. A task that
    runs again may count twice, so only zero is exact."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.when(F.expr(which), F.lit(1))).alias("n")), name)
    return out, seen.get["n"]


def drop(*tables: DataFrame) -> None:
    """Remove the files of cut tables that nothing reads any more, DataFrames not yet run included."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextmanager
def noted() -> Iterator[list[str]]:
    """Paths of the tables that cut() writes in this thread meanwhile."""
    outer, _noted.paths = getattr(_noted, "paths", None), []
    try:
        yield _noted.paths
    finally:
        _noted.paths = outer


def drop_unread(paths: list[str], reader: DataFrame) -> None:
    """Remove tables whose only reader left is `reader`, except those that it does read. Paths already gone are no error."""
    read = {f.rsplit("/", 2)[-2] for f in reader.inputFiles()} if paths else set()
    for path in paths:
        if path.rsplit("/", 1)[-1] not in read:
            _delete(reader.sparkSession, path)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores in front, as many as keep them apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


#: Rows of an Arrow batch between Spark and Python: rows here are whole texts or packed blocks.
BATCH_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS, so that a batch of long texts stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_md5 and text of each row; the first two name a text even where ids repeat."""
    bounded_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_md5"), text.alias("text"))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; FERRYLINE_TOKENIZERS names another folder."""
    folder = os.environ.get("FERRYLINE_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
