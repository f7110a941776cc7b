"""Loads in batches that are transactions, over any database that Python's DB-API reaches.

A batch ends after batch_rows rows or batch_bytes bytes. It is committed together with a row of the table `load_batches`:
load, task, batch, rows, bytes. A task that runs again, after an executor is lost or by a later load of the same name, skips
what that table says is committed, so no row is lost or doubled and a load goes on where it stopped. For that the rows are
written to the shared folder first: a task reads the same rows in the same order each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ferryline.sources.sink import cut, is_cut

BATCH_ROWS, BATCH_BYTES = 50_000, 64 << 20
LEDGER = "load_batches"


@dataclass
class Done(WriterCommitMessage):
    rows: int
    batches: int
    skipped: int


def _bytes_of(row: Row) -> int:
    """Size as the batch rule counts it: 4 for null, texts and bytes by length, 16 for the rest."""
    return sum(4 if v is None else len(v.encode()) if isinstance(v, str) else len(v) if isinstance(v, bytes | bytearray) else 16 for v in row)


def batched(rows: Iterator[Row], most_rows: int, most_bytes: int) -> Iterator[tuple[list[Row], int]]:
    batch, size = [], 0
    for r in rows:
        batch.append(r)
        size += _bytes_of(r)
        if len(batch) >= most_rows or size >= most_bytes:
            yield batch, size
            batch, size = [], 0
    if batch:
        yield batch, size


def _plain(v: Any) -> Any:
    return str(v) if isinstance(v, Decimal) else v.isoformat(" ") if isinstance(v, datetime) else v.isoformat() if isinstance(v, date) else v


class BatchWriter(DataSourceWriter):
    def __init__(self, connect: Callable[[], Any], table: str, load: str, columns: list[str], most_rows: int, most_bytes: int):
        self.connect, self.table, self.load, self.columns, self.most_rows, self.most_bytes = connect, table, load, columns, most_rows, most_bytes

    def write(self, iterator: Iterator[Row]) -> Done:
        task = TaskContext.get().partitionId()
        insert = f"insert into {self.table} ({', '.join(self.columns)}) values ({', '.join('?' * len(self.columns))})"
        done, db = Done(0, 0, 0), self.connect()
        try:
            cursor = db.cursor()
            cursor.execute(f"select batch from {LEDGER} where load = ? and task = ?", (self.load, task))
            before = {r[0] for r in cursor.fetchall()}
            db.rollback()
            for k, (rows, size) in enumerate(batched(iterator, self.most_rows, self.most_bytes)):
                if k in before:
                    done.skipped += 1
                    continue
                try:
                    # The ledger's key comes first: of two attempts of a task only one can have the batch.
                    cursor.execute(f"insert into {LEDGER} (load, task, batch, n_rows, n_bytes) values (?, ?, ?, ?, ?)", (self.load, task, k, len(rows), size))
                    cursor.executemany(insert, [tuple(map(_plain, r)) for r in rows])
                    db.commit()
                except BaseException:
                    db.rollback()
                    raise
                done.rows, done.batches = done.rows + len(rows), done.batches + 1
        finally:
            db.close()
        return done

    def commit(self, messages: list[Done | None]) -> None:
        pass

    def abort(self, messages: list[Done | None]) -> None:
        """What is committed stays: the next load of this name goes on after it."""


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder, as load_batches needs it; sink.drop() removes it after the load."""
    return cut(df, "load")


def load_batches(rows: DataFrame, connect: Callable[[], Any], table: str, load: str, batch_rows: int = BATCH_ROWS, batch_bytes: int = BATCH_BYTES) -> None:
    """Append staged() rows to a database table in committed batches; connect() gives a connection where it is called, in
    the driver or a task. After a failure the same call goes on where the batches stopped."""
    if not is_cut(rows):
        raise ValueError("load_batches takes what staged() returns")
    db = connect()
    try:
        db.cursor().execute(f"create table if not exists {LEDGER} (load varchar(200), task integer, batch integer, n_rows integer, n_bytes bigint, primary key (load, task, batch))")
        db.commit()
    finally:
        db.close()
    writer = BatchWriter(connect, table, load, rows.columns, batch_rows, batch_bytes)

    class Batches(DataSource):
        @classmethod
        def name(cls) -> str:
            return "ferryline_batches"

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return writer

    rows.sparkSession.dataSource.register(Batches)
    rows.write.format("ferryline_batches").mode("append").save()
