"""Streams whose rules look at a unit's events one after another: throttle and stalls.

Events wait in the state of their unit until the watermark has passed them, and are then handed on in order of time, so
neither files, batches nor chunks of a batch change what comes out; what is still waiting when a stream stops comes out
when it goes on. Timers wake a unit for its earliest event and for what it has to report or to forget itself: a unit that
nothing waits for leaves no state. Later events than the watermark allows go, as everywhere. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Events that always pass the throttle.
TERMINAL = ("FAILED", "STATS", "COMPLETED")
EVENT = "table_name string, partition_key string, ts timestamp, state string, rows long, event_id long"
STALL = "table_name string, partition_key string, last_seen timestamp"
_WAITING = "ts long, event_id long, state string, rows long"

Event = tuple[int, int | None, str | None, int | None]


def in_order(event: Event) -> tuple:
    return event[0], event[1] is not None, event[1] or 0


def throttle_walk(last: int | None, events: list[Event], gap: int) -> tuple[int | None, list[bool]]:
    """Which events pass, at most one in `gap` microseconds since the last that did, and terminal ones always."""
    keep = []
    for ts, _, state, _ in events:
        ok = state in TERMINAL or last is None or ts - last >= gap
        last = ts if ok else last
        keep.append(ok)
    return last, keep


class InOrder(StatefulProcessor):
    """walk(key, last, events, watermark) -> (rows, last, wake): rows for the events that the watermark has passed, the time
    to remember (None forgets the unit) and when to be woken at the latest (None: by events only). Times are microseconds."""

    def walk(self, key: Any, last: int | None, events: list[Event], watermark: int) -> tuple[pd.DataFrame | None, int | None, int | None]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.last = handle.getValueState("last", "t long")

    def _wake_after(self, ts: int) -> None:
        self.handle.registerTimer(ts // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        none = lambda x: None if pd.isna(x) else x
        events = []
        for pdf in rows:
            for ts, event_id, state, n in zip(pdf["ts"], pdf["event_id"], pdf["state"], pdf["rows"], strict=True):
                events.append((ts.value // 1000, None if pd.isna(event_id) else int(event_id), none(state), None if pd.isna(n) else int(n)))
        if events:
            self.waiting.appendList(events)
            self._wake_after(min(e[0] for e in events))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        ready, rest = sorted((e for e in held if e[0] < watermark), key=in_order), [e for e in held if e[0] >= watermark]
        last = self.last.get()[0] if self.last.exists() else None
        if not ready and last is None:
            return
        rows, last, wake = self.walk(key, last, ready, watermark)
        if rest:
            self.waiting.put(rest)
            self._wake_after(min(e[0] for e in rest))
        elif held:
            self.waiting.clear()
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
        if wake is not None:
            self._wake_after(wake)
        if rows is not None and len(rows):
            yield rows

    def close(self) -> None:
        pass


def _times(values: list[int]) -> pd.DatetimeIndex:
    return pd.to_datetime(values, unit="us", utc=True)


class Throttle(InOrder):
    def __init__(self, seconds: float):
        self.gap = round(seconds * 1_000_000)

    def walk(self, key: Any, last: int | None, events: list[Event], watermark: int) -> tuple[pd.DataFrame | None, int | None, int | None]:
        last, keep = throttle_walk(last, events, self.gap)
        out = [e for e, ok in zip(events, keep, strict=True) if ok]
        rows = pd.DataFrame({
            "table_name": [key[0]] * len(out), "partition_key": [key[1]] * len(out), "ts": _times([e[0] for e in out]), "state": pd.Series([e[2] for e in out], dtype=object),
            "rows": pd.array([e[3] for e in out], dtype="Int64"), "event_id": pd.array([e[1] for e in out], dtype="Int64"),
        })
        # Once the gap is over the time of the last event decides nothing any more.
        over = last is None or last + self.gap < watermark
        return rows, None if over else last, None if over else last + self.gap


class Stall(InOrder):
    def __init__(self, minutes: float):
        self.gap = round(minutes * 60_000_000)

    def walk(self, key: Any, last: int | None, events: list[Event], watermark: int) -> tuple[pd.DataFrame | None, int | None, int | None]:
        seen = []
        for ts, *_ in events:
            if last is not None and ts - last > self.gap:
                seen.append(last)
            last = ts
        silent = last is not None and watermark - last > self.gap
        if silent:
            seen.append(last)
        rows = pd.DataFrame({"table_name": [key[0]] * len(seen), "partition_key": [key[1]] * len(seen), "last_seen": _times(seen)})
        return rows, None if silent else last, None if silent or last is None else last + self.gap


def _units(events: DataFrame, watermark: str):
    optional = lambda c, kind: (F.col(c) if c in events.columns else F.lit(None)).cast(kind).alias(c)
    rows = events.select("table_name", "partition_key", F.col("ts").cast("timestamp").alias("ts"), optional("state", "string"), optional("rows", "long"), optional("event_id", "long"))
    return rows.where("ts is not null").withWatermark("ts", watermark).groupBy("table_name", "partition_key")


def throttle_stream(events: DataFrame, seconds: float = 1.0, watermark: str = "1 minute") -> DataFrame:
    """throttled() for a streaming DataFrame: events come out when the watermark has passed them."""
    return _units(events, watermark).transformWithStateInPandas(Throttle(seconds), outputStructType=EVENT, outputMode="Append", timeMode="EventTime")


def stall_stream(events: DataFrame, minutes: float = 30, watermark: str = "1 minute") -> DataFrame:
    """Units and the times after which no event came for more than `minutes` of event time: table_name, partition_key,
    last_seen. Both gaps that an event ended and silence up to the watermark are reported, each once."""
    return _units(events, watermark).transformWithStateInPandas(Stall(minutes), outputStructType=STALL, outputMode="Append", timeMode="EventTime")
