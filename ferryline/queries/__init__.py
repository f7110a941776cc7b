"""Registered queries over the driver's tables, each beside DuckDB SQL for the same rows where SQL can express it."""

from ferryline.queries import aggregates, functions, integrity, joins, ledgers, scans, shapes, streams, texts, views  # noqa: F401
from ferryline.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
