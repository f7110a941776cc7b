"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def fresh_names(tables: DataFrame | Iterable[DataFrame], *names: str) -> list[str]:
    """The names with underscores in front, as many as keep them apart from the columns of the tables."""
    taken = {c.lower() for df in ([tables] if isinstance(tables, DataFrame) else tables) for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out
