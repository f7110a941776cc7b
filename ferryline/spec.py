"""Table specifications and the type map from source column types to Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T


class UnsupportedType(ValueError):
    """A source type without a Spark type."""


@dataclass(frozen=True)
class SourceColumn:
    name: str
    source_type: str
    precision: int | None = None
    scale: int | None = None
    length: int | None = None
    nullable: bool = True


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class TableSpec:
    name: str
    primary_key: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[str, ...] = ()
    overrides: dict[str, str] = field(default_factory=dict)


#: Numbers without a precision keep ten places; another type can be given as an override.
OPEN_NUMBER = T.DecimalType(38, 10)


def number_type(precision: int | None, scale: int | None) -> T.DataType:
    """Type of a fixed-point source column. Spark has no negative scale and no scale above the precision."""
    if precision is None:
        return OPEN_NUMBER
    if not scale:
        for most, kind in ((4, T.ShortType()), (9, T.IntegerType()), (18, T.LongType())):
            if precision <= most:
                return kind
        return T.DecimalType(precision, 0)
    if scale < 0:
        return T.DecimalType(min(precision - scale, 38), 0)
    return T.DecimalType(max(precision, scale), scale)


# Source type names and what they become.
_PLAIN = {
    "FLOAT": T.DoubleType(), "BINARY_DOUBLE": T.DoubleType(), "BINARY_FLOAT": T.FloatType(), "VARCHAR2": T.StringType(), "NVARCHAR2": T.StringType(),
    "VARCHAR": T.StringType(), "CHAR": T.StringType(), "NCHAR": T.StringType(), "CLOB": T.StringType(), "NCLOB": T.StringType(), "LONG": T.StringType(),
    "BLOB": T.BinaryType(), "LONG RAW": T.BinaryType(), "RAW": T.BinaryType(), "DATE": T.TimestampNTZType(), "XMLTYPE": T.StringType(),
    "ROWID": T.StringType(), "UROWID": T.StringType(),
}


def spark_type(column: SourceColumn) -> T.DataType:
    """Spark type of a source column; raises UnsupportedType for names that are not known."""
    name = re.sub(r"\(\s*\d+(\s*,\s*-?\d+)?\s*\)", "", column.source_type.upper()).strip()
    if name in ("NUMBER", "NUMERIC", "DECIMAL"):
        return number_type(column.precision, column.scale)
    if name in _PLAIN:
        return _PLAIN[name]
    if name.startswith("TIMESTAMP"):
        return T.TimestampType() if "TIME ZONE" in name else T.TimestampNTZType()
    if name.startswith("INTERVAL YEAR"):
        return T.YearMonthIntervalType()
    if name.startswith("INTERVAL DAY"):
        return T.DayTimeIntervalType()
    raise UnsupportedType(f"{column.name}: {column.source_type}")


def spark_schema(columns: list[SourceColumn], overrides: dict[str, str] | None = None) -> T.StructType:
    """Schema of a table; an override (column name to a Spark DDL type) wins over the map."""
    given = {k.upper(): v for k, v in (overrides or {}).items()}
    fields = []
    for c in columns:
        kind = T._parse_datatype_string(given[c.name.upper()]) if c.name.upper() in given else spark_type(c)
        metadata = {k: v for k, v in (("source_type", c.source_type), ("precision", c.precision), ("scale", c.scale), ("length", c.length)) if v is not None}
        fields.append(T.StructField(c.name, kind, c.nullable, metadata))
    return T.StructType(fields)
