"""Scalar functions with Oracle meanings, as Spark columns. Names follow the source database; all are null-safe as there."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferryline.functions import formats


def nvl(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def nvl2(a: Column, present: Column, absent: Column) -> Column:
    return F.when(a.isNotNull(), present).otherwise(absent)


def decode(x: Column, *rest: Column, null_safe: bool = False) -> Column:
    """decode(x, key, value, ..., default): null keys match nothing, or null if null_safe."""
    pairs, default = rest[: len(rest) // 2 * 2], rest[-1] if len(rest) % 2 else F.lit(None)
    out = None
    for k, v in zip(pairs[::2], pairs[1::2], strict=True):
        hit = x.eqNullSafe(k) if null_safe else x == k
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise(default)


def sysdate(as_of: Column | None = None) -> Column:
    """The clock to the second; as_of fixes it."""
    return F.date_trunc("second", as_of if as_of is not None else F.current_timestamp()).cast("timestamp_ntz")


def systimestamp(as_of: Column | None = None) -> Column:
    return as_of if as_of is not None else F.current_timestamp()


# Unit names of date truncation.
_UNITS = {"MM": "month", "MON": "month", "MONTH": "month", "YY": "year", "YYYY": "year", "YEAR": "year", "DD": "day", "DDD": "day", "HH": "hour", "HH24": "hour", "MI": "minute", "Q": "quarter", "IW": "week"}


def trunc(d: Column, unit: str = "DD") -> Column:
    """Start of the day, month, ... as a timestamp without zone; unknown units are days."""
    return F.date_trunc(_UNITS.get(unit.upper(), "day"), d).cast("timestamp_ntz")


def _day(d: Column) -> Column:
    return F.date_trunc("day", d).cast("timestamp_ntz")


def _with_time(day: Column, d: Column) -> Column:
    """The day at d's time of day."""
    return day.cast("timestamp_ntz") + (d.cast("timestamp_ntz") - _day(d))


def add_months(d: Column, n: Column | int, month_ends: bool = False) -> Column:
    """d plus n months, day clipped, at the same time of day; with month_ends a last day of a month goes to a last day."""
    moved = F.add_months(d, n)
    return _with_time(F.when(d.cast("date") == F.last_day(d), F.last_day(moved)).otherwise(moved) if month_ends else moved, d)


def months_between(a: Column, b: Column, fractional: bool = False) -> Column:
    """Whole months from b to a, or with fractions of 31-day months."""
    m = F.months_between(a, b)
    return m if fractional else m.cast("int")


def last_day(d: Column) -> Column:
    """The last day of d's month, at the same time of day."""
    return _with_time(F.last_day(d), d)


def date_diff(a: Column, b: Column) -> Column:
    """Days from b to a, parts of days included."""
    return F.timestamp_diff("MICROSECOND", b.cast("timestamp_ntz"), a.cast("timestamp_ntz")) / F.lit(86_400_000_000.0)


def plus_days(d: Column, n: Column | float) -> Column:
    """d plus n days, parts of days included."""
    return d.cast("timestamp_ntz") + num_to_ds(n if isinstance(n, Column) else F.lit(n), "DAY")


# Seconds of the units.
_SECONDS = {"DAY": 86_400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}


def num_to_ds(n: Column, unit: str) -> Column:
    """n days, hours, minutes or seconds, to the microsecond."""
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, zero, (n.cast("decimal(24,12)") * _SECONDS[unit.upper()]).cast("decimal(18,6)"))


def num_to_ym(n: Column, unit: str) -> Column:
    return F.make_ym_interval(n, F.lit(0)) if unit.lower() == "year" else F.make_ym_interval(F.lit(0), n)


def from_tz(ts: Column, zone: str) -> Column:
    """The instant at which clocks of the zone show ts."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def to_date(s: Column, fmt: str, as_of: Column | None = None) -> Column:
    """Text to timestamp; null where it does not fit. as_of fixes the clock that missing and two-digit years go by."""
    return formats.date_of(s, fmt, as_of)


def to_char_date(d: Column, fmt: str) -> Column:
    return formats.date_text(d, fmt)


def to_char_number(n: Column, fmt: str) -> Column:
    """Number by picture; FM takes the padding away."""
    return formats.number_text(n, fmt)


def to_number(s: Column) -> Column:
    return s.try_cast("decimal(38,10)")


def instr(s: Column, t: str) -> Column:
    return F.instr(s, t)


def instr_from(s: Column, t: str, start: int = 1, nth: int = 1) -> Column:
    """Place of the nth find of t at or after `start`, or, with a negative start, of those that begin at that place from the
    end or before it, from there backwards; finds may overlap. 0 if there is none."""
    if not start or nth < 1 or not t:
        return F.when(s.isNotNull(), 0).cast("int")
    back = start < 0
    text, find = (F.reverse(s), t[::-1]) if back else (s, t)
    first = max(1, 1 - start - len(t)) if back else start
    next_ = lambda p: F.call_function("locate", F.lit(find), text, p + 1)
    place = F.aggregate(F.array_repeat(F.lit(0), nth), F.lit(first - 1), lambda p, _: F.when((p < 0) | (next_(p) == 0), -1).otherwise(next_(p)))
    return F.when(place > 0, F.char_length(s) - place - len(t) + 2 if back else place).when(s.isNotNull(), 0).cast("int")


def lengthb(s: Column) -> Column:
    return F.octet_length(s)


def lob_length(c: Column, binary: bool = False) -> Column:
    return F.octet_length(c) if binary else F.char_length(c)


def lob_substr(c: Column, amount: int, offset: int = 1) -> Column:
    return F.substring(c, offset, amount)


def regexp_like(s: Column, pattern: str, flags: str = "") -> Column:
    return s.rlike(("(?i)" if "i" in flags else "") + pattern)


def regexp_substr(s: Column, pattern: str) -> Column:
    return F.regexp_substr(s, F.lit(pattern))


def regexp_count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def regexp_replace(s: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(s, pattern, by)


def bitand(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def sys_guid(stable_key: Column | None = None) -> Column:
    """A random id, or one that the key decides."""
    return F.upper(F.substring(F.sha2(stable_key.cast("string"), 256), 1, 32)) if stable_key is not None else F.expr("uuid()")


def empty_clob() -> Column:
    return F.lit("")


def empty_blob() -> Column:
    return F.lit(b"")


def session(name: str) -> Column:
    """User, session user or database of the session."""
    return {"USER": F.current_user, "SESSION_USER": F.session_user, "DB_NAME": F.current_database}[name.upper()]()


def listagg(value: Column, order: list[Column | str], sep: str = ",") -> Column:
    """Values without nulls joined in order: an aggregate."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], value.cast("string").alias("v")))))
    return F.nullif(F.array_join(F.transform(rows, lambda r: r["v"]), sep), F.lit(""))


def wm_concat(value: Column) -> Column:
    """Values joined by commas, sorted so that the result is one."""
    return listagg(value, [value])


_DAYS = re.compile(r"SYSDATE\s*([+-])\s*(\d+(?:\.\d+)?)(?:\s*/\s*(\d+))?")
_DATE_TEXT = re.compile(r"TO_DATE\s*\(\s*'([^']*)'\s*,\s*'([^']*)'\s*(?:,\s*'[^']*'\s*)?\)", re.IGNORECASE)


def default_value(text: str, as_of: Column | None = None) -> Column:
    """Column of a column's default as the source writes it: NULL, a clock with or without days added, an id, the user, a
    date's text, a string, a number. as_of fixes the clock."""
    text = text.strip()
    upper = text.upper()
    simple = {
        "NULL": lambda: F.lit(None), "SYSDATE": lambda: sysdate(as_of), "TRUNC(SYSDATE)": lambda: trunc(sysdate(as_of)), "SYSTIMESTAMP": lambda: systimestamp(as_of),
        "SYS_GUID()": sys_guid, "USER": lambda: session("USER"),
    }
    if upper in simple:
        return simple[upper]()
    if m := _DAYS.fullmatch(upper):
        seconds = round(float(m[2]) * 86_400 / int(m[3] or 1)) * (1 if m[1] == "+" else -1)
        return sysdate(as_of) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    if m := _DATE_TEXT.fullmatch(text):
        return to_date(F.lit(m[1].strip()), m[2])
    if m := re.fullmatch(r"N?'((?:[^']|'')*)'", text):
        return F.lit(m[1].replace("''", "'"))
    if re.fullmatch(r"[+-]?\d+", text):
        return F.lit(int(text))
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)", text):
        return F.lit(Decimal(text))
    raise ValueError(f"no default value {text}")
