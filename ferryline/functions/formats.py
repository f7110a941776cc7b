"""Date and number formats of the source database, compiled to columns.

A date format is read into elements; a value's text is the elements' texts put together, and a text is read by one pattern
with a group for each element, from whose finds the timestamp is made. A number picture is read into its digits, groups,
point and sign, from which the text is put together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements of date formats.
ELEMENTS = [
    "YYYY", "RRRR", "YY", "RR", "MONTH", "MON", "MM", "DDD", "DD", "DAY", "DY", "D", "HH24", "HH12", "HH", "MI", "SSSSS", "SS",
    "FF1", "FF2", "FF3", "FF4", "FF5", "FF6", "FF7", "FF8", "FF9", "FF", "AM", "PM", "A.M.", "P.M.", "TZR", "TZH", "TZM", "Q", "IW", "WW",
]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
#: Two-digit years from this one on are of the century before, seen from the first half of a century.
PIVOT = 50
_TOKEN = re.compile(r'"(?P<quoted>[^"]*)"|(?P<mode>FM|FX)|(?P<element>' + "|".join(re.escape(e) for e in sorted(ELEMENTS, key=len, reverse=True)) + r")|(?P<word>[A-Z]+)|(?P<mark>[^A-Z\"])", re.IGNORECASE)


@dataclass(frozen=True)
class Part:
    """An element of a format, or, without one, text that stands as it is."""

    element: str | None
    text: str = ""


def parts(fmt: str) -> list[Part]:
    """The format's elements and texts; letters that are no element stand for themselves."""
    out = []
    for m in _TOKEN.finditer(fmt):
        if m["element"]:
            out.append(Part(m["element"].upper()))
        elif not m["mode"]:
            out.append(Part(None, m["quoted"] if m["quoted"] is not None else m["word"] or m["mark"]))
    return out


# Spark's patterns of the elements that have one.
_PATTERNS = {
    "YYYY": "yyyy", "RRRR": "yyyy", "YY": "yy", "RR": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM", "DDD": "DDD", "DD": "dd", "DAY": "EEEE", "DY": "EEE",
    "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "AM": "a", "PM": "a", "Q": "q", "TZR": "VV",
}


def _seconds(d: Column) -> Column:
    return F.hour(d) * 3600 + F.minute(d) * 60 + F.second(d)


def _text_of(d: Column, part: Part) -> Column:
    e = part.element
    if e is None:
        return F.lit(part.text)
    if e in _PATTERNS:
        return F.date_format(d, _PATTERNS[e])
    if e.startswith("FF"):
        return F.date_format(d, "S" * int(e[2:] or 6))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    marks = {
        "SSSSS": lambda: F.lpad(_seconds(d).cast("string"), 5, "0"), "A.M.": lambda: F.when(F.hour(d) < 12, "A.M.").otherwise("P.M."), "P.M.": lambda: F.when(F.hour(d) < 12, "A.M.").otherwise("P.M."),
        "D": lambda: F.dayofweek(d).cast("string"), "IW": lambda: two(F.weekofyear(d)), "WW": lambda: two(F.floor((F.dayofyear(d) + 6) / 7)),
        "TZH": lambda: F.substring(F.date_format(d, "xxx"), 1, 3), "TZM": lambda: F.substring(F.date_format(d, "xxx"), 5, 2),
    }
    return marks[e]()


def date_text(d: Column, fmt: str) -> Column:
    """Text of a date by its format. Names of months and days are in mixed case and without padding."""
    return F.concat(*[_text_of(d, p) for p in parts(fmt)]) if parts(fmt) else F.when(d.isNotNull(), F.lit(""))


# What the text of an element may look like.
_READS = {
    "YYYY": r"\d{1,4}", "RRRR": r"\d{1,4}", "YY": r"\d{1,2}", "RR": r"\d{1,2}", "MONTH": r"[A-Za-z]{3,9}", "MON": r"[A-Za-z]{3}", "MM": r"\d{1,2}", "DDD": r"\d{1,3}", "DD": r"\d{1,2}",
    "DAY": r"[A-Za-z]+", "DY": r"[A-Za-z]{3}", "HH24": r"\d{1,2}", "HH12": r"\d{1,2}", "HH": r"\d{1,2}", "MI": r"\d{1,2}", "SSSSS": r"\d{1,5}", "SS": r"\d{1,2}", "AM": r"[AaPp]\.?[Mm]\.?",
    "TZR": r"[A-Za-z0-9_/+:-]+", "TZH": r"[+-]?\d{1,2}", "TZM": r"\d{1,2}",
}
_SAME = {"PM": "AM", "A.M.": "AM", "P.M.": "AM", "HH": "HH12", "DY": "DAY"}


def century(two: Column, as_of: Column) -> Column:
    """Year of two digits, at most half a century away: halves of centuries decide."""
    now = F.year(as_of)
    base = now - now % 100
    return base + two + F.when((now % 100 < PIVOT) & (two >= PIVOT), -100).when((now % 100 >= PIVOT) & (two < PIVOT), 100).otherwise(0)


def date_of(s: Column, fmt: str, as_of: Column | None = None) -> Column:
    """The timestamp that a text shows; null where it does not fit.

    Year and month come from `as_of` (now) where the format has none, the day is then the first and the time midnight.
    Numbers may have fewer digits than their element. With a zone it is the instant as the session's clocks show it."""
    now = as_of if as_of is not None else F.current_timestamp()
    pattern, places = r"^\s*", {}
    for p in parts(fmt):
        if p.element is None:
            pattern += r"\s+" if p.text.isspace() else re.escape(p.text)
            continue
        e = _SAME.get(p.element, p.element)
        read = r"\d{1,9}" if e.startswith("FF") else _READS.get(e)
        if read is None:
            raise ValueError(f"{p.element} can be written, not read")
        if e.startswith("FF"):
            read, e = rf"\d{{1,{e[2:] or 9}}}", "FF"
        places[e] = len(places) + 1 if e not in places else places[e]
        pattern += f"({read})" if places[e] == len(places) else f"(?:{read})"
    pattern += r"\s*$"
    text = lambda e: F.regexp_extract(s, pattern, places[e])
    number = lambda e, other: text(e).try_cast("int") if e in places else other
    if "YYYY" in places:
        year = number("YYYY", None)
    elif "RRRR" in places:
        year = F.when(F.char_length(text("RRRR")) > 2, number("RRRR", None)).otherwise(century(number("RRRR", None), now))
    elif "RR" in places:
        year = century(number("RR", None), now)
    elif "YY" in places:
        year = F.year(now) - F.year(now) % 100 + number("YY", None)
    else:
        year = F.year(now)
    named = next((e for e in ("MONTH", "MON") if e in places), None)
    if named:
        month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(F.substring(text(named), 1, 3))), F.lit(0)).cast("int")
    else:
        month = number("MM", F.lit(1) if "DDD" in places else F.month(now))
    hour = number("HH24", F.lit(0))
    if "HH12" in places:
        late = F.upper(F.substring(text("AM"), 1, 1)) == "P" if "AM" in places else F.lit(False)
        twelve = number("HH12", None)
        hour = F.when(twelve.between(1, 12), twelve % 12 + F.when(late, 12).otherwise(0))
    minute, second = number("MI", F.lit(0)), number("SS", F.lit(0)).cast("decimal(16,6)")
    if "SSSSS" in places:
        past = number("SSSSS", None)
        past = F.when(past < 86_400, past)
        hour, minute, second = F.floor(past / 3600).cast("int"), F.floor(past % 3600 / 60).cast("int"), (past % 60).cast("decimal(16,6)")
    # Seconds of 60 and more would be taken for the next minute.
    second = F.when(second < 60, second)
    if "FF" in places:
        second = second + (F.rpad(text("FF"), 9, "0").try_cast("long") / 1_000_000_000).cast("decimal(16,6)")
    day = number("DD", F.lit(1))
    out = F.try_make_timestamp_ntz(year, month, day, hour, minute, second)
    if "DDD" in places:
        later = out + F.make_dt_interval(number("DDD", None) - 1)
        out = F.when((number("DDD", None) >= 1) & (F.year(later) == year), later)
    if "TZR" in places:
        out = F.convert_timezone(text("TZR"), F.current_timezone(), out)
    elif "TZH" in places:
        minutes = F.abs(number("TZH", None)) * 60 + number("TZM", F.lit(0))
        ahead = F.when(text("TZH").startswith("-"), -minutes).otherwise(minutes)
        out = F.convert_timezone(F.lit("UTC"), F.current_timezone(), out - F.make_dt_interval(F.lit(0), F.lit(0), ahead))
    return F.when(s.rlike(pattern), out)


@dataclass(frozen=True)
class Picture:
    """A number picture: digits and group marks before the point, digits after it, and what stands around them."""

    whole: str
    fraction: str
    point: bool
    fill: bool
    dollar: bool
    sign: str


def picture_of(fmt: str) -> Picture:
    text = fmt.upper()
    fill = not text.startswith("FM")
    text = text.removeprefix("FM")
    sign = ""
    if text.endswith("MI") or text.endswith("PR"):
        text, sign = text[:-2], text[-2:]
    elif text.startswith("S") or text.endswith("S"):
        sign = "S<" if text.startswith("S") else ">S"
        text = text.strip("S")
    dollar = "$" in text
    text = text.replace("$", "").replace("G", ",").replace("D", ".")
    if not re.fullmatch(r"[90,]*(\.[90]*)?", text) or not re.search("[90]", text) or text.startswith(","):
        raise ValueError(f"no number picture {fmt}")
    whole, point, fraction = text.partition(".")
    return Picture(whole, fraction, bool(point), fill, dollar, sign)


def number_text(n: Column, fmt: str) -> Column:
    """Text of a number by its picture: rounded half away from zero to its digits, marks (#) where they are too few.

    FM leaves out padding, and zeros at the end that the picture has as 9."""
    p = picture_of(fmt)
    scale, digits = len(p.fraction), sum(c != "," for c in p.whole)
    value = F.round(n.cast("decimal(38,15)"), scale).cast(f"decimal(38,{scale})")
    plain = F.abs(value).cast("string")
    whole = F.substring_index(plain, ".", 1)
    first_zero = p.whole.replace(",", "").find("0")
    least = digits - first_zero if first_zero >= 0 else (0 if p.point and scale else 1)
    shown = F.when(F.lit(least > 0) | (whole != "0"), F.lpad(whole, F.greatest(F.char_length(whole), F.lit(least)), F.lit("0"))).otherwise("")
    room = F.lpad(shown, digits, " ")
    pieces, at = [], 0
    for k, group in enumerate(p.whole.split(",")):
        if k:
            pieces.append(F.when(F.trim(F.substring(room, 1, at)) != "", ",").otherwise(" "))
        pieces.append(F.substring(room, at + 1, len(group)))
        at += len(group)
    body = F.ltrim(F.concat(*pieces)) if pieces else F.lit("")
    if p.point:
        tail = F.substring_index(plain, ".", -1) if scale else F.lit("")
        if not p.fill:
            kept = p.fraction.rfind("0") + 1
            tail = F.concat(F.substring(tail, 1, kept), F.regexp_replace(F.substring(tail, kept + 1, scale), "0+$", "")) if scale else tail
        body = F.concat(body, F.lit("."), tail)
    if p.dollar:
        body = F.concat(F.lit("$"), body)
    minus = value < 0
    signed = {
        "": lambda: F.concat(F.when(minus, "-").otherwise(" " if p.fill else ""), body),
        "S<": lambda: F.concat(F.when(minus, "-").otherwise("+"), body),
        ">S": lambda: F.concat(body, F.when(minus, "-").otherwise("+")),
        "MI": lambda: F.concat(body, F.when(minus, "-").otherwise(" " if p.fill else "")),
        "PR": lambda: F.when(minus, F.concat(F.lit("<"), body, F.lit(">"))).otherwise(F.concat(F.lit(" "), body, F.lit(" ")) if p.fill else body),
    }[p.sign]()
    width = len(p.whole) + p.point + scale + p.dollar + (2 if p.sign == "PR" else 1)
    out = F.lpad(signed, width, " ") if p.fill else signed
    return F.when(value.isNotNull(), F.when(F.char_length(whole) > F.greatest(F.lit(digits), F.lit(1 if digits == 0 else 0)), "#" * width).otherwise(out))
