"""Date formats, number pictures and positions against plain Python."""

import datetime as dt
import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from ferryline.functions import formats
from ferryline.functions import oracle as O
from ferryline.queries.functions import format_reading


@pytest.fixture
def get(spark):
    return lambda *columns: tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_formats_are_read_into_parts():
    assert [(p.element, p.text) for p in formats.parts('DD "of the" FMMonth,RRRR hh24miSSSSS.ff3x')] == [
        ("DD", ""), (None, " "), (None, "of the"), (None, " "), ("MONTH", ""), (None, ","), ("RRRR", ""), (None, " "), ("HH24", ""), ("MI", ""), ("SSSSS", ""), (None, "."), ("FF3", ""), (None, "x"),
    ]


def test_dates_read(get):
    now = F.lit("2024-06-30 10:00:00").cast("timestamp_ntz")
    read = lambda text, fmt: O.to_date(F.lit(text), fmt, now)
    cases = {
        ("31.12.99", "DD.MM.RR"): dt.datetime(1999, 12, 31), ("31.12.49", "DD.MM.RR"): dt.datetime(2049, 12, 31), ("31.12.50", "DD.MM.RR"): dt.datetime(1950, 12, 31), ("1.2.99", "DD.MM.YY"): dt.datetime(2099, 2, 1),
        ("77-3", "RRRR-MM"): dt.datetime(1977, 3, 1), ("2077-3", "RRRR-MM"): dt.datetime(2077, 3, 1), ("20240229", "YYYYMMDD"): dt.datetime(2024, 2, 29), ("30.02.2024", "DD.MM.YYYY"): None,
        ("60 2024", "DDD YYYY"): dt.datetime(2024, 2, 29), ("366 2023", "DDD YYYY"): None, ("3 5", "MM DD"): dt.datetime(2024, 3, 5), ("07:08", "HH24:MI"): dt.datetime(2024, 6, 1, 7, 8),
        ("12:30 am", "HH:MI AM"): dt.datetime(2024, 6, 1, 0, 30), ("12:30 P.M.", "HH12:MI PM"): dt.datetime(2024, 6, 1, 12, 30), ("13:30 pm", "HH12:MI PM"): None,
        ("86399 1/1/2020", "SSSSS DD/MM/YYYY"): dt.datetime(2020, 1, 1, 23, 59, 59), ("86400 1/1/2020", "SSSSS DD/MM/YYYY"): None, ("5-sep-2021", "DD-MON-YYYY"): dt.datetime(2021, 9, 5), ("5 September 2021", "DD MONTH YYYY"): dt.datetime(2021, 9, 5), ("5-xyz-2021", "DD-MON-YYYY"): None,
        ("2020-01-01 00:00:01.5", "YYYY-MM-DD HH24:MI:SS.FF"): dt.datetime(2020, 1, 1, 0, 0, 1, 500_000), ("2020-01-01 00:00:01.123456", "YYYY-MM-DD HH24:MI:SS.FF3"): None, ("2020-01-01 00:00:60", "YYYY-MM-DD HH24:MI:SS"): None,
        ("2020-01-01 00:00 +02:30", "YYYY-MM-DD HH24:MI TZH:TZM"): dt.datetime(2019, 12, 31, 21, 30), ("2020-07-01 00:00 Europe/Berlin", "YYYY-MM-DD HH24:MI TZR"): dt.datetime(2020, 6, 30, 22, 0), ("no", "DD.MM.YYYY"): None,
    }
    assert dict(zip(cases, get(*[read(*k) for k in cases]), strict=True)) == cases
    with pytest.raises(ValueError, match="not read"):
        O.to_date(F.lit("1"), "Q")


def test_years_seen_from_the_second_half(get):
    now = F.lit("2061-01-01").cast("timestamp_ntz")
    assert get(*[F.year(O.to_date(F.lit(f"1.1.{y}"), "DD.MM.RR", now)) for y in ("49", "50", "99")]) == (2149, 2050, 2099)


def test_random_dates_go_there_and_back(spark):
    r = random.Random(3)
    fmts = ["YYYY-MM-DD HH24:MI:SS.FF6", "DD MON RRRR SSSSS", "YYYYDDD HH:MI:SS AM", "MONTH DD, YYYY HH24 MI SS", '"Y"RR"M"MM"D"DD HH24MISS', "DY DD/MM/YYYY"]
    times = [dt.datetime(1990, 1, 1) + dt.timedelta(seconds=r.randrange(10**9), microseconds=r.randrange(10**6)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    now = F.lit("2024-06-30").cast("timestamp_ntz")
    for k, fmt in enumerate(fmts):
        cut = {0: lambda t: t, 5: lambda t: t.replace(hour=0, minute=0, second=0, microsecond=0)}.get(k, lambda t: t.replace(microsecond=0))
        assert all(x["b"] == cut(x["t"]) for x in df.withColumn("b", O.to_date(O.to_char_date(F.col("t"), fmt), fmt, now)).collect()), fmt


def test_date_texts(get):
    t = F.lit("2024-03-05 13:07:09.123456").cast("timestamp_ntz")
    cases = {"SSSSS": "47229", "FF1": "1", "FF4": "1234", "FF": "123456", "HH:MI A.M.": "01:07 P.M.", "D WW IW Q": "3 10 10 1", "RRRR/RR": "2024/24", '"Day" DDD': "Day 065", "MONTH": "March", "DY": "Tue"}
    assert dict(zip(cases, get(*[O.to_char_date(t, f) for f in cases]), strict=True)) == cases


def picture(x, fmt):
    """The number by its picture, digit by digit."""
    fm = fmt.startswith("FM")
    body = fmt.removeprefix("FM")
    sign = re.search(r"(MI|PR|S)$", body)
    sign = sign[0] if sign else ("<" if body.startswith("S") else "")
    body = re.sub(r"^S|(MI|PR|S)$", "", body)
    dollar, body = "$" in body, body.replace("$", "")
    whole, point, fraction = body.partition(".")
    v = Decimal(x).quantize(Decimal(1).scaleb(-len(fraction)), ROUND_HALF_UP)
    minus, text = v < 0, f"{abs(v):f}".split(".")
    width = len(body) + dollar + (2 if sign == "PR" else 1)
    slots = [c for c in whole if c != ","]
    if len(text[0]) > len(slots):
        return "#" * width
    digits = text[0].rjust(len(slots))
    zero = "".join(slots).find("0")
    out, started = "", False
    k = 0
    for c in whole:
        if c == ",":
            out += "," if started else ""
            continue
        d = digits[k]
        must = zero >= 0 and k >= zero or not fraction and k == len(slots) - 1
        if d == " " or (text[0] == "0" and not must and not started):
            d = "0" if must else ""
        started = started or d != ""
        out += d
        k += 1
    if point:
        tail = text[1] if fraction else ""
        while fm and tail and tail[-1] == "0" and fraction[len(tail) - 1] == "9":
            tail = tail[:-1]
        out += "." + tail
    out = ("$" if dollar else "") + out
    pad = "" if fm else " "
    out = {"": ("-" if minus else pad) + out, "<": ("-" if minus else "+") + out, "S": out + ("-" if minus else "+"), "MI": out + ("-" if minus else pad), "PR": f"<{out}>" if minus else pad + out + pad}[sign]
    return out if fm else out.rjust(width)


def test_number_pictures(spark):
    r = random.Random(5)
    values = [Decimal(0), Decimal("0.5"), Decimal("-0.5"), Decimal("1.2345"), Decimal("1234567.5"), Decimal("-99.995"), Decimal("0.004"), *(Decimal(r.randrange(-(10**7), 10**7)).scaleb(-r.randrange(6)) for _ in range(40))]
    fmts = ["FM0.0000", "FM999,999,990.00", "999", "990", "9,990.99", "FM990.99", "99.9MI", "9G999D00", "S9999", "9999S", "9999PR", "$9,999.00", "FM$9990", "0000", "FM9.999", "9999999.", "FM0,000,000"]
    df = spark.createDataFrame([(v,) for v in values], "x decimal(20,6)")
    rows = df.select("x", *[O.to_char_number(F.col("x"), f).alias(str(i)) for i, f in enumerate(fmts)]).collect()
    for row in rows:
        for i, f in enumerate(fmts):
            assert row[str(i)] == picture(row["x"], f.replace("G", ",").replace("D", ".")), (row["x"], f)
    assert spark.range(1).select(O.to_char_number(F.lit(None).cast("int"), "99")).first()[0] is None
    with pytest.raises(ValueError, match="no number picture"):
        O.to_char_number(F.lit(1), "XX")


def test_readings(get):
    values = [Decimal("1835000"), Decimal("-1.125"), 1_835_000.0, 1_125_000.0, 1_135_000.0, 999.995]
    assert get(*[format_reading(F.lit(v)) for v in values]) == ("1.84 MkWh", "-1.13 kWh", "1.83 MkWh", "1.12 MkWh", "1.14 MkWh", "1,000.00 kWh")
    assert get(format_reading(F.lit(None).cast("double")), format_reading(F.lit(2500).cast("int"), "W")) == ("N/A", "2.50 KW")


def test_parts_of_days(get):
    t = F.lit("2024-01-31 18:00:00").cast("timestamp_ntz")
    assert get(O.plus_days(t, 0.5), O.plus_days(t, -1), O.add_months(t, 1), O.last_day(F.lit("2024-02-03 01:02:03").cast("timestamp_ntz")), O.date_diff(t, F.lit("2024-01-31 06:00:00").cast("timestamp_ntz"))) == (
        dt.datetime(2024, 2, 1, 6), dt.datetime(2024, 1, 30, 18), dt.datetime(2024, 2, 29, 18), dt.datetime(2024, 2, 29, 1, 2, 3), 0.5,
    )


def test_positions(spark):
    def instr(s, t, start, nth):
        at = [p for p in range(len(s) - len(t) + 1) if s[p : p + len(t)] == t]
        at = [p for p in at if p + 1 >= start] if start > 0 else [p for p in reversed(at) if p + 1 <= len(s) + start + 1]
        return at[nth - 1] + 1 if start and nth <= len(at) else 0

    texts = ["a-b-c", "aaa", "", "aabaa", "CORPORATE FLOOR", "ébébé"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "s string")
    cases = [(t, start, nth) for t in ("c", "aa", "OR", "a", "éb") for start in (1, 3, -1, -3, 0, 99, -99) for nth in (1, 2, 3)]
    rows = df.select("s", *[O.instr_from(F.col("s"), *c).alias(str(i)) for i, c in enumerate(cases)]).collect()
    for row in rows:
        for i, c in enumerate(cases):
            assert row[str(i)] == (None if row["s"] is None else instr(row["s"], *c)), (row["s"], c)
