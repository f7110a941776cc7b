"""Small fixed cases: types, nulls, chunks, bounds, filters, ledgers."""

import datetime as dt
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.functions import oracle as O
from ferryline.operators import chunks, hierarchy, integrity, ledger, partitions, ranges, reconcile, shape, textjobs
from ferryline.operators.order import numbered
from ferryline.sources import sink
from ferryline.spec import SourceColumn, TableSpec, UnsupportedType, spark_schema, spark_type
from ferryline.streaming import progress as P

# Number types by precision and scale, and named types, with the types they must become.
NUMBERS = [
    (3, 0, T.ShortType()), (4, 0, T.ShortType()), (9, 0, T.IntegerType()), (10, 0, T.LongType()), (18, 0, T.LongType()), (19, 0, T.DecimalType(19, 0)), (38, 0, T.DecimalType(38, 0)),
    (15, 2, T.DecimalType(15, 2)), (20, 5, T.DecimalType(20, 5)), (None, None, T.DecimalType(38, 10)), (5, -2, T.DecimalType(7, 0)), (2, 5, T.DecimalType(5, 5)),
]
NAMED = [
    ("VARCHAR2", T.StringType()), ("NVARCHAR2", T.StringType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("NCLOB", T.StringType()), ("BLOB", T.BinaryType()), ("RAW", T.BinaryType()),
    ("LONG", T.StringType()), ("LONG RAW", T.BinaryType()), ("DATE", T.TimestampNTZType()), ("TIMESTAMP", T.TimestampNTZType()), ("TIMESTAMP(3)", T.TimestampNTZType()),
    ("TIMESTAMP WITH TIME ZONE", T.TimestampType()), ("TIMESTAMP(6) WITH LOCAL TIME ZONE", T.TimestampType()), ("FLOAT", T.DoubleType()), ("BINARY_FLOAT", T.FloatType()),
    ("BINARY_DOUBLE", T.DoubleType()), ("XMLTYPE", T.StringType()), ("ROWID", T.StringType()), ("INTERVAL YEAR(2) TO MONTH", T.YearMonthIntervalType()), ("INTERVAL DAY(2) TO SECOND(6)", T.DayTimeIntervalType()),
]


@pytest.mark.parametrize(("precision", "scale", "want"), NUMBERS)
def test_number_types(precision, scale, want):
    assert spark_type(SourceColumn("c", "NUMBER", precision, scale)) == want


@pytest.mark.parametrize(("name", "want"), NAMED)
def test_named_types(name, want):
    assert spark_type(SourceColumn("c", name)) == want


def test_type_errors_and_overrides(spark):
    with pytest.raises(UnsupportedType):
        spark_type(SourceColumn("c", "SDO_GEOMETRY"))
    schema = spark_schema([SourceColumn("A", "NUMBER"), SourceColumn("B", "NUMBER", 9, 0)], {"a": "bigint"})
    assert [f.dataType for f in schema] == [T.LongType(), T.IntegerType()]


def test_empty_is_null(spark):
    df = spark.createDataFrame([("", b"", 1), ("  ", b"x", 0), (None, None, None)], "s string, b binary, n int")
    once = shape.empty_to_null(df)
    assert [tuple(r) for r in once.collect()] == [(None, None, 1), ("  ", b"x", 0), (None, None, None)]
    assert shape.empty_to_null(once).collect() == once.collect()


def test_chunk_counts(spark):
    """Around the borders of the rule and at random, against a formula of its own."""
    import random

    def want(n, batch, workers):
        batch = batch if batch > 0 else chunks.DEFAULT_BATCH
        return 1 if n <= 10 * batch else min(max(n // batch, 2), max(8, 4 * workers))

    r = random.Random(3)
    cases = [(k * b + e, b, w) for b in (7, 900) for k in (1, 10, 11, 64) for e in (-1, 0, 1) for w in (0, 2, 16)] + [(r.randrange(10**7), r.randrange(-5, 10**5), r.randrange(40)) for _ in range(60)]
    columns = [chunks.chunk_count(F.lit(n), batch, workers).alias(f"c{i}") for i, (n, batch, workers) in enumerate(cases)]
    assert list(spark.range(1).select(*columns).first()) == [want(*c) for c in cases]


def _month(y, m, d=1):
    return dt.datetime(y, m, d)


def test_bounds_and_pruning(spark):
    """Weekly parts of a year that is not theirs, any range of days against the days of each part."""
    import random

    first = dt.datetime(2019, 12, 30)
    week = lambda i: first + dt.timedelta(days=7 * i)
    highs = spark.createDataFrame([(f"w{i}", i, f"TO_DATE(' {week(i + 1):%Y-%m-%d} 00:00:00', 'SYYYY-MM-DD HH24:MI:SS')") for i in range(9)], "part string, position int, high_text string")
    bounds = partitions.bounds_from_highs(highs.withColumn("high", partitions.parse_bound(F.col("high_text"))[0]).withColumn("t", F.lit("x")), ["t"])
    rows = {r["part"]: (r["lower"], r["upper"]) for r in bounds.collect()}
    assert rows == {f"w{i}": (week(i) if i else None, week(i + 1)) for i in range(9)}
    r = random.Random(4)
    for _ in range(6):
        lo, hi = sorted(r.sample(range(-10, 70), 2))
        a, b = (first + dt.timedelta(days=x) for x in (lo, hi))
        days = {x // 7 if x >= 0 else 0 for x in range(lo, hi) if x < 63}
        assert {x["part"] for x in partitions.prune(bounds, F.lit(a), F.lit(b)).collect()} == {f"w{d}" for d in days}
    assert partitions.prune(bounds, F.lit(week(7)), F.lit(None).cast("timestamp_ntz")).count() == 2


@pytest.mark.parametrize("kind", ["double", "date"])
def test_overlaps(spark, kind):
    """All pairs of short ranges, open ends included, against the points that they hold."""
    ends = [None, 0, 1, 2, 3]
    pairs = [(lo, hi) for lo in ends for hi in ends if lo is None or hi is None or lo < hi]
    held = lambda p: {x for x in range(-2, 6) if (p[0] is None or x >= p[0]) and (p[1] is None or x < p[1])}
    value = lambda x: None if x is None else float(x) if kind == "double" else dt.date(2021, 2, 27) + dt.timedelta(days=x)
    rows = [(i, j, *map(value, (*p, *q))) for i, p in enumerate(pairs) for j, q in enumerate(pairs)]
    df = spark.createDataFrame(rows, f"i int, j int, lo {kind}, hi {kind}, a {kind}, b {kind}")
    got = df.where(partitions.overlaps(*map(F.col, ("lo", "hi", "a", "b")))).select("i", "j").collect()
    assert {tuple(r) for r in got} == {(i, j) for i, p in enumerate(pairs) for j, q in enumerate(pairs) if held(p) & held(q)}


def test_bound_texts(spark):
    texts = ["TIMESTAMP' 2024-03-01 00:00:00'", "MAXVALUE", "", "150", "-2.5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    stamp, number = partitions.parse_bound(F.col("t"))
    assert [tuple(r) for r in df.orderBy("i").select(stamp, number).collect()] == [(_month(2024, 3), None), (None, None), (None, None), (None, 150.0), (None, -2.5)]
    lists = df.select(partitions.parse_list_values(F.lit("'a, b', 'c', d"))).first()[0]
    assert lists == ["a, b", "c", "d"]
    assert df.select(partitions.parse_list_values(F.lit(" default "))).first()[0] == []


def test_name_filters(spark):
    """Globs against fnmatch on names without a slash."""
    from fnmatch import fnmatchcase

    names = [f"{a}{b}" for a in ("Sales", "sale", "x_Log", "LOGS") for b in ("", "_2020", ".old", "s/part")]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    hit = lambda n, globs: any(fnmatchcase(n.lower(), g.lower()) and "/" not in n for g in globs)
    for include, exclude in [(["sale?"], None), (["*log*", "SALES*"], None), (None, ["*_20??", "*.OLD"]), (["*s"], ["l*"]), (["nothing"], ["*"])]:
        got = {r[0] for r in df.where(shape.name_filter(F.col("n"), include, exclude)).collect()}
        assert got == {n for n in names if (include is None or hit(n, include)) and not (exclude and hit(n, exclude))}
    assert shape.is_not_null_check(' "Qty"  is not null ') and not shape.is_not_null_check("qty IS NOT NULL OR qty > 0")


def test_rename_collision(spark):
    with pytest.raises(ValueError, match="meet"):
        shape.rename_columns(spark.createDataFrame([(1, 2)], "a int, b int"), "t", overrides={"T.B": "A"})


def test_route_with_nulls_and_many_bounds(spark, monkeypatch):
    rows = spark.createDataFrame([(1, _month(2024, 1, 15)), (2, _month(2025, 1)), (3, None), (4, _month(2024, 2))], "i int, ts timestamp_ntz")
    bounds = spark.createDataFrame([("a", None, _month(2024, 2)), ("b", _month(2024, 2), _month(2024, 3))], "part string, lower timestamp_ntz, upper timestamp_ntz")
    want = [(1, "a"), (2, "x"), (3, "x"), (4, "b")]
    got = lambda: sorted((r["i"], r["part"]) for r in partitions.route_range(rows, bounds, "ts", "x").collect())
    assert got() == want
    monkeypatch.setattr(ranges, "BROADCAST_ROWS", 0)  # shuffled
    assert got() == want


@pytest.mark.parametrize("kind", ["long", "double", "date", "timestamp_ntz"])
def test_routes_by_any_number_of_bounds(spark, monkeypatch, kind):
    """Narrow and wide parts, gaps and open ends: by the index, shuffled, and against a search in Python."""
    import random
    from bisect import bisect_right

    r = random.Random(6)
    value = {"long": int, "double": float, "date": lambda x: dt.date(2020, 1, 1) + dt.timedelta(days=x), "timestamp_ntz": lambda x: dt.datetime(2020, 1, 1) + dt.timedelta(minutes=x)}[kind]
    edges = sorted(r.sample(range(-300, 300), 40)) + [5000, 5001]
    parts = [(f"p{i}", None if i == 0 else value(a), value(b)) for i, (a, b) in enumerate(zip([0, *edges], edges, strict=False)) if i % 7 != 3] + [("last", value(5001), None)]
    keys = [None, *edges, *(r.randrange(-400, 5200) for _ in range(200))]
    bounds = spark.createDataFrame(parts, f"part string, lower {kind}, upper {kind}")
    rows = spark.createDataFrame([(i, None if k is None else value(k)) for i, k in enumerate(keys)], f"i int, k {kind}")

    def want(k):
        if k is None:
            return "none"
        i = bisect_right(edges, k)
        return "last" if i == len(edges) else f"p{i}" if i % 7 != 3 else "none"

    wide = rows.join(rows.select(F.col("i").alias("j"), F.col("k").alias("b")), F.col("j") == F.col("i") + 1).withColumnRenamed("k", "a")
    low = {p: (a, b) for p, a, b in parts}
    pairs = sorted((i, p) for i, (a, b) in enumerate(zip(keys, keys[1:], strict=False)) for p, (x, y) in low.items()
                   if (x is None or b is None or x < value(b)) and (y is None or a is None or value(a) < y))
    for most in (100_000, 0):
        monkeypatch.setattr(ranges, "BROADCAST_ROWS", most)
        assert {x["i"]: x["part"] for x in partitions.route_range(rows, bounds, "k", "none").collect()} == {i: want(k) for i, k in enumerate(keys)}
        assert sorted((x["i"], x["part"]) for x in partitions.join_overlaps(wide, bounds, ("a", "b"), ("lower", "upper")).collect()) == pairs


def test_routes_by_text_and_decimals(spark, monkeypatch):
    rows = spark.createDataFrame([("a", Decimal("1.10")), ("é", Decimal("2.55")), (None, None), ("zz", Decimal("-3"))], "k string, x decimal(20,2)")
    by_text = spark.createDataFrame([("p", "a", "b"), ("q", "z", None)], "part string, lower string, upper string")
    assert sorted((r["k"] or "", r["part"]) for r in partitions.route_range(rows, by_text, "k", "none").collect()) == [("", "none"), ("a", "p"), ("zz", "q"), ("é", "q")]
    by_number = spark.createDataFrame([("p", Decimal("1.10"), Decimal("2.55"))], "part string, lower decimal(20,2), upper decimal(20,2)")
    assert sorted(r["part"] for r in partitions.route_range(rows, by_number, "x", "none").collect()) == ["none", "none", "none", "p"]
    monkeypatch.setattr(ranges, "BROADCAST_ROWS", 1)
    with pytest.raises(TypeError, match="ranges of strings"):
        partitions.route_range(rows, by_text, "k")


@pytest.mark.parametrize("most", [100_000, 10])
def test_a_far_end_and_wide_ranges(spark, monkeypatch, most):
    """One range up to 9999, hundreds over each other: as many candidate pairs as in the even case, times the tree's height."""
    monkeypatch.setattr(ranges, "BROADCAST_ROWS", most)
    day = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(days=i)
    daily = [(f"d{i}", day(i), day(i + 1)) for i in range(600)] + [("far", day(600), dt.datetime(9999, 12, 31))]
    bounds = spark.createDataFrame(daily, "part string, lower timestamp_ntz, upper timestamp_ntz")
    rows = spark.createDataFrame([(i, day(i % 700) + dt.timedelta(hours=5)) for i in range(1400)], "i int, ts timestamp_ntz")
    assert {r["i"]: r["part"] for r in partitions.route_range(rows, bounds, "ts").collect()} == {i: "far" if i % 700 >= 600 else f"d{i % 700}" for i in range(1400)}
    if most == 10:
        listed = ranges._listed(rows, bounds, "ts", ("lower", "upper"), False)
        assert listed.count() < 20 * 1400
    wide = spark.createDataFrame([(f"w{i}", i, 1000 + i) for i in range(500)], "part string, lower long, upper long")
    at = spark.createDataFrame([(0,), (250,), (999,), (1200,), (1499,)], "k long")
    assert {r["k"]: r["n"] for r in ranges.meet_ranges(at, wide, ("k", "k"), ("lower", "upper")).groupBy("k").agg(F.count("*").alias("n")).collect()} == {0: 1, 250: 251, 999: 500, 1200: 299}


def test_index_of_random_ranges():
    import random

    r = random.Random(8)
    number = lambda: r.choice([None, *range(20)])
    spans = [(number(), number()) for _ in range(150)]
    index = ranges.RangeIndex(pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64()))
    at = [None, *range(-1, 22)]
    got = index.containing(pa.array(at, pa.int64())).to_pylist()
    assert [sorted(x) for x in got] == [[] if v is None else [i for i, (a, b) in enumerate(spans) if (a is None or a <= v) and (b is None or v < b)] for v in at]
    asked = [(number(), number()) for _ in range(80)]
    got = index.meeting(pa.array([a for a, _ in asked], pa.int64()), pa.array([b for _, b in asked], pa.int64())).to_pylist()
    assert [sorted(x) for x in got] == [[i for i, (a, b) in enumerate(spans) if (a is None or e is None or a < e) and (b is None or s is None or s < b)] for s, e in asked]
    assert ranges.RangeIndex(pa.array([], pa.int64()), pa.array([], pa.int64())).containing(pa.array([1])).to_pylist() == [[]]



def test_ledger_rules(spark):
    rows = [(1, "r", "T", "P:chunk:1", "data", "RETRYING", 5, 6, 1, None), (2, "r", "T", "chunk:2", "data", "COMPLETED", 7, 7, 0, None), (3, "r", "T", "Q", "data", "FAILED", 0, 9, 2, "bad"), (4, "r", "U", "", "ddl", "SKIPPED", 0, 0, 0, None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "job_id long, run_id string, table_name string, partition_key string, phase string, state string, rows_copied long, rows_expected long, attempt int, error_message string, started_at timestamp_ntz, finished_at timestamp_ntz")
    assert {r["job_id"]: r["state"] for r in ledger.reset_tables(df).collect()} == {1: "RETRYING", 2: "RETRYING", 3: "FAILED", 4: "SKIPPED"}
    s = ledger.run_summary_chunked(df).first()
    assert (s["retrying"], s["failed"], s["skipped"], s["total"]) == (1, 1, 1, 3)
    again = {r["job_id"]: (r["state"], r["error_message"]) for r in ledger.retry(df).collect()}
    assert again[3] == ("RETRYING", None) and again[2] == ("COMPLETED", None)
    assert [r["job_id"] for r in ledger.pending(df, "r", "data").collect()] == [1]


def test_pipeline_shares(spark):
    """Sums over several events, ties, waits at the border of a tenth, and a table without any time."""
    rows = [("mostly reading", 300, 40, 31, 9, 2, 4), ("mostly reading", 60, 20, 9, 11, 1, 3), ("even", 7, 30, 15, 15, 1, 3), ("idle", 0, 0, 0, 0, 0, 0)]
    events = spark.createDataFrame(rows, "t string, rows long, duration_ms long, read_time_ms long, write_time_ms long, batches long, acquire_wait_ms long")
    got = {r["t"]: r for r in P.bottleneck(P.stats_totals(events, ["t"])).collect()}
    r = got["mostly reading"]
    assert (r["bottleneck"], r["contention"], r["rows_per_s"], r["avg_batch"]) == ("read", True, 360 * 1000 // 60, 120) and abs(r["read_percent"] - 4000 / 60) < 1e-9
    assert (got["even"]["bottleneck"], got["even"]["contention"]) == ("write", False)
    assert (got["idle"]["read_percent"], got["idle"]["rows_per_s"], got["idle"]["contention"]) == (0.0, 0, False)


def test_durations(spark):
    texts = {"1h2m3.5s": 3_723_500, "250ms": 250, "90s": 90_000, "": 0}
    for t, want in texts.items():
        assert spark.range(1).select(P.duration_ms(F.lit(t))).first()[0] == want


def test_functions(spark):
    one = spark.createDataFrame([(_month(2024, 1, 31), "a/b/c/d", None, Decimal("1234567.5"))], "d timestamp_ntz, s string, n string, x decimal(20,2)")
    get = lambda c: one.select(c).first()[0]
    assert get(O.add_months(F.col("d"), 1)) == dt.datetime.combine(dt.date(2024, 2, 29), get(F.col("d")).time() if isinstance(get(F.col("d")), dt.datetime) else dt.time())
    assert get(O.add_months(F.lit("2024-02-29").cast("date"), 1, month_ends=True)) == dt.datetime(2024, 3, 31)
    assert get(O.months_between(F.lit("2024-02-29").cast("timestamp_ntz"), F.col("d"))) == 1
    assert [get(O.instr_from(F.col("s"), "/", p, k)) for p, k in [(1, 1), (1, 3), (3, 1), (1, 4)]] == [2, 6, 4, 0]
    assert get(O.decode(F.col("n"), F.lit(None), F.lit("null"), F.lit("other"))) == "other"
    assert get(O.decode(F.col("n"), F.lit(None), F.lit("null"), F.lit("other"), null_safe=True)) == "null"
    assert get(O.to_char_number(F.col("x"), "FM999,999,990.00")) == "1,234,567.50"
    assert get(O.to_date(F.lit("no"), "DD.MM.YYYY")) is None
    assert get(O.to_number(F.lit("x1"))) is None


def test_reconcile_both_sides(spark):
    a, b = spark.createDataFrame([("p", 1), ("q", 2), (None, 3)], "part string, k int"), spark.createDataFrame([("p", 1), ("r", 5)], "part string, k int")
    got = {r["part"]: (r["source_rows"], r["target_rows"], r["match"]) for r in reconcile.reconcile(a, b, ["part"]).collect()}
    assert got == {"p": (1, 1, True), "q": (1, 0, False), "r": (0, 1, False), None: (1, 0, False)}
    assert reconcile.summary(reconcile.reconcile(a, a, ["part"])).first()["all_match"]


def test_checksums_and_hooks(spark):
    rows = [(i % 4, None if i % 5 == 0 else f"s{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "k int, s string")
    sums = lambda d: {r["column_name"]: r["checksum"] for r in reconcile.column_checksums(d, ["k", "s"]).collect()}
    other = df.withColumn("s", F.when(F.col("s") == "s7", "s8").otherwise(F.col("s")))
    assert sums(df) == sums(df.orderBy(F.desc("s"))) and sums(df)["k"] == sums(other)["k"] and sums(df)["s"] != sums(other)["s"]
    assert sums(df.unionByName(df))["k"] == 2 * sums(df)["k"] != 0 and sums(df.limit(0)) == {"k": 0, "s": 0}
    assert [r["t"] for r in shape.transform_rows(df, lambda d: d.where("k = 1").select(F.upper("s").alias("t"))).orderBy("t").limit(1).collect()] == ["S1"] or shape.transform_rows(df, lambda d: d.limit(0)).count() == 0


def test_integrity_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (None, 2), (3, 9)], "k int, v int")
    spec = TableSpec("t", ("k",), ("k", "v"), (("v",),), (), ("v < 5",))
    got = {(r["rule"], r["name"]): r["violations"] for r in integrity.check_all(df, spec, {}).collect()}
    assert got == {("primary_key", "k"): 2, ("not_null", "k"): 1, ("not_null", "v"): 1, ("unique", "v"): 1, ("check", "v < 5"): 1}


def test_levels_and_cycles(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "d"), ("a", "zz")], "node string, parent string")
    assert {r["node"]: r["level"] for r in hierarchy.dependency_levels(nodes, edges).collect()} == {"a": 2, "b": 1, "c": 0, "d": 0}
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string")
    assert hierarchy.dependency_levels(nodes, ring, max_depth=5).count() == 4


def test_levels_have_no_limit(spark):
    nodes = spark.range(200).select(F.col("id").alias("node"))
    got = hierarchy.dependency_levels(nodes, nodes.select("node", (F.col("node") - 1).alias("parent"))).collect()
    assert len(got) == 200 and all(r["node"] == r["level"] for r in got)


def test_levels_of_deep_replies(spark, tmp_path):
    from ferryline.queries import QUERIES

    spark.range(150).select(F.lit(7).alias("conv_id"), F.col("id").cast("int").alias("turn")).write.parquet(str(tmp_path / "conversations.parquet"))
    assert {r["node"]: r["level"] for r in QUERIES["dependency_levels_replies"](spark, str(tmp_path)).collect()} == {f"7:{i}": i for i in range(150)}


def test_levels_of_random_graphs(spark):
    import random

    r = random.Random(5)
    edges = {(a, b) for _ in range(70) for a, b in [sorted(r.sample(range(60), 2), reverse=True)]} | {(60 + i, 59 + i) for i in range(1, 20)}
    rings = {(90, 91), (91, 92), (92, 90), (93, 90), (94, 93), (94, 1), (95, 94), (96, 97), (97, 96), (96, 3), (98, 5), (98, 96), (99, 98)}
    parents: dict[int, set] = {}
    for a, b in edges | rings:
        parents.setdefault(a, set()).add(b)

    def level(n, path=()):
        if n in path:
            return None
        below = [level(p, (*path, n)) for p in parents.get(n, ())]
        return None if None in below else max(below, default=-1) + 1

    nodes = spark.range(100).select(F.col("id").alias("node"))
    table = spark.createDataFrame(sorted(edges | rings), "node long, parent long")
    assert {x["node"]: x["level"] for x in hierarchy.dependency_levels(nodes, table).collect()} == {n: level(n) for n in range(100)}
    assert {x["node"]: x["level"] for x in hierarchy.dependency_levels(nodes, table, 3).collect()} == {n: 3 if level(n) is None else min(level(n), 3) for n in range(100)}


def test_walks_have_no_row_or_depth_limit(spark):
    name = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(name)
    spark.conf.set(name, 100)
    try:
        chain = spark.range(1100).select(F.col("id").alias("n"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
        got = {r["node"]: r for r in hierarchy.descend(chain, "n", "p").collect()}
    finally:
        spark.conf.set(name, old)
    assert len(got) == 1100 and all(r["level"] == n + 1 and r["path"] == "/".join(map(str, range(n + 1))) for n, r in got.items())
    assert [n for n, r in got.items() if r["is_leaf"]] == [1099]


def test_walks_over_odd_edges(spark):
    edges = [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("b", "d"), ("d", "d"), ("x", "y"), ("y", "x"), ("o", "none"), (None, "a"), (None, None), ("a", None)]
    got = sorted((r["node"] or "", r["level"], r["path"] or "", r["is_leaf"]) for r in hierarchy.descend(spark.createDataFrame(edges, "n string, p string"), "n", "p").collect())
    once = [("a", 1, "a", False), ("b", 2, "a/b", False), ("c", 2, "a/c", False), ("d", 3, "a/b/d", False), ("d", 3, "a/c/d", False), ("b", 4, "a/c/d/b", False)]
    assert got == sorted([*once, *once, ("", 1, "", True)])


def test_load_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, p string")
    assert sink.load(a, path, partition_by=["p"]) == "COMPLETED"
    for _ in range(2):
        sink.load(spark.createDataFrame([(9, "y")], "k long, p string"), path, "truncate_partition", ["p"])
    assert sorted((r["k"], r["p"]) for r in spark.read.parquet(path).collect()) == [(1, "x"), (9, "y")]
    assert sink.load(a, path, "skip") == "SKIPPED" and sink.resolve_mode(None) == "recreate"
    with pytest.raises(ValueError, match="target mode"):
        sink.resolve_mode("merge")
    assert sink.exists(spark, path) and not sink.exists(spark, str(tmp_path / "none"))


# --- whole tables


def test_numbers_of_skewed_keys(spark):
    """One key of a third of the rows, an outlier, keys that a long can barely tell apart: numbers without gaps, even tasks."""
    keys = [7] * 4000 + [9_000_000_000_000_000_000, -9_000_000_000_000_000_000, None] + list(range(100, 8000))
    df = spark.createDataFrame([(k, i % 3, i) for i, k in enumerate(keys)], "k long, g int, i long").repartition(5)
    rows = numbered(df, "k", ["i"], total="n").collect()
    assert [r["i"] for r in sorted(rows, key=lambda r: r["row_no"])] == [i for _, i in sorted(((k is not None, k or 0), i) for i, k in enumerate(keys))]
    assert {r["n"] for r in rows} == {len(keys)}
    for g in range(3):
        mine = sorted(r["row_no"] for r in numbered(df, "k", by=["g"]).where(F.col("g") == g).collect())
        assert mine == list(range(len(mine)))
    assert numbered(df.limit(0), "k").count() == 0 and numbered(spark.createDataFrame([("b",), ("a",), (None,)], "k string"), "k").orderBy("row_no").first()["k"] is None
    sizes = [r["count"] for r in df.withColumn("_input", F.monotonically_increasing_id()).repartitionByRange(4, "k", "_input").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * len(keys) / 4


def test_passages_in_texts(spark):
    from ferryline.operators.contain import containing

    texts = ["the cat sat on the mat", "concatenate the mats", " ab  cd ", None, "", "xé🙂z and more the the", "cat\nsat on", "a b c d e f", "the of the of the"]
    passages = ["cat sat on", "cat", "at", "b", "é🙂", "the", " the ", "on the mat", "ab  cd", "", None, "a b c", "sat", "zz top hat", "of the", "cat\nsat on", "e f"]
    a = spark.createDataFrame(list(enumerate(texts)), "t int, text string")
    b = spark.createDataFrame(list(enumerate(passages)), "p int, passage string")
    got = sorted(map(tuple, containing(a, "t", "text", b, "p", "passage").collect()))
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(passages) if t is not None and p and p in t)
    assert containing(a, "t", "text", b.limit(0), "p", "passage").count() == 0


def test_walks_in_small_batches(spark):
    """A unit longer than a batch keeps its state; nulls are a unit."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        df = spark.createDataFrame([(None if i % 5 == 0 else i % 2, i, "x" * (i % 11)) for i in range(200)], "c int, k int, s string")
        got = {(r["c"], r["k"]): r["batch_no"] for r in shape.batches_by_bytes(df, "c", "k", 9, 250).collect()}
    finally:
        spark.conf.set(name, old)
    want = {}
    for c in (None, 0, 1):
        batch = n = total = 0
        for i in range(200):
            if (None if i % 5 == 0 else i % 2) == c:
                want[(c, i)] = batch
                n, total = n + 1, total + i % 11 + 16 + (4 if c is None else 16)
                if n >= 9 or total >= 250:
                    batch, n, total = batch + 1, 0, 0
    assert got == want


# --- sources and sinks


def test_database_tables(spark, tmp_path):
    """Modes, batches, predicates, columns and filters over an embedded database."""
    from ferryline.sources import scan

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("g"), F.concat(F.lit("n"), "id").alias("name"))
    read = lambda **k: scan.scan_jdbc(spark, url, "t", **driver, **k)
    assert sink.load_jdbc(rows, url, "t", batch_size=7, **driver) == "COMPLETED" and read().count() == 100
    parts = read(columns=["k"], where="g < 2", predicates=[f'"k" {x}' for x in ("< 40", "between 40 and 59", ">= 60")])
    assert parts.rdd.getNumPartitions() == 3 and sorted(r["k"] for r in parts.collect()) == [k for k in range(100) if k % 3 < 2]
    sink.load_jdbc(rows.where("k < 5"), url, "t", "append", **driver)
    assert read().count() == 105
    sink.load_jdbc(rows.where("k < 5"), url, "t", "truncate", **driver)
    assert sorted(r["k"] for r in read().collect()) == [0, 1, 2, 3, 4]
    sink.load_jdbc(rows.select("k").where("k < 3"), url, "t", **driver)
    assert read().count() == 3 and len(read().columns) == 1 and sink.load_jdbc(rows, url, "t", "skip", **driver) == "SKIPPED"


def test_estimates(spark, tmp_path):
    from ferryline.sources import scan

    spark.sql(f"create table counted (k long) using parquet location '{tmp_path}/counted'")
    try:
        spark.range(30).select(F.col("id").alias("k")).write.insertInto("counted")
        assert scan.table_statistics(spark, "counted") is None
        spark.sql("analyze table counted compute statistics")
        spark.range(5).select(F.col("id").alias("k")).write.insertInto("counted")
        df = spark.table("counted")
        known = scan.table_statistics(spark, "counted")
        assert [tuple(scan.estimate_rows(df, n).first()) for n in (30, 0, None)] == [(30, True), (35, False), (35, False)] and known in (30, None)
    finally:
        spark.sql("drop table counted")


def test_shared_folder_is_needed_on_clusters(spark):
    class Cluster:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Cluster(), type("C", (), {"get": staticmethod(lambda *a: None)})()

    with pytest.raises(ValueError, match="checkpoint"):
        sink.scratch(Session(), "x")
    Cluster.master = "local[2]"
    assert "/ferryline/x-" in sink.scratch(Session(), "x")


# --- rules on source texts and defaults


def test_constructs_of_code(spark):
    cases = {
        "start with a connect  BY prior b": ["CONNECT BY"], "a.x = b.x( +)": ["outer join (+)"], "merge into t": ["MERGE INTO"], "open c for select": ["cursor use"], "Open c1;": ["cursor use"], "fetch c into v": ["cursor use"], "close c ;": ["cursor use"],
        "open door, close to me, fetch it": [], "type t is table of x": ["TYPE IS"], "the type of it is table": [], "v emp.name%type; r emp%rowtype": ["%TYPE"], "commit;": ["COMMIT"], "we commit to it": [], "sql%rowcount": ["SQL%ROWCOUNT"],
        "instr(a, 'b', 3)": ["INSTR with position"], "instr(a, 'b')": [], "rownum <= 3 and rowid > 1": ["ROWID", "ROWNUM"], "dbms_job.submit; dbms_scheduler.run": ["DBMS_JOB", "DBMS_SCHEDULER"], "pragma autonomous_transaction;": ["AUTONOMOUS_TRANSACTION"],
        "forall i in 1..n": ["FORALL"], "select x bulk collect into y": ["BULK COLLECT"], "unpackaged": [], "": [], None: [],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", textjobs.warnings(F.col("t")).alias("w")).collect()}
    assert {t: sorted(got[i]) for i, t in enumerate(cases)} == {t: sorted(w) for t, w in cases.items()}


def test_rewrites_of_code(spark):
    cases = {
        "select sysdate from dual": "select CURRENT_DATE", "a minus b": "a EXCEPT b", "x number(9,2), y pls_integer, z binary_integer": "x NUMERIC(9,2), y INTEGER, z INTEGER", "b blob, c nclob, v nvarchar2(5)": "b BYTEA, c TEXT, v VARCHAR(5)",
        "d date; e date := x; f date not null": "d TIMESTAMP; e TIMESTAMP := x; f TIMESTAMP not null", "to_date(a) date '2020-01-01'": "to_date(a) date '2020-01-01'", "pragma exception_init(e, -20);": "", "pragma autonomous_transaction;": "pragma autonomous_transaction;",
        "exit when c%notfound or d%found": "exit when NOT FOUND or FOUND", "p(a in out nocopy t)": "p(a INOUT t)", "x := 'sysdate from dual' || sysdate -- minus\nminus /* number": "x := 'sysdate from dual' || CURRENT_DATE -- minus\nEXCEPT /* number", "a.Sq.nextval + t.x": "nextval('a.sq') + t.x", "": "", None: None,
        "f return number deterministic is": "f return NUMERIC is", "p authid definer as n := sql%rowcount; cursor c is select 1": "p SECURITY DEFINER as n := _row_count; c CURSOR FOR SELECT 1", "q'[it's from dual]' from dual": "q'[it's from dual]'", "when login_denied or invalid_cursor or value_error": "when insufficient_privilege or invalid_cursor_state or data_exception",
        "when invalid_number or cursor_already_open or too_many_rows": "when invalid_text_representation or duplicate_cursor or too_many_rows", "my_number dates": "my_number dates",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", textjobs.normalise(F.col("t")).alias("n")).collect()} == cases


def test_default_values(spark):
    at = F.lit("2024-03-01 10:20:30.5").cast("timestamp_ntz")
    get = lambda text: spark.range(1).select(O.default_value(text, at)).first()[0]
    day = dt.datetime(2024, 3, 1, 10, 20, 30)
    assert get("sysdate") == day and get(" SYSDATE + 30 ") == day + dt.timedelta(days=30) and get("SYSDATE-1/24") == day - dt.timedelta(hours=1) and get("sysdate - 0.5") == day - dt.timedelta(hours=12)
    assert get("TRUNC(SYSDATE)") == dt.datetime(2024, 3, 1) and get("SYSTIMESTAMP") == day.replace(microsecond=500_000)
    assert get("TO_DATE(' 2020-02-29', 'YYYY-MM-DD')") == dt.datetime(2020, 2, 29) and get("'it''s'") == "it's" and get("N''") == "" and get("-12") == -12 and get("1.50") == Decimal("1.50")
    assert get("NULL") is None and get("user") and len(get("SYS_GUID()")) >= 32
    with pytest.raises(ValueError, match="default value"):
        O.default_value("f(x)")


def test_clock_functions(spark):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = spark.range(1).select(O.sysdate().alias("d"), O.systimestamp().cast("timestamp_ntz").alias("t"), O.session("USER").alias("u"), O.sys_guid().alias("g")).first()
    assert abs((row["d"] - now).total_seconds()) < 60 and row["d"].microsecond == 0 and abs((row["t"] - now).total_seconds()) < 60 and row["u"]
    assert spark.range(50).select(O.sys_guid().alias("g")).distinct().count() == 50
