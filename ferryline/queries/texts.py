"""Source-text jobs, hierarchies and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.operators import hierarchy, rings, textjobs
from ferryline.operators.order import numbered
from ferryline.queries.registry import query, table
from ferryline.sources import merge, sink
from ferryline.sources.sink import cut

# The corpus holds prose, so these flags and rewrites stand for constructs: words and marks that it has.
_FLAGS = {"shout": r"[A-Z]{4,}!!", "rights": r"\bAll rights reserved\b", "mail": r"[\w.]+@[\w.]+\.\w+", "percent": r"%%%", "the of": r"\bthe\s+of\b"}
_REWRITES = [(r"\ball rights reserved\b\.?", ""), (r"\bthe\s+of\b", "of"), (r"[%&$#*]{3}", ""), (r"[ \t]+", " ")]


def _flag(p: str) -> str:
    return f"regexp_matches(text, '(?i){p}')"


def _rewritten(sql: str, rewrites: list[tuple[str, str]]) -> str:
    for p, by in rewrites:
        sql = f"regexp_replace({sql}, '(?i){p}', '{by}', 'g')"
    return sql


# Lines of database code, as the tables hold none; @ stands for a name made of the row's id.
_CODE = [
    "BEGIN OPEN @ FOR SELECT x FROM DUAL; FETCH @ INTO v; CLOSE @; END;", "@ NUMBER(10) := NVL(a, 0); d DATE; PRAGMA EXCEPTION_INIT(e, -1); n PLS_INTEGER;", "SELECT SYSDATE FROM DUAL MINUS SELECT @ FROM t WHERE ROWNUM < 5",
    "EXCEPTION WHEN DUP_VAL_ON_INDEX THEN NULL; WHEN ZERO_DIVIDE THEN @ := 'COMMIT;'; COMMIT;", "open door; fetch the ball; TYPE @ IS TABLE OF emp%ROWTYPE; PRAGMA AUTONOMOUS_TRANSACTION;",
    "PROCEDURE @(a IN OUT NOCOPY CLOB, b VARCHAR2(9)) AUTHID CURRENT_USER IS BEGIN EXIT WHEN @%NOTFOUND; END;", "SELECT a.x FROM a, b WHERE a.id = b.id (+) AND INSTR(@, ';', 2) > 0 CONNECT  BY PRIOR id = up", "x := dbms_sql.open_cursor; MERGE\nINTO @; n := SQL%ROWCOUNT;",
    "FUNCTION @ RETURN NUMBER DETERMINISTIC RESULT_CACHE RELIES_ON (t) IS CURSOR c IS SELECT 1 FROM DUAL;", "INSERT INTO t VALUES (Seq_@.NEXTVAL, App.Seq_@.currval, 'Seq.NEXTVAL'); SELECT \"ROWID\" FROM @ -- ROWNUM\n;", "SELECT INSTR(a, f(b), 3), INSTR(a, ',', b) BULK COLLECT INTO @ FROM t; FORALL i IN 1..n NULL;",
]
_FIRST, _SECOND, _WAY = f"page_id % {len(_CODE)}", f"(page_id * 7 + 3) % {len(_CODE) + 2} % {len(_CODE)}", "page_id % 13 % 4"


def _line_sql(at: str) -> str:
    literals = ("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in _CODE)
    return f"replace(case {at} " + " ".join(f"when {i} then {x}" for i, x in enumerate(literals)) + " end, '@', 'n' || page_id)"


_CODE_SQL = f"""{_line_sql(_FIRST)} || case {_WAY} when 0 then ' ' || {_line_sql(_SECOND)} when 1 then ' /* ' || {_line_sql(_SECOND)} || ' */ '
  when 2 then ' x := ''' || replace({_line_sql(_SECOND)}, '''', '''''') || '''; ' else ' -- ' || replace({_line_sql(_SECOND)}, chr(10), ' ') || chr(10) end || coalesce(html, '')"""


def _code(spark: SparkSession, d: str) -> DataFrame:
    """Each page's source behind two lines of code, of which the second may stand in a comment or a literal."""
    name = F.concat(F.lit("n"), F.col("page_id").cast("string"))
    line = lambda at: F.replace(F.element_at(F.array(*map(F.lit, _CODE)), F.expr(f"int({at}) + 1")), F.lit("@"), name)
    second, way = line(_SECOND), F.expr(_WAY)
    comment, literal = F.concat(F.lit(" /* "), second, F.lit(" */ ")), F.concat(F.lit(" x := '"), F.replace(second, F.lit("'"), F.lit("''")), F.lit("'; "))
    to_end = F.concat(F.lit(" -- "), F.replace(second, F.lit("\n"), F.lit(" ")), F.lit("\n"))
    rest = F.when(way == 0, F.concat(F.lit(" "), second)).when(way == 1, comment).when(way == 2, literal).otherwise(to_end)
    return table(spark, d, "pages").select("page_id", F.concat(line(_FIRST), rest, F.coalesce("html", F.lit(""))).alias("text"))


_FOUND = ", ".join(f"case when {_flag(p)} then '{n}' end" for n, p in _FLAGS.items())


@query("text_assemble", "select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn, coalesce(text, '')) as text, count(*) as n_lines from conversations group by 1")
def text_assemble(spark: SparkSession, d: str) -> DataFrame:
    return textjobs.assemble(table(spark, d, "conversations"), ["conv_id"], "turn", "text")


@query("text_flags", f"select doc_id, list_filter([{_FOUND}], lambda x: x is not null) as warnings from documents")
def text_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", textjobs.warnings(F.col("text"), _FLAGS).alias("warnings"))


# The SQL finds literals, quoted names and comments by one expression and each construct by another, one pass each.
_SKIP_SQL = r"""'[^']*(?:'|\z)|"[^"]*(?:"|\z)|--[^\n]*|/\*(?s:.*?)(?:\*/|\z)""".replace("'", "''")
_SOURCE_SQL = f"(select page_id, regexp_replace(t, '{_SKIP_SQL}', ' ', 'g') as text from (select page_id, {_CODE_SQL} as t from pages))"


def _phrase_sql(phrase: str) -> str:
    """A phrase as an expression: words part by white space, marks stand anywhere."""
    return r"\s*".join({"@": r"\b\w+\b", "…": "[^(),]*"}.get(x, rf"\b{x}\b" if x[0].isalnum() else f"[{x}]") for x in phrase.split())


_SOURCE_FOUND = {n: "regexp_matches(text, '(?i)" + "|".join(map(_phrase_sql, ps)) + "')" for n, ps in textjobs.CONSTRUCTS.items()}
_SOURCE_FLAGS = ", ".join(f"case when {x} then '{n}' end" for n, x in _SOURCE_FOUND.items())


def _pieces_sql(sql: str, pattern: str) -> str:
    """SQL for the list of what lies between the finds of a pattern, and the finds, as structs of x and y."""
    return f"list_transform(list_zip(regexp_split_to_array({sql}, '{pattern}'), regexp_extract_all({sql}, '{pattern}')), lambda z: {{'x': z[1], 'y': z[2]}})"


_CALL_SQL = r"lower(regexp_extract(y, '(\w+)$', 1)) || '(''' || lower(regexp_extract(y, '^(.*)\.', 1)) || ''')'"


@query("text_flags_source", f"select page_id, list_filter([{_SOURCE_FLAGS}], lambda x: x is not null) as warnings from {_SOURCE_SQL}")
def text_flags_source(spark: SparkSession, d: str) -> DataFrame:
    """The constructs of database code."""
    return _code(spark, d).select("page_id", textjobs.warnings(F.col("text")).alias("warnings"))


@query("text_normalise_source", f"""
with t as (select page_id, {_CODE_SQL} as text from pages),
p as (select page_id, unnest({_pieces_sql("text", _SKIP_SQL)}) as z, generate_subscripts(regexp_split_to_array(text, '{_SKIP_SQL}'), 1) as i from t),
r as (select page_id, i, z.y as literal, {_rewritten("z.x", textjobs.REWRITES)} as x from p),
q as (select page_id, i, literal, unnest({_pieces_sql("x", textjobs.SEQUENCE)}) as z, generate_subscripts(regexp_split_to_array(x, '{textjobs.SEQUENCE}'), 1) as j from r),
s as (select page_id, i, any_value(literal) as literal, string_agg(z.x || coalesce({_CALL_SQL.replace("(y,", "(z.y,")}, ''), '' order by j) as x from q group by 1, 2)
select page_id, string_agg(x || coalesce(literal, ''), '' order by i) as text from s group by 1""")
def text_normalise_source(spark: SparkSession, d: str) -> DataFrame:
    return _code(spark, d).select("page_id", textjobs.normalise(F.col("text")).alias("text"))


@query("text_normalise", f"select doc_id, {_rewritten('text', _REWRITES)} as text from documents")
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", textjobs.normalise(F.col("text"), _REWRITES).alias("text"))


@query("text_census", "select lang, count(*) as n_texts, count(*) filter (" + " or ".join(_flag(p) for p in _FLAGS.values()) + ") as n_flagged, " + ", ".join(f'count(*) filter ({_flag(p)}) as "{n}"' for n, p in _FLAGS.items()) + " from documents group by 1")
def text_census(spark: SparkSession, d: str) -> DataFrame:
    return textjobs.census(table(spark, d, "documents"), "lang", "text", _FLAGS)


_SOURCE_EACH = ", ".join(f"count(*) filter ({x}) as \"{n}\"" for n, x in _SOURCE_FOUND.items())
_SOURCE_ANY = " or ".join(_SOURCE_FOUND.values())


@query("text_census_source", f"select cast(page_id % 4 as varchar) as kind, count(*) as n_texts, count(*) filter ({_SOURCE_ANY}) as n_flagged, {_SOURCE_EACH} from {_SOURCE_SQL} group by 1")
def text_census_source(spark: SparkSession, d: str) -> DataFrame:
    """The constructs of database code per kind of object."""
    return textjobs.census(_code(spark, d).withColumn("kind", (F.col("page_id") % 4).cast("string")), "kind", "text")


@query("dependency_levels", """
with recursive e(node, parent) as (values ('lineitem', 'orders'), ('lineitem', 'part'), ('lineitem', 'supplier'), ('orders', 'customer'), ('customer', 'nation'), ('supplier', 'nation'), ('nation', 'region')),
w(node, level) as (select node, 0 from (values ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem')) t(node)
  union select e.node, w.level + 1 from w join e on e.parent = w.node)
select node, cast(max(level) as integer) as level, any_value(n.n) as n_rows from w join (select 'region' as t, count(*) as n from region union all select 'nation', count(*) from nation union all select 'customer', count(*) from customer
  union all select 'supplier', count(*) from supplier union all select 'part', count(*) from part union all select 'orders', count(*) from orders union all select 'lineitem', count(*) from lineitem) n on n.t = node group by 1""")
def dependency_levels(spark: SparkSession, d: str) -> DataFrame:
    from ferryline.operators.profile import profile_tables

    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    edges = spark.createDataFrame([("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("orders", "customer"), ("customer", "nation"), ("supplier", "nation"), ("nation", "region")], "node string, parent string")
    counts = profile_tables({n: table(spark, d, n) for n in names}).select(F.col("table_name").alias("node"), "n_rows")
    return hierarchy.dependency_levels(counts.select("node"), edges).join(counts, "node").select("node", "level", "n_rows")


@query("dependency_levels_replies", """
with t as (select distinct conv_id, turn from conversations),
g as (select conv_id, turn, turn - row_number() over (partition by conv_id order by turn) as run from t)
select conv_id || ':' || turn as node, cast(row_number() over (partition by conv_id, run order by turn) - 1 as integer) as level from g""")
def dependency_levels_replies(spark: SparkSession, d: str) -> DataFrame:
    """Levels over reply chains: each turn refers to the one before, if it is there."""
    turns = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    node = lambda turn: F.concat_ws(":", "conv_id", turn)
    return hierarchy.dependency_levels(turns.select(node("turn").alias("node")), turns.select(node("turn").alias("node"), node(F.col("turn") - 1).alias("parent")))


@query("levels_through_rings", """
with t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from (select distinct conv_id, turn from conversations)),
r as (select *, conv_id % 3 = 0 and n >= 4 and i < 4 as ring from t)
select conv_id || ':' || i as node, case when ring then conv_id || ':0' else conv_id || ':' || i end as component,
  cast(case when ring then 0 when conv_id % 3 = 0 and n >= 4 then i - 3 else i end as integer) as level from r""")
def levels_through_rings(spark: SparkSession, d: str) -> DataFrame:
    """Each turn refers to the one before; in every third conversation the first refers to the fourth, which makes a ring."""
    turns = numbered(table(spark, d, "conversations").select("conv_id", "turn").distinct(), "turn", by=["conv_id"], into="i", total="n")
    node = lambda i: F.concat_ws(":", "conv_id", i)
    turns = cut(turns.select("conv_id", "n", "i"), "turns")
    first = turns.where("conv_id % 3 = 0 and n >= 4 and i = 0").select(node("i").alias("node"), node(F.lit(3)).alias("parent"))
    edges = turns.where("i > 0").select(node("i").alias("node"), node(F.col("i") - 1).alias("parent")).unionByName(first)
    return rings.levels_through_rings(turns.select(node("i").alias("node")), edges)


@query("hierarchy", """
with recursive e as (select distinct conv_id || ':' || turn as node, case when turn > 0 then conv_id || ':' || (turn - 1) end as parent from conversations),
w(node, level, path) as (select node, 1, node from e where parent is null union all select e.node, w.level + 1, w.path || '/' || e.node from e join w on e.parent = w.node)
select node, level, path, node not in (select parent from e where parent is not null) as is_leaf from w""")
def hierarchy_query(spark: SparkSession, d: str) -> DataFrame:
    node = lambda turn: F.concat_ws(":", "conv_id", turn)
    edges = table(spark, d, "conversations").select(node("turn").alias("node"), F.when(F.col("turn") > 0, node(F.col("turn") - 1)).alias("parent")).distinct()
    return hierarchy.descend(edges, "node", "parent")


@query("upsert", """
with c as (select c_custkey + 100 as k, 'new-' || c_name as n, c_acctbal + 1 as b from customer where c_custkey % 3 = 0)
select coalesce(k, c_custkey) as c_custkey, coalesce(n, c_name) as c_name, coalesce(b, c_acctbal) as c_acctbal from customer full join c on c_custkey = k""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = rows.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 100).alias("c_custkey"), F.concat(F.lit("new-"), "c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return merge.upsert(rows, changes, ["c_custkey"])


@query("merge_partitioned", """
with o as (select o_orderkey, o_totalprice, strftime(o_orderdate, '%Y') as part from orders where o_orderkey % 2 = 0),
c as (select o_orderkey, o_totalprice + 1 as o_totalprice, case when o_orderkey % 5 = 0 then '1994' else strftime(o_orderdate, '%Y') end as part from orders where strftime(o_orderdate, '%Y') = '1995')
select * from c union all select * from o where o_orderkey not in (select o_orderkey from c)""")
def merge_partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Even orders by year; all of 1995 change or come anew, and some of them move to 1994."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy").alias("part"))
    path = sink.scratch(spark, "merge")
    sink.load(orders.where("o_orderkey % 2 = 0"), path, partition_by=["part"])
    changes = orders.where("part = '1995'").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(F.col("o_orderkey") % 5 == 0, "1994").otherwise(F.col("part")).alias("part"))
    merge.merge_partitions(spark, path, changes, ["o_orderkey"], "part")
    return spark.read.parquet(path).withColumn("part", F.col("part").cast("string"))
