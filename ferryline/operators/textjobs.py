"""Jobs over tables of source text: assembly from lines, flags, rewrites, census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.operators import lexer

# Constructs of the source dialect that need work by hand, each with the phrases that show it. In a phrase
# words are keywords, @ is any name, … is any run without brackets and commas, and other characters stand for themselves.
CONSTRUCTS = {
    "CONNECT BY": ["CONNECT BY"], "outer join (+)": ["( + )"], "MERGE INTO": ["MERGE INTO"], "PACKAGE": ["PACKAGE"], "COMMIT": ["COMMIT ;", "COMMIT WORK"],
    "%TYPE": ["% TYPE", "% ROWTYPE"], "BULK COLLECT": ["BULK COLLECT"], "FORALL": ["FORALL"], "SYS_REFCURSOR": ["SYS_REFCURSOR"],
    "TYPE IS": ["TYPE @ IS TABLE", "TYPE @ IS RECORD", "TYPE @ IS VARRAY"], "cursor use": ["OPEN @ FOR", "OPEN @ ;", "FETCH @ INTO", "FETCH @ BULK", "CLOSE @ ;"],
    "SAVEPOINT": ["SAVEPOINT"], "PIPELINED": ["PIPELINED"], "UTL_FILE": ["UTL_FILE"], "DBMS_SQL": ["DBMS_SQL"], "DBMS_JOB": ["DBMS_JOB"], "DBMS_SCHEDULER": ["DBMS_SCHEDULER"],
    "DBMS_CRYPTO": ["DBMS_CRYPTO"], "ROWID": ["ROWID"], "AUTONOMOUS_TRANSACTION": ["AUTONOMOUS_TRANSACTION"], "RESULT_CACHE": ["RESULT_CACHE"], "SQL%ROWCOUNT": ["SQL % ROWCOUNT"], "ROWNUM": ["ROWNUM"],
    "INSTR with position": ["INSTR ( … , … ,"],
}
# Names that have another name in the target.
NAMES = {
    "SYSTIMESTAMP": "CURRENT_TIMESTAMP", "SYSDATE": "CURRENT_DATE", "MINUS": "EXCEPT",
    "VARCHAR2": "VARCHAR", "NVARCHAR2": "VARCHAR", "NUMBER": "NUMERIC", "PLS_INTEGER": "INTEGER", "BINARY_INTEGER": "INTEGER", "CLOB": "TEXT", "NCLOB": "TEXT", "BLOB": "BYTEA",
    "DUP_VAL_ON_INDEX": "unique_violation", "ZERO_DIVIDE": "division_by_zero", "TOO_MANY_ROWS": "too_many_rows", "VALUE_ERROR": "data_exception", "INVALID_NUMBER": "invalid_text_representation",
    "LOGIN_DENIED": "insufficient_privilege", "CURSOR_ALREADY_OPEN": "duplicate_cursor", "INVALID_CURSOR": "invalid_cursor_state",
}
# Pragmas that only instruct the source's compiler.
PRAGMAS = ["EXCEPTION_INIT", "INLINE", "RESTRICT_REFERENCES", "SERIALLY_REUSABLE", "UDF"]


#: Rewrites that need no context, in order; \1 is the first group.
REWRITES = [
    (r"\s+FROM\s+DUAL\b", ""), (rf"\bPRAGMA\s+({'|'.join(PRAGMAS)})\b[^;]*;", ""), (r"\bNOCOPY\s+", ""), (r"\bIN\s+OUT\b", "INOUT"), (r"\s+DETERMINISTIC\b", ""), (r"\s+RESULT_CACHE\b(\s+RELIES_ON\s*\([^)]*\))?", ""),
    (r"\bAUTHID\s+CURRENT_USER\b", "SECURITY INVOKER"), (r"\bAUTHID\s+DEFINER\b", "SECURITY DEFINER"), (r"\bCURSOR\s+(\w+)\s+IS\s+SELECT\b", r"\1 CURSOR FOR SELECT"), (r"\bSQL%ROWCOUNT\b", "_row_count"),
    (r"\b\w+%NOTFOUND\b", "NOT FOUND"), (r"\b\w+%FOUND\b", "FOUND"),
    (r"\bDATE(\s*(;|,|\)|:=|NOT\b|DEFAULT\b))", r"TIMESTAMP\1"), *((rf"\b{old}\b", new) for old, new in NAMES.items()),
]
#: A sequence's next or current value.
SEQUENCE = r"(?i)\b(?:\w+\.)+(?:NEXTVAL|CURRVAL)\b"


def assemble(lines: DataFrame, by: list[str], line_no: str, text: str) -> DataFrame:
    """One text per object from its numbered lines."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("n"), F.coalesce(text, F.lit("")).alias("t"))))
    return lines.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_lines"))


def warnings(text: Column, flags: dict[str, str] | None = None) -> Column:
    """Array of the constructs found in a text, outside its literals and comments; or of the flags whose expression finds."""
    if flags is None:
        return lexer.warnings(text, CONSTRUCTS)
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(name)) for name, p in flags.items()]))


def _rewritten(text: Column, rewrites: list[tuple[str, str]]) -> Column:
    for pattern, by in rewrites:
        text = F.regexp_replace(text, f"(?i){pattern}", by.replace("\\1", "$1"))
    return text


def sequence_calls(code: Column) -> Column:
    """References to a sequence's values as calls with its name in small letters."""
    call = lambda ref: F.concat(F.lower(F.regexp_extract(ref, r"(\w+)$", 1)), F.lit("('"), F.lower(F.regexp_extract(ref, r"^(.*)\.", 1)), F.lit("')"))
    return lexer.pieces(code, SEQUENCE, lambda between: between, call)


def normalise(text: Column, rewrites: list[tuple[str, str]] | None = None) -> Column:
    """The text after all rewrites, blind to case, in their order. The library's own, and calls of sequences, leave
    literals, quoted names and comments alone."""
    if rewrites is not None:
        return _rewritten(text, rewrites)
    return lexer.pieces(text, lexer.SKIP, lambda code: sequence_calls(_rewritten(code, REWRITES)), lambda literal: literal)


def census(df: DataFrame, kind: str, text: str, flags: dict[str, str] | None = None) -> DataFrame:
    """kind, n_texts, n_flagged and one count per construct."""
    found = df.select(kind, warnings(F.col(text), flags).alias("w"))
    each = [F.count_if(F.array_contains("w", name)).alias(name) for name in flags or CONSTRUCTS]
    return found.groupBy(kind).agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.size("w") > 0).alias("n_flagged"), *each)
