"""Quality rules by distribution divergence, in DataFrame functions only.

A text is compared with references of the corpus's languages: histograms of character classes and of common words,
summed over all rows of a language with enough words. The measure is the Jensen-Shannon distance (square root of the
divergence to base 2, 0 to 1); the nearest language counts. Short texts are guarded: each histogram is judged only from
a least number of words on. Base rules come first: too few words, or too many words in repeated 8-word windows.

Everything is computed within the row, so no text is shuffled. The figures of each row are written once to the shared
folder; the references are one row of sums per language.

Defined results: a null text has no words and fails the base rules; a null language is no reference; with no reference
the distances are null and the method keeps what the base rules keep. Each language has a word limit of its own
(word_limits()), which a text without common words is beyond.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.shared import cut, fresh_names

SPACE = r"[\x20\x09-\x0D]+"
REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Least words for the class and the word histogram, and the largest distances kept.
CLASS_MIN_WORDS, WORD_MIN_WORDS = 20, 50
CLASS_LIMIT, WORD_LIMIT = 0.25, 0.4
#: A language's word limit is, if less than WORD_LIMIT, this part of the distance between its reference and a text without common words.
WORDLESS_PART = 0.85
#: A language is used so only if at most this part of its texts of WORD_MIN_WORDS words should have no common word.
WORDLESS_CHANCE = 0.01
#: At most so many languages become references.
MAX_LANGUAGES = 256
CLASSES = ["lower", "upper", "digit", "space", "symbol", "other"]
# Frequent function words of the languages expected.
COMMON = [
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "with", "as", "was",
    "le", "la", "les", "de", "et", "en", "un", "une", "des", "que", "qui", "dans", "pour", "du",
    "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "im", "sich", "nicht", "ein", "eine",
    "el", "los", "las", "y", "del", "se", "por", "con", "una", "no", "su", "al",
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, k: int = REPEAT_WINDOW) -> Column:
    """Words covered by k-word windows found twice or more in the same text."""

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
        at = let(pairs, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: same(s, x, i)), lambda x: x["i"])))
        start = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(k), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    hashes = lambda hw: F.transform(F.sequence(F.lit(1), F.size(hw) - (k - 1)), lambda i: F.xxhash64(F.slice(hw, i, k)))
    found = let(let(F.transform(words, lambda w: F.xxhash64(w)), hashes), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) >= k, found).otherwise(F.lit(0)).cast("long")


def _length_of(text: Column, other: str) -> Column:
    return F.char_length(F.regexp_replace(text, other, "")).cast("long")


def _marks(rest: Column) -> Column:
    """Figures of the characters that are neither letters nor white space: few, so the second passes are short."""
    return F.struct(F.char_length(rest).cast("long").alias("n"), _length_of(rest, r"[^#*$%&|<>]+").alias("n_symbols"), _length_of(rest, r"[^0-9]+").alias("digits"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang, base figures, and the counts `classes` and `common` of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), text.alias("t"), *(carry or []))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    common = lambda f: F.transform(F.array(*map(F.lit, COMMON)), lambda w: (F.size(f) - F.size(F.array_remove(f, w))).cast("long"))
    figures = let(
        words_of(F.col("t")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            let(F.filter(F.transform(w, F.lower), lambda x: x.isin(*COMMON)), common).alias("common"),
        ),
    )
    counted = rows.select(
        *(carry or []), "doc_id", "lang", F.char_length("t").cast("long").alias("chars"), figures.alias("w"),
        let(F.regexp_replace("t", r"[\p{L}\x20\x09-\x0D]+", ""), _marks).alias("m"), _length_of(F.col("t"), r"[^\p{Lu}]+").alias("upper"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    spaces = F.col("chars") - F.col("w.word_chars")
    lower = F.col("w.word_chars") - F.col("m.n") - F.col("upper")
    rest = F.col("m.n") - F.col("m.digits") - F.col("m.n_symbols")
    return counted.select(
        *(carry or []), "doc_id", "lang", "w.n_words", "w.word_chars", "m.n_symbols", "n_dup_lines", "w.n_repeat_words",
        F.array(lower, F.col("upper"), F.col("m.digits"), spaces, F.col("m.n_symbols"), rest).alias("classes"), "w.common",
    )


def references(rows: DataFrame, least_words: int = WORD_MIN_WORDS) -> list[tuple[str, list[int], list[int]]]:
    """Summed histograms of each language: at most MAX_LANGUAGES rows of fixed width come to the driver."""
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in (("classes", len(CLASSES)), ("common", len(COMMON))) for i in range(n)]
    found = rows.where(F.col("lang").isNotNull() & (F.col("n_words") >= least_words)).groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = []
    for r in sorted(found, key=lambda r: r["lang"]):
        common = [r[f"common{i}"] for i in range(len(COMMON))]
        out.append((r["lang"], [r[f"classes{i}"] for i in range(len(CLASSES))], [*common, r["n"] - sum(common)]))
    return out


def js_distance(counts: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance of an array of counts to fixed counts."""
    total = sum(reference)
    q = F.array(*[F.lit(x / total) for x in reference])
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    each = lambda p: F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    share = let(whole(counts), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))
    return F.sqrt(F.greatest(F.aggregate(each(share), F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def word_limits(refs: list[tuple[str, list[int], list[int]]]) -> list[float]:
    """The largest word distance kept for each reference, below what a text without any common word is at.

    Where common words are rare, texts without one are usual and the limit stays WORD_LIMIT."""
    out = []
    for _, _, w in refs:
        q = [x / sum(w) for x in w] if sum(w) else [1.0]
        js = (sum(q[:-1]) + math.log2(2 / (1 + q[-1])) + (q[-1] * math.log2(2 * q[-1] / (1 + q[-1])) if q[-1] else 0.0)) / 2
        out.append(min(WORD_LIMIT, WORDLESS_PART * math.sqrt(max(js, 0.0))) if q[-1] ** WORD_MIN_WORDS <= WORDLESS_CHANCE else WORD_LIMIT)
    return out


def judge(rows: DataFrame, refs: list[tuple[str, list[int], list[int]]]) -> DataFrame:
    """features() with class_distance, word_distance (both to the nearest language), base_failed and kept: near enough to a
    language's classes, and within some language's word limit."""
    least = lambda xs: F.least(*xs, xs[0]) if xs else F.lit(None).cast("double")
    words = F.concat("common", F.array(F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + x)))
    spoken = [(w, limit) for (_, _, w), limit in zip(refs, word_limits(refs), strict=True) if sum(w)]
    (each,) = fresh_names(rows, "each")
    out = rows.withColumn(each, F.when(F.col("n_words") >= WORD_MIN_WORDS, F.array(*[js_distance(words, w) for w, _ in spoken])) if spoken else F.lit(None).cast("array<double>"))
    wordless = F.array_min(F.transform(each, lambda d, i: d - F.get(F.array(*[F.lit(limit) for _, limit in spoken] or [F.lit(0.0)]), i))) > 0
    out = out.withColumns({
        "class_distance": F.when(F.col("n_words") >= CLASS_MIN_WORDS, least([js_distance(F.col("classes"), c) for _, c, _ in refs if sum(c)])),
        "word_distance": F.array_min(each),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })
    far = F.coalesce(F.col("class_distance") > CLASS_LIMIT, F.lit(False)) | F.coalesce(wordless, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop(each)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, figures, distances, base_failed, kept."""
    rows = cut(features(docs, id_col, text_col, lang_col), "quality")
    return judge(rows, references(rows)).drop("classes", "common", "lang")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that quality() keeps. No row is shuffled: the rows are written to the shared folder beside their
    figures, and the filter reads them from there, where no optimizer can copy the figures' expressions into it."""
    (row,) = fresh_names(docs, "row")
    rows = cut(features(docs.withColumn(row, F.struct(*docs.columns)), id_col, text_col, lang_col, carry=[row]), "quality-rows")
    return judge(rows, references(rows)).where("kept").select(f"{row}.*")
