import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in [
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()),
    # names that the operators use inside
    ("text_md5", T.StringType()), ("_id", T.LongType()), ("n", T.LongType()), ("label", T.StringType()), ("table", T.StringType()), ("mix_copy", T.StringType()), ("piece_ids", T.StringType()), ("class_id", T.LongType()),
]])


def row(i, text, lang="en", source="s", x="x"):
    return (i, text, lang, source, None if text is None else len(text), x, 7, 8, x, x, x, x, 9)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame([row(*r) for r in rows], DOCS)


@pytest.fixture(scope="session")
def prose():
    """n words of invented prose, the same for the same seed."""
    import random

    def words(n, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))

    return words


@pytest.fixture(scope="session")
def odd(make, prose):
    """Nulls in any column, empty, short and long texts, ties, repeated rows."""
    long = prose(20_000, 1)
    return make([
        (0, prose(120, 2)), (1, prose(120, 2)), (2, None), (3, ""), (4, "  \n\t"), (5, "one"), (5, "one"), (6, "one two three four"), (7, long), (8, long + " tail"), (9, "é ß あ\n🙂 ▁ <|endoftext|>"),
        (None, prose(120, 2)), (10, prose(60, 3), None, None), (11, "x" * 50_000), (12, "!!! ### 123", "de", "t"), (5, prose(55, 4)),
    ])
