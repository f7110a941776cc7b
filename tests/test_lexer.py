"""Constructs of code against a plain scan of one text, character by character."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from ferryline.operators import lexer
from ferryline.operators.textjobs import CONSTRUCTS, warnings


def bare(text):
    """The text without literals, quoted names and comments."""
    out, i = "", 0
    close = {"[": "]", "{": "}", "(": ")", "<": ">"}
    while i < len(text):
        if text[i] == "'" and re.search(r"(^|[^\w])[nN]?[qQ]$", text[:i]) and i + 1 < len(text) and text[i + 1] not in " \t\n'":
            end = text.find(close.get(text[i + 1], text[i + 1]) + "'", i + 2)
            i, out = (len(text) if end < 0 else end + 2), out + " "
        elif text[i] in "'\"":
            end = text.find(text[i], i + 1)
            i, out = (len(text) if end < 0 else end + 1), out + " "
        elif text.startswith("--", i):
            end = text.find("\n", i)
            i, out = (len(text) if end < 0 else end), out + " "
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i, out = (len(text) if end < 0 else end + 2), out + " "
        else:
            i, out = i + 1, out + text[i]
    return out


def plain(text):
    tokens = re.findall(r"\w+|[^\w\s]", bare(text or ""), re.ASCII if (text or "").isascii() else 0)

    def fits(phrase, at):
        for x in phrase:
            if x == "…":
                while at < len(tokens) and tokens[at] not in ("(", ")", ","):
                    at += 1
            elif at < len(tokens) and (re.match(r"\w", tokens[at]) if x == "@" else tokens[at].upper() == x):
                at += 1
            else:
                return False
        return True

    return [n for n, ps in CONSTRUCTS.items() if any(fits(p.split(), i) for p in ps for i in range(len(tokens)))]


def random_texts(n, seed):
    rng = random.Random(seed)
    words = sorted({w for ps in CONSTRUCTS.values() for p in ps for w in p.split()} - {"…"}) + ["(", ")", ",", "'", "''", '"', "--", "\n", "/*", "*/", "q'[", "]'", "nq'!", "!'", "é", "x1", "INSTR", "openx"]
    phrases = [p for ps in CONSTRUCTS.values() for p in ps]
    pick = lambda: rng.choice(phrases).replace("…", "a").replace("@", "b") if rng.random() < 0.3 else rng.choice(words)
    return ["".join(rng.choice([str.lower, str.upper])(pick()) + rng.choice([" ", " ", " ", "", "\n", "\t"]) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_random_texts_in_blocks_and_groups(monkeypatch):
    texts = [*random_texts(3000, 7), "", None, "commit" * 1000, "commit;"]
    want = [plain(t) for t in texts]
    assert sum(map(bool, want)) > 500
    found = lexer.Lexer(CONSTRUCTS)
    assert found.warnings(pa.array(texts)).to_pylist() == want
    assert found.warnings(pa.array(texts).slice(5, 100)).to_pylist() == want[5:105]
    monkeypatch.setattr(lexer, "GROUP_BYTES", 200)
    monkeypatch.setattr(lexer, "BLOCK_BYTES", 7)
    assert found.warnings(pa.array(texts)).to_pylist() == want
    assert found.warnings(pa.array([], pa.string())).to_pylist() == []


def test_literals_and_comments_hold_no_constructs(spark):
    cases = ["x := 'commit;'; -- commit;\n", "/* merge into t */ select \"ROWID\" from t", "q'[it's; commit;]'", "nq'!rownum!'", "'open c for", "/* forall", "'a''rownum'''"]
    df = spark.createDataFrame([(t,) for t in [*cases, "'x' commit /* */ ;", None]], "t string")
    got = {r["t"]: r["w"] for r in df.select("t", warnings(F.col("t")).alias("w")).collect()}
    assert got == {t: [] for t in [*cases, None]} | {"'x' commit /* */ ;": ["COMMIT"]}
