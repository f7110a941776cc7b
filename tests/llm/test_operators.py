"""Operators against brute force, on the driver's small tables and on odd ones."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferryline.llm import langid, mixing, neardup, passages, pieces, quality, shards, tokenfiles, topk, urls, words
from ferryline.llm.shared import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def split(text):
    return WORD.findall(text or "")


# --- words


def test_words_and_hashes():
    texts = ["a bb  c\n", None, "", "  ", "x", "é\x0bß q", "\tz z", "a bb c"]
    (t,) = words.texts(pa.array(texts))
    assert [t.joined(i).decode() for i in range(len(texts))] == [" ".join(split(x)) for x in texts]
    h, n = t.word_hashes(), t.n_words.tolist()
    assert n == [len(split(x)) for x in texts]
    assert len(set(h.tolist())) == len({w for x in texts for w in split(x)})
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for k in (1, 2, 3, 7, 31):
        assert words.sliding_min(x, k).tolist() == [x[i : i + k].min() for i in range(51 - k)]


# --- 1 near-duplicates


def shingles(text):
    w = split(text)
    return Counter(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    """class by id, over all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows if i is not None and split(t)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = {}
    for i, c in sets.items():
        for s in c:
            held.setdefault(s, []).append(i)
    seen = {(a, b) for ids in held.values() for k, b in enumerate(sorted(ids)) for a in sorted(ids)[:k]}
    for a, b in seen:
        both = sum((sets[a] & sets[b]).values())
        if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def classes(df):
    return {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}


def test_near_duplicates_of_the_corpus(docs):
    want = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = classes(docs)
    assert {i: got[i] for i in want} == want and len(got) == docs.count()


def test_hot_group_of_near_copies(make, prose):
    """One group of texts edited more and less, of which many link only through others; all found, none made up."""
    r, base, rows = random.Random(5), prose(150, 9).split(), []
    for i in range(160):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 8])):
            k = r.randrange(len(w))
            w[k : k + r.choice([0, 1])] = [f"new{r.randrange(10_000)}"]
        w = w[: r.choice([150, 150, 150, 130, 118])]
        if rows and r.random() < 0.3:  # a copy of an edited copy
            w = rows[r.randrange(len(rows))][1].split()
            w[r.randrange(len(w))] = f"later{i}"
        rows.append((i, " ".join(w)))
    want = brute_classes(rows)
    assert 2 < len(set(want.values())) < 150
    assert classes(make(rows)) == want


def test_shared_counts_by_matrix_and_by_list():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60 if k % 2 else 5000, 50)) for k in range(40)]
    flat = lambda xs: (np.arange(len(xs)), np.concatenate(xs), np.repeat(np.arange(len(xs)), [len(x) for x in xs]))
    got = neardup.overlaps(*flat(sets[:22]), *flat(sets[18:]))
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[18:]] for a in sets[:22]]


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(2)
    a, b = Counter(r.integers(0, 60, 300).tolist()), Counter(r.integers(20, 80, 300).tolist())
    want = sum((a & b).values()) / sum((a | b).values())
    h = np.array([*a, *b], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    who, weight = np.repeat([0, 1], [len(a), len(b)]), np.array([*a.values(), *b.values()])
    sig = neardup.signatures(h, who, weight, 2, m=4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4096)


def test_near_duplicates_at_sf001(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute_classes([(r["doc_id"], r["text"]) for r in df.collect()])
    got = classes(df)
    assert {i: got[i] for i in want} == want


def test_near_duplicates_where_ids_repeat(make, prose):
    """Texts under one id tie their classes; each links by itself, whatever its hash."""
    for seed in range(3):
        a, b, c, d = (prose(90, 100 + 10 * seed + i) for i in range(4))
        rows = [(5, a), (5, b), (9, b), (12, f"{b} more"), (13, f"{a} more"), (20, c), (21, d), (3, f"{d} more"), (30, c), (30, d), (None, a), (None, None), (40, None)]
        got = [(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(make(rows)).collect()]
        assert sorted(got, key=str) == sorted([*((i, 5) for i in (5, 5, 9, 12, 13)), *((i, 3) for i in (20, 21, 3, 30, 30)), (None, None), (None, None), (40, 40)], key=str)
        assert sorted(r["doc_id"] for r in neardup.keep_first(make(rows)).where("doc_id is not null").collect()) == [3, 5, 5, 40]


def test_near_duplicates_of_odd_tables(odd, make):
    got = neardup.near_duplicates(odd)
    assert got.count() == odd.count()
    by = {(r["doc_id"], r["n_shingles"]): r["class_id"] for r in got.collect()}
    assert by[(1, 116)] == 0 and by[(8, 19_997)] == 7 and by[(2, 0)] == 2 and by[(3, 0)] == 3 and by[(None, 116)] is None
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns and {1, 8}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert neardup.near_duplicates(make([])).count() == 0 and neardup.keep_first(make([])).count() == 0


# --- 4 passages


def brute_passages(rows, k=50):
    first, out = {}, []
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        w = split(t)
        for s in range(len(w) - k + 1):
            first.setdefault(tuple(w[s : s + k]), i)
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if i is not None and first[tuple(w[s : s + k])] < i:
                gone[s : s + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def got_passages(df):
    rows = passages.repeated_passages(df).withColumn("sha", F.coalesce(F.sha2("kept_text", 256), "words_sha256")).collect()
    for r in rows:
        assert sum(s["to"] - s["from"] for s in r["spans"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["sha"]) for r in rows), key=str)


def with_sha(rows):
    return sorted(((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in rows), key=str)


def test_passages_of_the_corpus(docs):
    assert got_passages(docs) == with_sha(brute_passages([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_passages_of_odd_tables(odd, make, prose):
    shared = prose(70, 20)
    rows = [(0, f"{prose(30, 21)} {shared} {prose(5, 22)}"), (1, f"{shared} {prose(80, 23)} {shared}"), (2, shared), (3, prose(49, 24)), (4, prose(49, 24)), (5, f"{shared[:-1]}x")]
    assert got_passages(make(rows)) == with_sha(brute_passages(rows))
    assert got_passages(odd) == with_sha(brute_passages([(r["doc_id"], r["text"]) for r in odd.collect()]))
    left = passages.remove_passages(odd)
    assert left.columns == odd.columns and {1, 7}.isdisjoint({1} & {r["doc_id"] for r in left.collect()})
    assert passages.remove_passages(make([])).count() == 0


def test_cut_texts_keep_their_lines(make, docs, prose):
    p = prose(60, 25)
    rows = [(0, p), (1, f"Title line\n\n{prose(9, 26)} {p} end.\n\nNext  line"), (2, f"a {p}\n\tb"), (3, f"{p}\nlast"), (4, f" x\n{p} "), (5, f"é\n{p}\nß"), (6, f"{p} {p}"), (7, "a  b\n")]
    got = {r["doc_id"]: r["text"] for r in passages.remove_passages(make(rows)).collect()}
    assert got == {0: p, 1: f"Title line\n\n{prose(9, 26)} end.\n\nNext  line", 2: "a\n\tb", 3: "last", 4: " x ", 5: "é\nß", 7: "a  b\n"}
    want = {i: k for i, n, m, k in brute_passages([(r["doc_id"], r["text"]) for r in docs.collect()]) if m < n or not m}
    left = {r["doc_id"]: r["text"] for r in passages.remove_passages(docs).collect()}
    assert {i: " ".join(split(t)) for i, t in left.items()} == want


# --- 5 quality


def test_repeated_words(spark):
    texts = ["a b c d e f g h", "a b c d e f g h a b c d e f g h", "a " * 20, "", "x " * 7, "a b c d e f g h i a b c d e f g h i z"]
    for t in texts:
        w = split(t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        want = len({i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)})
        assert spark.range(1).select(quality.repeated_words(quality.words_of(F.lit(t)))).first()[0] == want


def test_quality_of_odd_tables(odd, make, prose):
    got = quality.quality(odd)
    assert got.count() == odd.count()
    by = {(r["doc_id"], r["n_words"]): r for r in got.collect()}
    assert by[(2, 0)]["base_failed"] and not by[(2, 0)]["kept"] and by[(12, 3)]["n_symbols"] == 3
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.keep_good(make([])).count() == 0
    junk = " ".join(f"{w}###$$$" for w in prose(100, 31).split())
    rows = quality.quality(make([(i, "the of and to " * 3 + prose(80, i)) for i in range(40, 60)] + [(1, junk)]))
    assert {r["doc_id"]: r["kept"] for r in rows.collect()}[1] is False


def test_quality_keeps_clean_documents(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    good = quality.quality(docs).where("not base_failed").join(labels, "doc_id").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.98


def test_quality_drops_texts_without_common_words(spark, docs, make, sf_dir, prose):
    odd = make([(-1, " | ".join(prose(80, 61).split())), (-2, prose(80, 62)), (-3, "the of and to in a is that " * 2 + prose(60, 63))])
    rows = docs.select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang"))
    kept = {r["doc_id"] for r in quality.quality(rows).where("kept").collect()}
    assert {i for i in kept if i < 0} == {-3}
    assert {r["doc_id"] for r in quality.keep_good(rows).select("doc_id").collect()} == kept
    labels = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    base = {r["doc_id"] for r in quality.quality(docs).where("not base_failed").collect()} & labels
    assert len(base & kept) >= 0.99 * len(base)


def test_word_limits_leave_languages_without_common_words_alone(make, prose):
    bare = [(i, " ".join("q" + w for w in prose(80, i).split()), "xx") for i in range(70, 90)]
    full = [(i, "the of and to in a is that " * 2 + prose(60, i)) for i in range(90, 110)]
    assert quality.keep_good(make([*bare, *full])).count() == 40


def brute_quality(rows):
    """ids that keep_good() keeps, in plain Python."""
    figures = {}
    for i, text, lang in rows:
        w, t = split(text), text or ""
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeats = len({k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)})
        upper, letters = sum(unicodedata.category(c) == "Lu" for c in t), sum(unicodedata.category(c)[0] == "L" for c in t)
        digits, marks, inside = sum(c in "0123456789" for c in t), sum(c in "#*$%&|<>" for c in t), sum(map(len, w))
        common = [sum(x.lower() == c for x in w) for c in quality.COMMON]
        figures[i] = (len(w), repeats, [letters - upper, upper, digits, len(t) - inside, marks, inside - letters - digits - marks], [*common, len(w) - sum(common)], lang)
    langs = sorted({f[4] for f in figures.values() if f[4] is not None and f[0] >= quality.WORD_MIN_WORDS})
    refs = [[[sum(x) for x in zip(*(f[k] for f in figures.values() if f[4] == lang and f[0] >= quality.WORD_MIN_WORDS), strict=True)] for k in (2, 3)] for lang in langs]

    def apart(x, y):
        p, q = [a / max(sum(x), 1) for a in x], [b / sum(y) for b in y]
        term = lambda a, m: a * math.log2(a / m) if a else 0.0
        return math.sqrt(max(sum(term(a, (a + b) / 2) + term(b, (a + b) / 2) for a, b in zip(p, q, strict=True)) / 2, 0))

    limits = quality.word_limits([(lang, *r) for lang, r in zip(langs, refs, strict=True)])
    kept = set()
    for i, (n, repeats, classes, common, _) in figures.items():
        base = n < 20 or 100 * repeats > 30 * n
        odd = refs and n >= quality.CLASS_MIN_WORDS and min(apart(classes, r[0]) for r in refs) > quality.CLASS_LIMIT
        bare = refs and n >= quality.WORD_MIN_WORDS and min(apart(common, r[1]) - at for r, at in zip(refs, limits, strict=True)) > 0
        if not (base or odd or bare):
            kept.add(i)
    return kept


# --- 2 mixing


def test_poisson_and_targets(make):
    rows = [(i, "x" * 9, "en", "big" if i % 4 else "small") for i in range(6000)]
    df = make(rows)
    mixed = mixing.mix(df, targets={"big": 1.0, "small": 1.0}, seed=3)
    n = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(n["small"] - 3000) < 5 * 3000**0.5 and abs(n["big"] - 3000) < 5 * 3000**0.5
    per = Counter(r["n"] for r in mixed.where("source = 'small'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect())
    assert abs(per[2] / 1500 - 2 * np.exp(-2)) < 0.05 and max(per) < 12  # rate 2
    keys = [r[0] for r in mixed.select("mix_key").collect()]
    assert keys == sorted(keys) and mixed.select("mix_key").collect() == mixing.mix(df, targets={"big": 1.0, "small": 1.0}, seed=3).select("mix_key").collect()


def test_mixing_of_odd_tables(odd, make, monkeypatch):
    few = mixing.mix(odd)
    assert set(few.columns) == {*odd.columns, "mix_rate", "mix_copy", "mix_key"}
    want = sorted(map(str, few.select("doc_id", "mix_copy").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_VALUES", 0)
    assert sorted(map(str, mixing.mix(odd).select("doc_id", "mix_copy").collect())) == want
    assert mixing.mix(make([])).count() == 0


def test_poisson_tables(spark):
    """Against the distribution's terms by log gamma; a table is as long as the root of its rate."""
    from math import exp, lgamma, log

    rates = [0.01, 1.0, 30.0, 900.0, 1e6]
    rows = mixing.poisson_tables(spark.createDataFrame([(str(r), r) for r in rates], "source string, rate double")).collect()
    assert len(rows) == len(rates)
    for row in rows:
        r, least, table = row["rate"], row["least"], row["table"]
        p, want = [exp(k * log(r) - r - lgamma(k + 1)) for k in range(least, least + len(table))], 0.0
        for x, got in zip(p, table, strict=True):
            want += x
            assert abs(want - got) < 1e-7
        assert len(table) < 25 * r**0.5 + 85 and table[0] < 1e-9 or least == 0


def test_many_copies(make):
    df = make([(1, "x", "en", "rare"), *((i, "y" * 40_000, "en", "big") for i in range(2, 4))])
    n = {r["doc_id"]: r["n"] for r in mixing.mix(df, targets={"rare": 1.0, "big": 1.0}, seed=1).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mix_copy").alias("d")).where("n = d").collect()}
    assert abs(n[1] - 40_000) < 5 * 200


# --- 7 shards


def test_one_more_shard_takes_only(odd, docs):
    for df in (docs, odd):
        rows = shards.sharded(df, [1.0] * 8).collect()
        assert len(rows) == df.count()
        assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
        for s in range(8):
            mine = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert mine == list(range(len(mine)))
    by = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in shards.sharded(docs, [1.0] * 8).collect()}
    for r in docs.limit(50).collect():
        assert by[r["doc_id"]] == (len(r["text"].encode()) + 1, zlib.crc32(r["text"].encode()))


def test_written_shards(spark, docs, tmp_path):
    shards.write_shards(docs, str(tmp_path / "s"), [1.0, 2.0, 1.0])
    read = spark.read.parquet(str(tmp_path / "s"))
    assert read.count() == docs.count() and read.where(F.col("shard") != shards.rendezvous(F.col("doc_id"), [1.0, 2.0, 1.0])).isEmpty()


def test_shard_weights(spark):
    n = Counter(r[0] for r in spark.range(6000).select(shards.rendezvous(F.col("id"), [1.0, 3.0])).collect())
    assert abs(n[1] / 6000 - 0.75) < 0.03
    with pytest.raises(ValueError, match="positive"):
        shards.rendezvous(F.col("id"), [1.0, 0.0])


# --- 8 URLs


def test_globs_by_regular_expressions():
    r = random.Random(4)
    globs = [b"*a*", b"a*b", b"?b*", b"", b"*", b"ab\\*c", b"*" + b"ab" * 40 + b"*", b"a?*?b", b"**b"]
    texts = ["".join(r.choice("abc*") for _ in range(r.randint(0, 12))).encode() for _ in range(400)] + [b"", b"x" + b"ab" * 41, b"ab*c"]
    pattern = lambda g: re.compile(re.sub(rb"\\\\\\\*|\\\*|\\\?", lambda m: {rb"\\\*": rb"\*", rb"\*": rb"[\s\S]*", rb"\?": rb"[\s\S]"}[m.group()], re.escape(g)))
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = urls.Globs(globs).matches(data, offsets)
    for j, g in enumerate(globs):
        assert got[:, j].tolist() == [bool(pattern(g).fullmatch(t)) for t in texts], g


def test_url_cases(spark):
    rules = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/")]
    cases = {
        "http://Example.COM/en/1?x=/": ("example.com", "/en/1", "example.com/en/", "block"), "https://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://x.org/a.com/en/": ("x.org", "/a.com/en/", None, "allow"), "http://x.com": ("x.com", "", None, "allow"),
        "http://casino.org#a://b.com/": ("casino.org", "", None, "block"), "x.com/en/": ("", "", None, "block"), "": ("", "", None, "block"), None: ("", "", None, "block"),
        "http://x.net/" + "a" * 100_000 + "/ads/": ("x.net", "/" + "a" * 100_000 + "/ads/", None, "block"), "http://é.org/a*b?": ("é.org", "/a*b", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(df, rules).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judged(df.limit(0), rules).count() == 0


CANONICAL = {
    "http://x.org/%61ds/b": "block", "http://u:p@ads.x.org/": "block", "http://www.casin%6f.org/": "block", "http://x.org:80/ok": "allow", "http://casino.org.:8080/": "block", "http://x.org/a/../ads/b": "block",
    "http://x.org/ads/../b": "allow", "http://x.org/a/./ads/x": "block", "http://x.org/f.ex%65": "block", "http://x.org/f.exe#t": "block", "http://x.org/f.exe?q": "allow", "http://x.org/%2561ds/": "allow", "http://x.org/a%2Fads/": "allow",
    "http://u@:80/": "block", "http://x.org/../../ads/": "block", "http://x.org/x/ads/..": "allow", "http://x.org/%": "allow", "http://x.org/%zz%4": "allow", "http://x.org/b/%2e%2E/ads/": "block", "http://x.org?%61=/ads/": "block",
}


def test_canonical_urls(spark):
    """Verdicts of the method by cases, by hand and by the query's SQL; tables with clashing columns and repeated rows."""
    import duckdb
    from parity import duck_rows, spark_rows

    from ferryline.llm.queries import OP8_SQL, URL_RULES

    rows = [(i, u, "x", 1) for i, u in enumerate(CANONICAL)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string, id int")
    got = urls.judged(df, URL_RULES)
    assert [r["verdict"] for r in got.orderBy("page_id").collect()] == list(CANONICAL.values())
    assert urls.judged(df.unionByName(df), URL_RULES).count() == 2 * len(CANONICAL)
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url").toPandas())
    assert spark_rows(got) == duck_rows(con, OP8_SQL)


def test_many_globs_in_small_batches(spark, monkeypatch):
    table = spark.createDataFrame([(f"bad{i}.*", None) for i in range(300)], "host string, path string")
    globs = urls.globs_of(table)
    assert len(globs) == 300 and globs[0] == ("bad0.*", "*")
    df = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}{i}.org/") for i in range(64)], "page_id long, url string")
    want = {i: "block" if i % 2 else "allow" for i in range(64)}
    assert {r["page_id"]: r["verdict"] for r in urls.judged(df, [], globs).collect()} == want
    assert len(urls.Globs([]).loop) == 1 and {r["verdict"] for r in urls.judged(df, [], []).collect()} == {"allow"}
    monkeypatch.setattr(urls, "MOST_GLOBS", 10)
    with pytest.raises(ValueError, match="globs"):
        urls.globs_of(table)


# --- 9 languages


def test_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs, ~held)
    got = langid.predict(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_languages_of_odd_tables(odd, make):
    model = langid.train(odd, F.lit(True))
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert got[2]["lang_pred"] == "und" and got[3]["score"] == 0 and got[12]["lang_pred"] == "und" and 0 <= got[0]["score"] <= 1
    none = langid.train(make([]), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}
    one = langid.train(make([(1, "abc abc")]), F.lit(True))
    assert [(r["lang_pred"], r["score"]) for r in langid.predict(make([(1, "zz")]), one).collect()] == [("en", 1.0)]
    assert langid.predict(make([]), model).count() == 0


def brute_ngrams(text):
    """Counts of hashed 2- and 3-grams, byte by byte."""
    fold = [c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").lower().encode()]
    out = Counter()
    for n, salt in ((2, 0x2545F491), (3, 0x9E3779B1)):
        for i in range(len(fold) - n + 1):
            code = 0
            for c in fold[i : i + n]:
                code = (code * 257 + c) % 2**32
            out[(code * salt % 2**32) >> 18] += 1
    return out


def test_languages_by_brute_force(docs):
    """Training, margins and decoding in plain Python: the same labels, and scores up to rounding of the weights."""
    from math import exp, log

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    train, size = [r for r in rows if r[0] % 3], langid.DIMENSIONS
    names = sorted({lang for _, _, lang in train if lang is not None})
    share = []
    for name in names:
        n = Counter()
        for _, text, lang in train:
            if lang == name:
                n.update(brute_ngrams(text))
        total = sum(n.values()) + langid.SMOOTHING * size
        share.append([(n[i] + langid.SMOOTHING) / total for i in range(size)])
    code = langid.codewords(len(names)).tolist()
    mean = lambda b, sign, i: sum(s[i] for s, c in zip(share, code, strict=True) if c[b] == sign) / sum(c[b] == sign for c in code)
    weights = [[log(mean(b, 1, i)) - log(mean(b, -1, i)) for i in range(size)] for b in range(len(code[0]))]
    trust = [min(abs(sum(p * w for p, w in zip(s, ws, strict=True))) for s in share) for ws in weights]
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs, F.col("doc_id") % 3 != 0)).collect()}
    for i, text, _ in rows[::4]:
        if not any(c.isalpha() for c in text or ""):
            assert got[i]["lang_pred"] == "und"
            continue
        n = brute_ngrams(text)
        margins = [sum(k * w[f] for f, k in n.items()) / max(sum(n.values()), 1) for w in weights]
        loss = [sum(t * exp(max(-30, min(30, -m * c))) for t, m, c in zip(trust, margins, cs, strict=True)) / sum(trust) for cs in code]
        sure = [exp(-x) / sum(exp(-y) for y in loss) for x in loss]
        assert got[i]["lang_pred"] == names[sure.index(max(sure))] and abs(got[i]["score"] - max(sure)) < 1e-5


def test_too_many_languages(make, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.train(make([(i, "abc", x) for i, x in enumerate("pqr")]), F.lit(True))


def test_codewords_differ():
    for k in (2, 3, 4, 7, 12, 40):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k and (np.abs(code.sum(axis=0)) < k).all()
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(apart) >= code.shape[1] / 4


# --- 6 top k


def brute_top(vectors, k=20, every=20):
    rows = [(i, [math.floor(max(-(2.0**53), min(2.0**53, 64 * float(x)))) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in rows:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, v, strict=False)), i) for i, v in rows if i != q)[:k]
            out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)]
    return sorted(out)


def got_top(df, k=20):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=k).collect())


def test_top_k(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert got_top(df) == brute_top([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_top_k_of_odd_tables(spark):
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.normal(0, 1 + 5 * (i % 7 == 0), 5)]) for i in range(300)] + [(i, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(300, 500)]
    rows += [(500, None), (520, [float("nan"), 1.0]), (540, [None, 1.0]), (560, [float("inf")]), (580, []), (600, [1.0]), (620, [-3.0, 2.0])]
    schema = "vec_id long, embedding array<float>, pivot int, rank int"
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], schema)
    assert got_top(df) == brute_top([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows])
    few = df.where("vec_id in (0, 20, 21)")
    assert len(got_top(few)) == 4
    assert got_top(df.limit(0)) == []


def test_top_k_of_large_components_and_repeated_ids(spark):
    r = np.random.default_rng(8)
    small = [(i % 150, [float(x) for x in r.normal(0, 1, 4)]) for i in range(200)]
    for large in ([1e5, 2e5], [1e8, 2.5e8, 1e7], [3e9, -5e9, 1e300, -1e300]):
        rows = [*small, *((200 + i, [x, 1.0, -x / 3, 0.5]) for i, x in enumerate(large)), *((220 + 20 * i, [-x / 7, x, 2.0, 3.0]) for i, x in enumerate(large))]
        assert got_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute_top(rows)


def test_top_k_visits_few_rows_of_clusters(spark):
    r = np.random.default_rng(3)
    center = r.normal(0, 4, (20, 16))
    rows = [(i, [float(x) for x in center[i % 20] + r.normal(0, 0.2, 16)]) for i in range(6000)]
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 300 == 0, visited=seen).collect()
    assert sorted(tuple(x) for x in got) == brute_top(rows, every=300)
    assert 0 < seen.value < 0.3 * 20 * 6000


# --- 3 pieces


@pytest.fixture(scope="module")
def model():
    return pieces.load(tokenizer_path("piece_bpe_32k.model"))


def brute_pieces(m, text, table):
    if not text:
        return []
    s = (" " + text).encode()
    best, back = [pieces.NEVER] * (len(s) + 1), [None] * (len(s) + 1)
    best[0] = 0
    for i in range(len(s)):
        if best[i] == pieces.NEVER:
            continue
        k = len(s[i:].decode("utf-8", "ignore")[0].encode())
        if best[i] + m.unknown > best[i + k]:
            best[i + k], back[i + k] = best[i] + m.unknown, (i, [int(m.byte_id[c]) for c in s[i : i + k]])
        for n in range(1, min(64, len(s) - i) + 1):
            v = table.get(s[i : i + n])
            if v is not None and best[i] + int(m.score[v]) > best[i + n]:
                best[i + n], back[i + n] = best[i] + int(m.score[v]), (i, [v])
    out, at = [], len(s)
    while at:
        out[:0], at = back[at][1], back[at][0]
    return out


def test_viterbi_and_round_trip(model):
    bytes_ = set(model.byte_id.tolist())
    table = {model.text[a : a + n].tobytes(): i for i, (a, n) in enumerate(zip(model.text_start, model.text_length, strict=True)) if n and i not in bytes_}
    r = random.Random(6)
    bits = ["a", "bc", "the", " the", "é", " ", "  ", "\n", " \n ", "▁", "ing", "er", "12", "#", "ß", "\t", "😀", "ñ", "の", "x" * 60]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["", None, " ", "a" * 300]
    ids, n = pieces.encode(model, pa.array(texts))
    at = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [brute_pieces(model, t, table) for t in texts]
    assert [x.decode() for x in pieces.decode(model, ids, at)] == [t or "" for t in texts]


def test_texts_without_spaces(model):
    """Long segments by cuts and by blocks are as by bytes, also where run-ups never agree."""
    r = random.Random(9)
    letters = lambda n: "".join(r.choice("etaoinshrdlu") for _ in range(n))
    cjk = "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(700))
    texts = [letters(3000), cjk, cjk[:100] + letters(900) + cjk[100:200], "x" * 2000, "ab" * 900, letters(191), letters(193), letters(5000) + "é" * 500, "9" * 700, "a" + "😀" * 300, "=" * 1500 + letters(600)]
    ids, n = pieces.encode(model, pa.array(texts))
    at = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [pieces._viterbi_long(model, f" {t}".encode()) for t in texts]


def test_unigram_model_is_the_library():
    """A model of few pieces with scores far apart: the library's own best paths."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    for name, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{i:02X}>", 0, 6) for i in range(256))]:
        m.pieces.add(piece=name, score=score, type=kind)
    r, seen = random.Random(10), set()
    while len(seen) < 120:
        seen.add(r.choice(["", "▁"]) + "".join(r.choice("abcde") for _ in range(r.randint(1, 5))))
    for i, x in enumerate(sorted(seen | set("abcde▁"))):
        m.pieces.add(piece=x, score=-(1.0 + i * 0.37 % 7 + r.random()), type=1)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.unk_id = 1, True, 0
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.name = True, False, "identity"
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    own = pieces.of_model(library)
    texts = ["".join(r.choice("abcde ") for _ in range(r.randint(1, 300))) for _ in range(200)]
    ids, n = pieces.encode(own, pa.array(texts))
    at = np.concatenate([[0], np.cumsum(n)])
    got, want = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)], [library.encode(t) for t in texts]
    total = lambda xs: sum(library.get_score(x) for x in xs)
    assert all(abs(total(a) - total(b)) < 1e-4 and library.decode(a) == t for a, b, t in zip(got, want, texts, strict=True))
    assert sum(a == b for a, b in zip(got, want, strict=True)) > 180  # the others are equal sums in another order


def test_double_array_holds_its_keys():
    r = random.Random(8)
    keys = sorted({bytes(r.choice(b"abcd\xff\x00") for _ in range(r.randint(1, 6))) for _ in range(500)})
    base, check, value = pieces.double_array([(k, i) for i, k in enumerate(keys)])
    for k in keys + [b"zz", b"abcdabcd"]:
        s = 0
        for c in k:
            t = int(base[s]) + c
            s = t if s >= 0 and t < len(check) and check[t] == s else -1
            if s < 0:
                break
        assert (int(value[s]) if s >= 0 else -1) == (keys.index(k) if k in keys else -1)


def test_pieces_of_odd_tables(odd, make, model):
    rows = pieces.decoded(pieces.encoded(odd, model), model)
    assert rows.where(~F.col("decoded").eqNullSafe(F.col("text"))).isEmpty() and rows.count() == odd.count()
    assert rows.where("text is null and piece_ids is not null").isEmpty()
    assert pieces.encoded(make([]), model).count() == 0


# --- 10 token files


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    r = random.Random(5)
    bits = ["a", "bc", "é", " ", "  ", "\n", " \n ", "\u00a0", "\u3000", "'s", "'ll", "12", "#", "!!", "ß", "\t", "<|endoftext|>", "😀", "\x1c", "\u0085", "ñ", "の", "\u2003"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", None]
    encoder = tokenfiles.Encoder(path)
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        ids, n = encoder(pa.array(texts))
        at = np.concatenate([[0], np.cumsum(n)])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_token_files(spark, odd, make, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.written(odd, path).collect())
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))  # rows of one id in their order
    want, at = [], 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tokenfiles.written(make([]), path).count() == 0
    tokenfiles.write_tokens(odd, str(tmp_path / "t"), path)
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).metadata.row_group(0)
    ids = next(meta.column(i) for i in range(meta.num_columns) if "ids" in meta.column(i).path_in_schema)
    assert ids.has_column_index and ids.has_offset_index and any("DICTIONARY" in e for e in ids.encodings)
