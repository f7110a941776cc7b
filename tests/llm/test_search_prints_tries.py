"""Ranked search, fingerprints and the prefix trie against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ferryline.llm import lexical, prefixtrie, shards, simhash, urls, words
from ferryline.llm.shared import tokenizer_path

WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def many_tasks(spark):
    """Small ranges stay tasks of their own."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


# --- 11 ranked search


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            n = sum(c.values())
            m = n and 25 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out += [(item, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ranked_search(spark, odd, make, prose):
    more = make([(100 + i, " ".join([prose(30 + i, i % 7), "Shared_term " * (i % 50), f"rare{i % 3}", "É-é"])) for i in range(60)])
    docs = odd.unionByName(more).unionByName(more.where("doc_id < 105"))
    rows = [(1, "shared TERM rare1 é"), (2, None), (3, "zzz"), (4, "term " * 30 + "rare2"), (5, "one two three"), (5, prose(10, 2)), (None, "x one"), (6, "!!")]
    items = spark.createDataFrame(rows, "item_id int, text string").withColumn("term", F.lit(1))
    got = lexical.search(docs, items)
    assert got.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert found(got) == brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [r for r in rows if r[1]])


def test_ranked_search_of_nothing(spark, make, odd):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search(make([]), items).collect() == []
    assert lexical.search(odd, items.limit(0)).collect() == []
    assert lexical.search(make([(1, None), (2, "!")]), items).collect() == []


def test_ranked_search_in_groups_of_items(spark, make, prose, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP_ITEMS", 2)
    monkeypatch.setattr(lexical, "BROADCAST_DOCS", 3)
    docs = make([(i, prose(40, i % 11)) for i in range(80)])
    rows = [(i, prose(12, i)) for i in range(5)]
    index = lexical.index(docs)
    assert found(lexical.search(docs, spark.createDataFrame(rows, "item_id long, text string"), k=3, signatures=index)) == brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], rows, 3)


def test_bounds_are_above_the_scores_and_near():
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.choice([5, 80, 900]))) for _ in range(300)]
    (t,) = lexical._chunks(pa.array(texts))
    h, owner, count = lexical._terms(t)
    docs = [lexical._Doc(i, b"", int(t.n_words[i]), h[owner == i], count[owner == i]) for i in range(300)]
    terms = np.unique(h)
    items = lexical._Items([0], terms, np.arange(len(terms)), np.ones(len(terms), np.int64), np.array([0, len(terms)]), np.arange(len(terms)) + 1, 300, int(count.sum()))
    batch = lexical._rows(lexical._block(docs, 512))
    ((_, bound),) = lexical._bounds(batch, 0, items)
    exact = np.array([int((items.weights * items.shares(np.where(np.isin(terms, d.terms), d.counts[np.minimum(np.searchsorted(d.terms, terms), len(d.terms) - 1)], 0), d.n)).sum()) for d in docs])
    assert (bound >= exact).all() and bound.sum() < 1.1 * exact.sum()


# --- 12 fingerprints


def brute_print(text):
    w = [x for x in WORD.findall((text or "").translate(LOWER))]
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Component of each distinct fingerprint, over all pairs."""
    at = np.array(sorted(set(prints)), dtype=np.uint64)
    parent = list(range(len(at)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(at):
        for j in np.flatnonzero(np.bitwise_count(at[:i] ^ x) <= 2).tolist():
            parent[top(i)] = top(j)
    return {int(x): top(i) for i, x in enumerate(at)}


def brute_simhash(rows):
    prints = [brute_print(t) for _, t in rows]
    comp = brute_components(prints)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    return sorted(((i, f"{p:016x}", least.get(comp[p])) for (i, _), p in zip(rows, prints, strict=True)), key=str)


def test_words_one_bit_apart_share_a_codeword():
    assert len(simhash.ERROR) == 2048 and (simhash.NEAR >= 0).all(axis=1).sum() == 1771
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 23, 20_000)
    for bit in (0, 7, 22):
        a, b = simhash.codewords(x), simhash.codewords(x ^ (1 << bit))
        assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2)).all()
    near = simhash.codewords(x)
    full = np.where(near < 0, 0, near << 11 | simhash.PARITY[near])
    assert (np.where(near < 0, 0, np.bitwise_count(full ^ x[:, None])) <= 4).all()


def test_fingerprints_two_bits_apart_share_a_key():
    r = np.random.default_rng(2)
    x = r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    for _ in range(8):
        i, j = r.integers(0, 64, 2)
        a, b = simhash.keys(x), simhash.keys(x ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)))
        assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_fingerprints(docs_and_odd):
    got = simhash.near_duplicates(docs_and_odd)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert found(got) == brute_simhash([(r["doc_id"], r["text"]) for r in docs_and_odd.collect()])


@pytest.fixture(scope="module")
def docs_and_odd(spark, sf_dir, odd, make):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return odd.unionByName(docs, allowMissingColumns=True)


def test_chunks_of_texts_have_the_same_fingerprints(prose):
    texts = [prose(3, 1), "A  b\tC", "a b c d", "", None, prose(90_000, 2), "Ünï CODE x"]
    got = [x for t in words.texts(pa.array(texts)) for x in simhash.fingerprints(t).tolist()]
    assert got == [brute_print(t) for t in texts]


@pytest.mark.parametrize("bucket", [2, 32, 10_000])
def test_hot_buckets_of_fingerprints(spark, bucket):
    """Clusters around a few centres, chains among them: the same components however many fingerprints a bucket lists."""
    r, prints = random.Random(6), set()
    for centre in (0, r.getrandbits(64), r.getrandbits(64)):
        for _ in range(120):
            prints.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))))
    for i in range(40):
        prints.add((1 << i) - 1)
    df = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x,) for x in prints], "fp long")
    unsigned = lambda x: x % (1 << 64)
    links = [(unsigned(r["a"]), unsigned(r["b"])) for r in simhash.links(df, bucket).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    parent = {x: x for x in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[top(a)] = top(b)
    want = brute_components(list(prints))
    pairs = {(want[x], top(x)) for x in prints}
    assert len(pairs) == len(set(want.values())) == len({top(x) for x in prints})


def test_fingerprints_of_nothing(make):
    assert simhash.near_duplicates(make([])).collect() == []


# --- 13 prefix trie


def brute_trie(rows, rebuild=True):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).digest(), text or ""))
    talks = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in talks.items()}
    made = {}
    for c, t in talks.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        made[c] = talks.get(base, [])[:h] + t[h:] if rebuild else t
    nodes = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if len(made[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in nodes.items()), key=str)


TALK = "conv_id long, turn int, role string, text string"


def talks(n, seed):
    r, rows = random.Random(seed), []
    for c in r.sample(range(-20, 3 * n), n):
        for k in range(r.choice([0, 1, 3, 9, 14])):
            rows.append((c, None if r.random() < 0.03 else k if r.random() < 0.95 else 0, r.choice(["user", None, "a"]) if k > 3 else "user", "hello" if k == 0 or r.random() < 0.2 else r.choice(["ß", "", None, f"t{k % 3}", f"u{r.randrange(99)}"])))
    rows += [(None, 1, "user", "x"), (7 * 3 * n, 0, "user", "hello"), (7 * 3 * n, 0, "user", "hello")]
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_prefix_trie(spark, many_tasks, rebuild):
    rows = talks(150, 8) + [(500, k, "user", f"long {k % 7}") for k in range(400)]  # one talk is a third of all turns
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, TALK).withColumns({"depth": F.lit("x"), "conv": F.lit(1), "k1": F.lit(2)}).repartition(3)
    got = prefixtrie.prefix_trie(df, rebuild=rebuild)
    assert found(got.drop("n_nodes")) == brute_trie(rows, rebuild)
    assert got.where("depth = 0").first()["n_nodes"] == got.count()


def test_prefix_trie_of_few(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], TALK)).collect() == []
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], TALK)).collect() == []
    rows = [(4, None, None, None), (4, 1, "x", "y" * 100_000)]
    assert found(prefixtrie.prefix_trie(spark.createDataFrame(rows, TALK)).drop("n_nodes")) == brute_trie(rows)


def test_many_talks_that_end_alike(spark):
    rows = [(c, 0, "user", "hi") for c in range(3 * prefixtrie.PIECE)]
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, TALK), rebuild=False).where("depth = 1").first()
    assert got["ends_sha256"] == hashlib.sha256(",".join(str(c) for c in range(len(rows))).encode()).hexdigest()


def test_segments_join_what_follows_in_one_task():
    """A chain and its exits are one segment; a tour over two tasks is cut where it leaves them."""
    batch = lambda conv, depth, parent, child, sibling: pa.RecordBatch.from_pydict({"conv": conv, "depth": depth, "parent": pa.array(parent, pa.int64()), "child": pa.array(child, pa.int64()), "sibling": pa.array(sibling, pa.int64()), "leaf": [int(c is None) for c in child], "saved": [1] * len(conv)})
    whole = prefixtrie._segments(batch([1, 1, 2], [0, 1, 1], [None, 1, 1], [1, None, None], [None, 2, None]))
    assert [x for s in whole.column("begun").to_pylist() for x in s] == [{"conv": 1, "place": 0, "next_conv": None, "next_place": None, "n": 6, "leaves": 2, "saved": 3}]
    part = prefixtrie._segments(batch([1, 1], [0, 1], [None, 1], [1, None], [None, 2]))
    assert [(s["place"], s["next_conv"], s["next_place"], s["n"]) for x in part.column("begun").to_pylist() for s in x] == [(0, 2, 2, 3), (1, None, None, 1)]


# --- ties and clashes of 7 and 8


def test_of_rules_of_one_length_the_first_listed_holds(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/xy"), (2, "http://b.c/xy")], "page_id long, url string")
    rules = [urls.Rule("block", "b.c", "/xy"), urls.Rule("allow", "a.b.c", "/"), urls.Rule("allow", "b.c", "/xy")]
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judged(pages, rules, []).collect()} == {1: ("b.c/xy", "block"), 2: ("b.c/xy", "block")}
    assert {r["page_id"]: r["verdict"] for r in urls.judged(pages, rules[::-1], []).collect()} == {1: "allow", 2: "allow"}


def test_shards_replace_a_column_of_their_name(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("old").alias("shard"))
    shards.write_shards(docs, str(tmp_path / "s"), [1.0, 1.0])
    got = spark.read.parquet(str(tmp_path / "s"))
    assert got.count() == 40 and {r["shard"] for r in got.select("shard").distinct().collect()} == {0, 1}


def test_copies_and_null_ids_are_many_tasks_work(spark, tmp_path, monkeypatch):
    """Slots and token files where one key, and one text of it, hold most rows."""
    from ferryline.llm import tokenfiles, topk

    monkeypatch.setattr(shards, "RUN", 7)
    text = F.when(F.col("id") < 1000, "copy").otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
    docs = spark.range(0, 3000, 1, 4).select(F.when(F.col("id") >= 2500, F.col("id")).alias("doc_id"), text.alias("text"))
    rows = shards.sharded(docs, [1.0] * 8)
    got = rows.collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted(
        ((r["doc_id"] if r["doc_id"] is not None else -1), len(r["text"]) + 1, zlib.crc32(r["text"].encode())) for r in docs.collect()
    )
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    tokenfiles.write_tokens(docs, str(tmp_path / "t"), tokenizer_path("byte_bpe_50k.json"))
    parts = [r["count"] for r in spark.read.parquet(str(tmp_path / "t")).where("doc_id is null").groupBy("part").count().collect()]
    assert sum(parts) == 2500 and (len(parts) == 1 or max(parts) < 1500)
    with pytest.raises(ValueError, match="components"):
        topk.top_k(spark.createDataFrame([(0, [0.0] * (topk.MOST_DIMS + 1))], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)


def test_the_globs_of_the_method_are_hundreds():
    blocked = ["x-poker.org/", "poker.x.org/", "x.poker/", "a-poker-b.org/", "x.org/a/poker/b", "x.org/poker-1", "x.org/adview/1", "x.org/f.rpm"]
    passed = ["pokers.org/", "x.org/pokers/", "spoker.x.org/", "x.org/adviews/", "x.org/rpm", "www.example.com/en/1.html"]
    texts = [u.split("/", 1)[0].encode() + urls.SPLIT + b"/" + u.split("/", 1)[1].encode() for u in blocked + passed]
    globs = urls.Globs([h.encode() + urls.SPLIT + p.encode() for h, p in urls.BLOCK_GLOBS])
    hit = globs.matches(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])).any(axis=1)
    assert hit.tolist() == [True] * len(blocked) + [False] * len(passed)
    assert len(set(urls.BLOCK_GLOBS)) == len(urls.BLOCK_GLOBS) > 200
