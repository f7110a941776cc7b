"""Registered queries of the corpus operators, with DuckDB SQL for the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.llm import langid, lexical, mixing, neardup, passages, pieces, prefixtrie, shards, simhash, tokenfiles, topk, urls
from ferryline.llm import quality as rules
from ferryline.llm.shared import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_shingles")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), alpha=0.5, epochs=1.0)
    return mixed.select("doc_id", "source", F.round("mix_rate", 6).alias("mix_rate"), "mix_copy", "mix_key")


OP2_SQL = """
with s as (select source, sum(strlen(coalesce(text, ''))) as b from documents group by source),
w as (select source, b, case when b > 0 then pow(cast(b as double), 0.5) else 0.0 end as weight from s),
t as (select cast(sum(cast(weight as decimal(38, 12))) as double) as w, cast(sum(b) as double) as b from w),
r as (select source, weight / t.w * 1.0 * t.b / w.b as rate from w, t where w.b > 0),
k as (select source, rate, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 40) as bigint) + 1)) as k from r where rate > 0),
lp as (select source, rate, k, sum(case when k = 0 then -rate else ln(rate / k) end) over (partition by source order by k) as lp from k),
c as (select source, k, sum(exp(lp)) over (partition by source order by k) as p from lp),
u as (select doc_id, source, (cast(cast('0x' || substr(md5(concat_ws(':', doc_id, '0', 'copies')), 1, 13) as bigint) as double) + 0.5) / 4503599627370496.0 as u from documents),
n as (select doc_id, u.source, count(*) as n from u join c on u.source is not distinct from c.source and c.p <= u.u group by doc_id, u.source),
x as (select doc_id, source, unnest(range(0, n)) as mix_copy from n)
select doc_id, x.source, round(rate, 6) as mix_rate, cast(mix_copy as integer) as mix_copy, md5(concat_ws(':', doc_id, mix_copy, '0')) as mix_key
from x join r on x.source is not distinct from r.source
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load(tokenizer_path("piece_bpe_32k.model"))
    coded = pieces.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    read = pieces.decoded(coded, model)
    return read.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_xxhash64"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2("kept_text", 256), "words_sha256").alias("kept_sha256"))


OP4_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as h
        from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w)),
low as (select h, min(doc_id) as low from win group by h),
hit as (select distinct doc_id, unnest(range(i, i + 50)) as p from win join low using (h) where low < doc_id),
tok as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as k, count(*) as n from tok anti join hit using (doc_id, p) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(k, '')) as kept_sha256
from w left join kept using (doc_id)
"""

def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 4).alias("class_distance"), F.round("word_distance", 4).alias("word_distance"),
    )


def _js(counts: str, ref: str) -> str:
    """SQL for the Jensen-Shannon distance of two lists of counts."""
    p, q = f"(x[1] / greatest(list_sum({counts}), 1))", f"(x[2] / list_sum({ref}))"
    term = lambda a: f"(case when {a} > 0 then {a} * log2({a} / (({p} + {q}) / 2)) else 0 end)"
    return f"sqrt(greatest(list_sum([{term(p)} + {term(q)} for x in list_zip({counts}, {ref})]) / 2, 0))"


_COMMON = ", ".join(f"'{w}'" for w in rules.COMMON)
OP5_SQL = rf"""
with w as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as h from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w)),
rep as (select doc_id, unnest(range(i, i + 8)) as p from (select doc_id, i, count(*) over (partition by doc_id, h) as c from win) where c > 1),
nrep as (select doc_id, count(distinct p) as n from rep group by doc_id),
lines as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(t, chr(10))) as line from w)
          where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
f as (select w.doc_id, lang, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, length(regexp_replace(t, '[^0-9]', '', 'g')) as digits,
        length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) as letters, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as upper_n, length(t) as chars,
        coalesce(lines.n, 0) as n_dup_lines, coalesce(nrep.n, 0) as n_repeat_words,
        [len(list_filter(ws, lambda x: lower(x) = c)) for c in [{_COMMON}]] as common
      from w left join nrep using (doc_id) left join lines using (doc_id)),
g as (select *, [letters - upper_n, upper_n, digits, chars - word_chars, n_symbols, word_chars - letters - digits - n_symbols] as classes,
        list_append(common, n_words - list_sum(common)) as commons from f),
r as (select lang, [{", ".join(f"sum(classes[{i + 1}])" for i in range(len(rules.CLASSES)))}] as rc,
        [{", ".join(f"sum(commons[{i + 1}])" for i in range(len(rules.COMMON) + 1))}] as rw
      from g where lang is not null and n_words >= {rules.WORD_MIN_WORDS} group by lang),
u as (select *, rw[-1] / list_sum(rw) as q from r),
l as (select lang, rc, rw, case when pow(q, {rules.WORD_MIN_WORDS}) > {rules.WORDLESS_CHANCE} then {rules.WORD_LIMIT}
        else least({rules.WORD_LIMIT}, {rules.WORDLESS_PART} * sqrt(greatest(1 - q + log2(2 / (1 + q)) + case when q > 0 then q * log2(2 * q / (1 + q)) else 0 end, 0) / 2)) end as word_limit from u),
d as (select doc_id, min({_js("classes", "rc")}) as cd, min({_js("commons", "rw")}) as wd, min({_js("commons", "rw")} - word_limit) as over from g left join l on true group by doc_id),
j as (select g.*, case when n_words >= {rules.CLASS_MIN_WORDS} then cd end as cd, case when n_words >= {rules.WORD_MIN_WORDS} then wd end as wd, n_words >= {rules.WORD_MIN_WORDS} and over > 0 as wordless,
        n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words as base_failed from g join d using (doc_id))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       not base_failed and not coalesce(cd > {rules.CLASS_LIMIT} or wordless, false) as kept,
       round(cd, 4) as class_distance, round(wd, 4) as word_distance
from j
"""

def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP6_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from p)
select query_id, rank, vec_id, score from r where rank <= 20
"""


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(_table(spark, sf_dir, "documents"), weights=[1.0] * 8)


OP7_SQL = """
with tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(cast(i as ubigint), cast(range(8) as ubigint[])),
         lambda c, k: case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as ubigint)) else c >> 1 end)) as t),
b as (select doc_id, coalesce(text, '') as s, hex(encode(coalesce(text, ''))) as h from documents),
crc as (select doc_id, strlen(s) + 1 as size, xor(list_reduce(list_prepend(cast(4294967295 as ubigint),
         list_transform(range(1, len(h), 2), lambda i: cast(cast('0x' || h[i:i + 1] as bigint) as ubigint))),
         lambda c, x: xor(t[cast(xor(c, x) & 255 as bigint) + 1], c >> 8)), cast(4294967295 as ubigint)) as crc from b, tab),
d as (select doc_id, j, -ln((cast(cast('0x' || substr(md5(doc_id || ':' || j), 1, 13) as bigint) as double) + 0.5) / 4503599627370496.0) as d
      from documents, (select unnest(range(9)) as j)),
p as (select doc_id, cast(arg_min(j, d) filter (where j < 8) as integer) as shard, cast(arg_min(j, d) as integer) as grown_shard from d group by doc_id)
select doc_id, cast(size as bigint) as size, cast(crc as bigint) as text_crc32, 'key' as law, shard,
       row_number() over (partition by shard order by substr(md5(doc_id || ':slot:' || crc), 1, 3), doc_id, crc, size) - 1 as slot, grown_shard
from crc join p using (doc_id)
"""

URL_RULES = [
    urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"),
]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"), URL_RULES)


def _regex(glob: str) -> str:
    return "".join({"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(c) or (c if c.isalnum() else "\\" + c) for c in glob)


def _decoded(sql: str) -> str:
    """SQL for the text with escapes of unreserved characters decoded and other escapes in capitals."""
    char = "chr(coalesce(try_cast('0x' || x[1:2] as integer), 32))"
    return rf"""array_to_string(list_transform(string_split({sql}, '%'), lambda x, i: case when i = 1 then x when not regexp_matches(x, '^[0-9A-Fa-f]{{2}}') then '%' || x
      when regexp_matches({char}, '^[A-Za-z0-9._~-]$') then {char} || x[3:] else '%' || upper(x[1:2]) || x[3:] end), '')"""


_URL_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
_URL_BLOCK = " or ".join(f"(regexp_full_match(chost, '{_regex(h)}') and regexp_full_match(cquery, '{_regex(p)}'))" for h, p in urls.BLOCK_GLOBS)
OP8_SQL = rf"""
with r(verdict, h, p) as (values {_URL_RULES}),
u as (select page_id, case when contains(url, '://') then url[position('://' in url) + 3:] else '' end as rest from pages),
s as (select page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
        regexp_extract(rest, '^[^/?#]*[^?#]*(\?[^#]*)', 1) as query from u),
c as (select *, regexp_replace(lower({_decoded(r"regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')")}), '[.]+$', '') as chost,
        array_to_string(list_reduce(list_transform(string_split(regexp_replace({_decoded("path")}, '/([.]{{1,2}})$', '/\1/'), '/'), lambda x: [x]),
          lambda acc, x: case x[1] when '.' then acc when '..' then acc[:greatest(len(acc) - 1, 1)] else acc || x end), '/') || {_decoded("query")} as cquery from s),
f as (select page_id, arg_max(h || p, len(h || p)) as rule, arg_max(verdict, len(h || p)) as verdict
      from s join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(verdict, case when chost = '' or {_URL_BLOCK} then 'block' else 'allow' end) as verdict
from c left join f using (page_id)
"""


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, ~held_out(F.col("doc_id")))
    return langid.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.written(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_bloom_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


OP11_SQL = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from t group by all),
d as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
g as (select count(*) as n_docs, sum(n)::bigint as n_terms from d),
df as (select term, count(*) as df from tf group by term),
q as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
s as (select item_id, doc_id, sum(times * cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint as score
      from q join df using (term) join tf using (term) join d using (doc_id), g group by item_id, doc_id),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""


def op12_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_euler_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("n_nodes")


#: CRC-32 of a decimal number, by the table of remainders.
_CRC = """xor(list_reduce(list_prepend(cast(4294967295 as ubigint), list_transform(range(1, len(x) + 1), lambda i: cast(ord(x[i]) as ubigint))),
  lambda c, b: xor(t[cast(xor(c, b) & 255 as bigint) + 1], c >> 8)), cast(4294967295 as ubigint))"""
OP13_SQL = f"""
with recursive tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(cast(i as ubigint), cast(range(8) as ubigint[])),
         lambda c, k: case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as ubigint)) else c >> 1 end)) as t),
t0 as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) - 1 as p from conversations where conv_id is not null),
cs as (select c, cast({_CRC} % 9 as bigint) as h, c - c % 5 as base from (select distinct c, c::varchar as x from t0), tab),
nb as (select c as base, count(*) as nb from t0 group by c),
sh as (select cs.c, h, cs.base, h - least(h, coalesce(nb, 0)) as short from cs left join nb using (base)),
tr as (select sh.c, p as i, role, text from sh join t0 on t0.c = sh.base where p < h
       union all select sh.c, p - short, role, text from sh join t0 on t0.c = sh.c where p >= h),
st as (select c, i + 1 as d, strlen(text) as bytes, md5(string_agg(md5(md5(role) || md5(text)), '' order by i) over (partition by c order by i rows unbounded preceding)) as k from tr),
step as (select c, d, k, bytes from st union all select c, 0, '', 0 from cs),
pre as (select c, d, k, bytes, lag(k) over (partition by c order by d) as pk, d = max(d) over (partition by c) as last from step),
node as (select d, k, min(c) as conv, count(*) as n, min(bytes) as bytes, min(pk) as pk, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (last), '')) as ends from pre group by d, k),
tree as (select x.*, p.conv as parent from node x left join node p on p.d = x.d - 1 and p.k = x.pk),
kids as (select parent as conv, d - 1 as d, count(*) as kids from tree where parent is not null group by all),
own as (select tree.*, coalesce(kids, 0) as kids, (n - 1) * bytes as saved from tree left join kids on kids.conv = tree.conv and kids.d = tree.d),
up as (select a.d, a.k, sum(o.saved)::bigint as saved, count(*) filter (kids = 0) as leaves from own o join pre a on a.c = o.conv and a.d <= o.d group by a.d, a.k)
select conv as conv_id, cast(own.d as bigint) as depth, parent as parent_conv_id, n as n_convs, kids as n_children, leaves as n_leaves, up.saved as saved_tokens, ends as ends_sha256
from own join up on up.d = own.d and up.k = own.k
"""


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_rendezvous_shards": op7_rendezvous_shards,
    "op8_url_filters": op8_url_filters,
    "op9_language_id": op9_language_id,
    "op10_token_files": op10_token_files,
    "op11_bloom_ranked_search": op11_bloom_ranked_search,
    "op12_golay_simhash": op12_golay_simhash,
    "op13_euler_prefix_trie": op13_euler_prefix_trie,
}
ORACLES = {
    "op2_mix_sources": OP2_SQL,
    "op6_exact_top_k": OP6_SQL,
    "op7_rendezvous_shards": OP7_SQL,
    "op8_url_filters": OP8_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_quality_rules": OP5_SQL,
    "op11_bloom_ranked_search": OP11_SQL,
    "op13_euler_prefix_trie": OP13_SQL,
}
