"""URL filters: a bit-parallel wildcard automaton (multiword Shift-And) over canonical URLs.

Every rule is a glob on the bytes host + 0xFF + path and query; 0xFF stands in no UTF-8 text, so `*` cannot mistake a path
for a host. All globs are packed side by side in 64-bit words: one bit per position, a start bit per glob. A byte c moves
the state to ((D << 1) & mask[c]) | (D & loop), where loop holds the positions before a `*`. All URLs of a batch advance
one byte at a time, longest first, so a step costs a few vector operations however many globs there are; a batch has as
many URLs as STATE_WORDS words of state hold.

Host rules (host, path) fit the host and its subdomains if the path starts with theirs; the longest wins. They see the
URL as it stands. Else the block globs decide, over the canonical URL: user, port and last dots of the host gone, escapes
of unreserved characters decoded and others in capitals, dot segments resolved, no fragment. Any match blocks.

Defined results: a null URL or one without `://` has empty host and path, fits no rule and is blocked, as is an empty
host, also one that only canonical form leaves empty; ties in length go to the rule listed first; bytes that are no ASCII
letters keep their case; equal rows are judged equally, one row for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.shared import bounded_batches

SPLIT = b"\xff"
#: Words of hosts and paths that a crawl for text leaves out, folders of advertising, and types of files that hold no text.
BLOCK_WORDS = "adserver adult bets betting casinos clickbait doorway freebies gambling lottery malware payday phishing poker popunder slots torrents trackers viagra warez".split()
BLOCK_FOLDERS = "adclick adframe adimages admanager adsense adserv adview banners clicktrack doubleclick impressions popads popups sponsored trackback xads".split()
BLOCK_TYPES = "7z apk bat bin cab deb dll dmg iso jar msi pkg rar rpm scr tar tgz xz".split()
#: Host and path globs of the method; `*` is any run of bytes, `?` any one byte, `\\` quotes.
BLOCK_GLOBS = [
    ("*spam-*", "*"), ("*casino*", "*"), ("*porn*", "*"), ("ads.*", "*"), ("*", "*/ads/*"), ("*", "*/cgi-bin/*"), ("*", "*.exe"), ("*", "*.zip"),
    *((form.replace("W", w), "*") for w in BLOCK_WORDS for form in ("W.*", "*.W.*", "W-*", "*.W-*", "*-W.*", "*-W-*", "*.W")),
    *(("*", f"*/{w}{end}*") for w in BLOCK_WORDS for end in "/-"), *(("*", f"*/{w}/*") for w in BLOCK_FOLDERS), *(("*", f"*.{w}") for w in BLOCK_TYPES),
]
#: Words of automaton state of one batch, and the most globs that globs_of() reads.
STATE_WORDS, MOST_GLOBS = 1 << 20, 1 << 16
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _tokens(glob: bytes) -> list[int | None | str]:
    out: list[int | None | str] = []
    i = 0
    while i < len(glob):
        c = glob[i : i + 1]
        if c == b"\\" and i + 1 < len(glob):
            i += 1
            out.append(glob[i])
        elif c == b"*":
            out.append("*")
        else:
            out.append(None if c == b"?" else c[0])
        i += 1
    return out


class Globs:
    """Packed automaton of byte globs that must match a whole text."""

    def __init__(self, globs: Sequence[bytes]):
        parsed = [_tokens(g) for g in globs]
        size = sum(1 + sum(x != "*" for x in g) for g in parsed)
        words = max(1, -(-size // 64))
        self.mask, self.loop, self.start = np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        self.final = np.zeros((len(globs), 2), dtype=np.int64)
        at = 0

        def bit(i: int) -> tuple[int, np.uint64]:
            return i // 64, np.uint64(1 << (i % 64))

        for k, tokens in enumerate(parsed):
            w, b = bit(at)
            self.start[w] |= b
            for x in tokens:
                if x == "*":
                    self.loop[w] |= b
                    continue
                at += 1
                w, b = bit(at)
                self.mask[slice(None) if x is None else x, w] |= b
            self.final[k] = at // 64, at % 64
            at += 1

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text (rows) matches each glob (columns)."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        begin, length = offsets[:-1][order], length[order]
        state = np.repeat(self.start[None, :], len(order), axis=0)
        live = len(order)
        for t in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length[:live], -t, "left"))
            d = state[:live]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.mask[data[begin[:live] + t]]) | (d & self.loop)
        hit = (state[:, self.final[:, 0]] >> self.final[:, 1].astype(np.uint64)) & np.uint64(1)
        out = np.zeros(hit.shape, dtype=bool)
        out[order] = hit.astype(bool)
        return out


def quote(text: str) -> bytes:
    return b"".join(b"\\" + bytes([c]) if c in b"*?\\" else bytes([c]) for c in text.encode())


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and path with query of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)


def globs_of(table: DataFrame, host_col: str = "host", path_col: str = "path") -> list[tuple[str, str]]:
    """Block globs from a table, MOST_GLOBS rows at most; a null is `*`."""
    found = table.select(F.coalesce(F.col(host_col).cast("string"), F.lit("*")), F.coalesce(F.col(path_col).cast("string"), F.lit("*"))).distinct().limit(MOST_GLOBS + 1).collect()
    if len(found) > MOST_GLOBS:
        raise ValueError(f"more than {MOST_GLOBS} globs")
    return sorted(map(tuple, found))


def decoded(text: str) -> str:
    """Escapes of unreserved characters as these characters, other escapes in capitals; one pass."""

    def plain(m: re.Match) -> str:
        c = chr(int(m[1], 16))
        return c if re.fullmatch("[A-Za-z0-9._~-]", c) else m[0].upper()

    return re.sub("%([0-9A-Fa-f]{2})", plain, text)


def canonical(host: str, path: str) -> tuple[str, str]:
    """Host and path with query in canonical form."""
    host = decoded(re.sub(r":[0-9]*\Z", "", host.rpartition("@")[2])).translate(_LOWER).rstrip(".")
    path, mark, query = path.partition("?")
    kept: list[str] = []
    segments = decoded(path).split("/")
    for i, x in enumerate(segments):
        if x == ".." and i:
            del kept[max(len(kept) - 1, 1) :]
        elif x != "." or not i:
            kept.append(x)
    if len(segments) > 1 and segments[-1] in (".", ".."):
        kept.append("")
    return host, "/".join(kept) + mark + decoded(query)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    text = column.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    return np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8), offsets


def _judge(rules: Sequence[Rule], globs: Sequence[tuple[str, str]]):
    by_length = sorted(rules, key=lambda r: -len(r.name))
    packed = [g for r in by_length for g in (quote(r.host) + SPLIT + quote(r.path) + b"*", b"*." + quote(r.host) + SPLIT + quote(r.path) + b"*")]
    ruler, blocker = Globs(packed), Globs([h.encode() + SPLIT + p.encode() for h, p in globs])
    names, verdicts = pa.array([r.name for r in by_length], pa.string()), pa.array([r.verdict for r in by_length], pa.string())
    n = len(by_length)
    most = max(1, STATE_WORDS // (len(ruler.loop) + len(blocker.loop)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), most):
                batch = whole.slice(at, most)
                host, path, target = batch.column("host"), batch.column("query"), batch.column("target")
                hit = ruler.matches(*_flat(target))
                fits = hit[:, 0 : 2 * n : 2] | hit[:, 1 : 2 * n : 2]
                ruled = fits.any(axis=1)
                which = pa.array(fits.argmax(axis=1) if n else np.zeros(len(batch), np.int64), mask=~ruled)
                empty = pc.equal(host, "").to_numpy(zero_copy_only=False)
                odd = np.flatnonzero(batch.column("odd").to_numpy(zero_copy_only=False))
                if len(odd):
                    clean = target.to_pylist()
                    for i in odd.tolist():
                        h, p = canonical(host[i].as_py(), path[i].as_py())
                        clean[i], empty[i] = h.encode() + SPLIT + p.encode(), empty[i] or not h
                    target = pa.array(clean, pa.large_binary())
                bad = blocker.matches(*_flat(target)).any(axis=1) | empty
                method = pa.array(np.where(bad, "block", "allow"), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("id", "host", "path")), names.take(which), pc.coalesce(verdicts.take(which), method)], names=["id", "host", "path", "rule", "verdict"]
                )

    return scan


def judged(pages: DataFrame, rules: Sequence[Rule], globs: Sequence[tuple[str, str]] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id_col, host, path, rule (null if none fits), verdict."""
    if any(set("?#") & set(r.path) for r in rules):
        raise ValueError("a rule's path has no ? or #")
    host, path, query = parts(F.col(url_col).cast("string"))
    target = F.concat(F.encode(host, "UTF-8"), F.unhex(F.lit("FF")), F.encode(query, "UTF-8"))
    bounded_batches(pages.sparkSession)
    odd = host.rlike(r"[@:%]|\.$") | query.rlike(r"%|/\.{1,2}(/|\?|$)")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"), query.alias("query"), odd.alias("odd"), target.alias("target"))
    return rows.mapInArrow(_judge(rules, globs), "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
