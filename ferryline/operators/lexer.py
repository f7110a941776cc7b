"""Constructs of database code, found in one pass over its tokens.

The texts of an Arrow batch are laid end to end with a byte between them that UTF-8 lacks. Literals, quoted names and
comments are taken out first. What is left is cut into tokens: words (letters, digits, _, all beyond ASCII) and single
marks; white space only parts words. Each token is a number: one for each word or mark that a phrase names, one for all
other words, one for all other marks. A phrase is tested where its rarest fixed token stands, so the cost hardly depends on
the number of phrases.

Defined results: a null text holds nothing; a literal, quoted name or comment without an end runs to the end of its text.
A text's memory is its bytes, their copy without literals, and two bytes a token.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text taken at once (at least one text), and bytes cut into tokens at once.
GROUP_BYTES, BLOCK_BYTES = 4 << 20, 1 << 20
_END = rb"(?=\xff)"
_OPEN = {"[": "]", "{": "}", "(": ")", "<": ">"}
_NO_LETTER = rb"[^0-9A-Za-z_\x80-\xfe]"
_QUOTED = b"|".join(re.escape(a.encode()) + rb"[^\xff]*?(?:" + re.escape(b.encode()) + b"'|" + _END + b")" for a, b in _OPEN.items())
#: Literals, those with marks of their own (q'[...]') too, quoted names and comments, in texts that 0xFF ends.
_SKIP = re.compile(
    rb"'(?:(?:(?<=" + _NO_LETTER + rb"[qQ]')|(?<=" + _NO_LETTER + rb"[nN][qQ]'))(?:" + _QUOTED + rb"|([^\s\[{(<\xff'])[^\xff]*?(?:\1'|" + _END + rb"))|[^'\xff]*(?:'|" + _END + rb"))"
    rb'|"[^"\xff]*(?:"|' + _END + rb")|--[^\n\xff]*|/\*[^\xff]*?(?:\*/|" + _END + b")"
)
#: The same for columns.
SKIP = (
    r"'(?:(?<=(?:^|\W)[nN]?[qQ]')(?:" + "|".join(rf"\{a}(?s:.*?)(?:\{b}'|\z)" for a, b in _OPEN.items()) + r"|([^\s\[{(<'])(?s:.*?)(?:\1'|\z))|[^']*+(?:'|\z))"
    r'|"[^"]*+(?:"|\z)|--[^\n]*+|/\*(?s:.*?)(?:\*/|\z)'
)
_SEP, _MARK, _WORD = 0, 1, 2
_UPPER = np.frombuffer(bytes(range(256)).upper(), np.uint8)
_IN_WORD = np.array([chr(c).isalnum() or c == 95 if c < 128 else c < 255 for c in range(256)])
_IS_MARK = ~_IN_WORD & ~np.isin(np.arange(256), list(b" \t\n\r\f\v"))


class Lexer:
    """Phrases by name. In a phrase words are keywords, @ is any word, … is any run without brackets and commas, and other
    characters stand for themselves."""

    def __init__(self, phrases: Mapping[str, Sequence[str]]):
        self.names = list(phrases)
        parsed = [(k, p.upper().split()) for k, name in enumerate(self.names) for p in phrases[name]]
        fixed = {x for _, p in parsed for x in p if x not in "@…"} | set("(),")
        self.keys = np.array(sorted(x.encode() for x in fixed if len(x) > 1 or x.isalnum()))
        self.number = {x.decode(): i + 3 for i, x in enumerate(self.keys)}
        self.last_word = 2 + len(self.keys)
        self.number |= {x: self.last_word + 1 + i for i, x in enumerate(sorted(fixed - set(self.number)))}
        self.width = self.keys.dtype.itemsize
        self.maybe = np.zeros((256, self.width + 2), bool)
        for x in self.keys:
            self.maybe[x[0], len(x)] = True
        self.mark = np.full(256, _MARK, np.int16)
        self.mark[255] = _SEP
        for x, i in self.number.items():
            if i > self.last_word:
                self.mark[ord(x)] = i
        self.phrases = [(k, [{"@": -1, "…": -2}.get(x) or self.number[x] for x in p]) for k, p in parsed]

    def _block(self, block: np.ndarray) -> np.ndarray:
        """Numbers of the tokens of upper-case bytes."""
        word = _IN_WORD[block]
        before = np.concatenate([[False], word[:-1]])
        at = np.flatnonzero((word & ~before) | _IS_MARK[block])
        is_word = word[at]
        out = self.mark[block[at]]
        start = at[is_word]
        ends = np.flatnonzero(before & ~word)
        size = np.append(ends, len(block))[: len(start)] - start
        maybe = np.flatnonzero(self.maybe[block[start], np.minimum(size, self.width + 1)])
        step = np.arange(self.width)
        spelt = block[np.minimum(start[maybe, None] + step, len(block) - 1)] * (step < size[maybe, None])
        spelt = np.ascontiguousarray(spelt.astype(np.uint8)).view(self.keys.dtype)[:, 0] if len(maybe) else self.keys[:0]
        place = np.minimum(np.searchsorted(self.keys, spelt), len(self.keys) - 1)
        found = np.full(len(start), _WORD, np.int16)
        found[maybe] = np.where(self.keys[place] == spelt, place + 3, _WORD)
        out[is_word] = found
        return out

    def tokens(self, texts: bytes) -> np.ndarray:
        """Numbers of all tokens outside literals and comments; 0xFF ends each text."""
        data = np.frombuffer(_SKIP.sub(b" ", texts), np.uint8)
        out, begin = [], 0
        while begin < len(data):
            end = min(begin + BLOCK_BYTES, len(data))
            while end < len(data) and _IN_WORD[data[end]]:  # no word is cut
                run = np.flatnonzero(~_IN_WORD[data[end : end + BLOCK_BYTES]])
                end = end + int(run[0]) if len(run) else min(end + BLOCK_BYTES, len(data))
            out.append(self._block(_UPPER[data[begin:end]]))
            begin = end
        return np.concatenate([*out, np.zeros(8, np.int16)])

    def find(self, texts: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Text and name (numbers) of all phrases found, each pair once, in order."""
        ids = self.tokens(b"\xff" + texts)  # the first mark is before the first text
        known = np.flatnonzero(ids > _WORD)
        by_id = known[np.argsort(ids[known], kind="stable")]
        edge = np.searchsorted(ids[by_id], np.arange(self.last_word + len(self.number) + 2))
        stops = None
        rows, names = [], []
        ends = np.flatnonzero(ids == _SEP)
        for name, phrase in self.phrases:
            head = 0 if -2 in phrase else min((i for i, x in enumerate(phrase) if x > 0), key=lambda i: edge[phrase[i] + 1] - edge[phrase[i]])
            at = by_id[edge[phrase[head]] : edge[phrase[head] + 1]] - head
            at = at[at >= 0]
            here = at
            for x in phrase:
                if not len(at):
                    break
                if x == -2:
                    if stops is None:
                        stops = np.flatnonzero((ids == _SEP) | np.isin(ids, [self.number[c] for c in "(),"]))
                    here = stops[np.minimum(np.searchsorted(stops, here), len(stops) - 1)]
                    continue
                now = ids[np.minimum(here, len(ids) - 1)]
                fits = (now >= _WORD) & (now <= self.last_word) if x == -1 else now == x
                at, here = at[fits], here[fits] + 1
            rows.append(np.searchsorted(ends, at) - 1)
            names.append(np.full(len(at), name))
        pairs = np.unique(np.concatenate(rows) * len(self.names) + np.concatenate(names))
        return pairs // len(self.names), pairs % len(self.names)

    def warnings(self, texts: pa.Array) -> pa.Array:
        """List of the names found in each text."""
        names, texts = pa.array(self.names, pa.string()), texts.cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
        out, begin = [], 0
        ends = np.cumsum(sizes)
        while begin < len(texts):
            done = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + GROUP_BYTES, "right")))
            row, name = self.find(b"".join((x or b"") + b"\xff" for x in texts[begin:end].to_pylist()))
            offsets = np.searchsorted(row, np.arange(end - begin + 1)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(name))))
            begin = end
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


def warnings(text: Column, phrases: Mapping[str, Sequence[str]]) -> Column:
    """Array of the names of phrases that a text holds outside literals and comments, in the order of the phrases."""
    lexer = Lexer(phrases)
    return F.arrow_udf(lambda texts: lexer.warnings(texts), "array<string>")(text.cast("string"))


def pieces(text: Column, pattern: str, between: Callable[[Column], Column], found: Callable[[Column], Column]) -> Column:
    """The text with between() applied to what lies between the finds of a pattern, and found() to each find."""
    rows = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, b: F.concat(between(a), F.coalesce(found(b), F.lit(""))))
    return F.array_join(rows, "")
