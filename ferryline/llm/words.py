"""Word boundaries and Rabin-Karp hashes of many texts at once, on the bytes of an Arrow column.

A word is a maximal run of bytes other than space and 0x09-0x0D, which is `[^\\x20\\x09-\\x0D]+` over UTF-8.
Hashes are polynomials modulo 2**64, taken as differences of one running sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
WORD_BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xD1342543DE82EF95

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Each byte with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits (xor-shift and multiply, one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 8 * CHUNK_BYTES:
            _powers[base] = have
    return have


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[s:e] for each pair, independent of where the span lies."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Texts:
    """Some texts of a batch. Word i of the chunk is bytes data[start[i]:end[i]]; text t has words
    first[t]:first[t+1] and bytes edge[t]:edge[t+1]."""

    rows: slice
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    edge: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def word_hashes(self) -> np.ndarray:
        return spans_hash(BYTE_VALUES[self.data], self.start, self.end, WORD_BASE)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def joined(self, t: int, keep: np.ndarray | None = None) -> bytes:
        """The words of text t, or those with keep, joined by one space."""
        a, b = self.first[t], self.first[t + 1]
        idx = np.arange(a, b) if keep is None else a + np.flatnonzero(keep)
        if not len(idx):
            return b""
        s, e = self.start[idx], self.end[idx]
        length = e - s + 1
        at = np.cumsum(length) - length
        src = np.repeat(s - at, length) + np.arange(int(length.sum()))
        out = self.data[np.minimum(src, len(self.data) - 1)]
        out[at + length - 1] = 32
        return out[:-1].tobytes()


def texts(column: pa.Array, gap: np.ndarray = _SPACE) -> Iterator[Texts]:
    """The texts of a string column in chunks of about CHUNK_BYTES; a longer text is a chunk of its own. Null is empty.

    gap says of each byte whether it stands between words."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
        data = whole[offsets[a] : offsets[b]]
        edge = offsets[a : b + 1] - offsets[a]
        inside = ~gap[data]
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        before[edge[edge < len(data)]] = False
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        yield Texts(slice(a, b), data, start, end, np.searchsorted(start, edge), edge)
        a = b


def windows(values: np.ndarray, owner: np.ndarray, k: int, base: int = WINDOW_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k values of one owner, and where it starts."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return spans_hash(values, at, at + k, base), at


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k neighbours."""
    width, out = 1, x
    while 2 * width <= k:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(out) - (k - width)], out[k - width :]) if k > width else out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
