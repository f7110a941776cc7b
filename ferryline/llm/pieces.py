"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

The pieces and scores come from a SentencePiece model file, read by the sentencepiece library on the driver; scores of a
BPE model are merge ranks and become Zipf log probabilities, -ln(rank + 1). A text gets one space in front; the
whitespace marker of the pieces stands for a space, so a marker character in the text is itself an unknown character.
A character that no piece covers falls back to its bytes, at a score below every piece. Decoding joins the pieces' bytes
and takes the first space away: it gives every text back exactly.

Scores are whole millionths, so sums are exact and ties do not hang on rounding. A piece has spaces at its front only, so
the best path of a text is the best paths of its segments (spaces and what follows them). Equal segments of a batch are
encoded once, all of them together, one position at a time. A long segment is cut wherever no piece found in it crosses;
what stays long is taken in blocks side by side, each with a run-up before it. A block holds if the scores of its run-up
differ from those of the block before by the same number at every position that a piece can reach back to: then all its
choices are those of the whole segment. Where one does not hold, the segment is walked byte by byte.

Defined results: a null text has null ids and decodes to null; an empty text has no ids; of equal scores the path whose
last piece starts first wins, at every position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm import words
from ferryline.llm.shared import bounded_batches
from ferryline.llm.tokenfiles import gather, spread

MARK = "▁"
MILLION, NEVER = 1_000_000, -(1 << 60)
#: Segments of up to so many bytes are encoded side by side, longer ones in blocks with run-ups; rows of a matrix for each.
SHORT, MATRIX_ROWS = 48, 1 << 15
BLOCK, RUN_UP, BLOCK_ROWS = 192, 64, 1 << 13
_HEAD = np.ones(256, dtype=np.int64)
_HEAD[0xC0:0xE0], _HEAD[0xE0:0xF0], _HEAD[0xF0:] = 2, 3, 4


@dataclass
class Pieces:
    """Double array: the child of state s for byte c is t = base[s] + c where check[t] == s; value[t] is a piece or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    unknown: int
    byte_id: np.ndarray
    text_start: np.ndarray
    text_length: np.ndarray
    text: np.ndarray


def _grown(*columns: np.ndarray) -> list[np.ndarray]:
    """base, check, value and free, twice as long."""
    return [np.concatenate([x, np.full(len(x), fill, x.dtype)]) for x, fill in zip(columns, (0, -1, -1, True), strict=True)]


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie of byte strings, states placed breadth first at the first base that is free."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, i in keys:
        at = 0
        for c in key:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                ends.append(-1)
            at = children[at][c]
        ends[at] = i
    size = 2 * len(children) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, dtype=bool)
    free[0] = False
    place, low, hint, queue = {0: 0}, 256, 256, [0]
    for node in queue:
        kids = children[node]
        if not kids:
            continue
        marks = np.array(sorted(kids), dtype=np.int64)
        if len(marks) == 1:
            b = low - int(marks[0])
        else:
            while True:
                if hint + 2048 > len(free):
                    base, check, value, free = _grown(base, check, value, free)
                window = np.flatnonzero(free[hint : hint + 512])
                fits = window[free[hint + window[:, None] + (marks - marks[0])[None, :]].all(axis=1)]
                if len(fits):
                    b = hint + int(fits[0]) - int(marks[0])
                    break
                hint += 512
            if len(window) < 32:
                hint += 256
        s = place[node]
        base[s] = b
        for c in marks.tolist():
            t = b + c
            free[t], check[t], value[t] = False, s, ends[kids[c]]
            place[kids[c]] = t
            queue.append(kids[c])
        while not free[low]:
            low += 1
            if low + 1 >= len(free):
                base, check, value, free = _grown(base, check, value, free)
    return base, check, value


def load(model_file: str) -> Pieces:
    """The pieces of a model file with byte pieces."""
    import sentencepiece

    return of_model(sentencepiece.SentencePieceProcessor(model_file=model_file))


def of_model(model) -> Pieces:
    """The pieces of a sentencepiece processor with byte pieces."""
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    names = {i: model.id_to_piece(i).replace(MARK, " ").encode() for i in plain}
    if any(b" " in x.lstrip(b" ") for x in names.values()):
        raise ValueError("a piece has a space after another character")
    raw = {i: model.get_score(i) for i in plain}
    ranked = all(x <= 0 and x == int(x) for x in raw.values())
    score = np.zeros(n, dtype=np.int64)
    for i in plain:
        score[i] = round(MILLION * (-np.log(1.0 - raw[i]) if ranked else raw[i]))
    byte_id = np.full(256, -1, np.int32)
    text = [names.get(i, b"") for i in range(n)]
    for i in range(n):
        if model.is_byte(i):
            text[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            byte_id[text[i][0]] = i
    if (byte_id < 0).any():
        raise ValueError("the model has no byte pieces")
    base, check, value = double_array([(names[i], i) for i in plain if names[i]])
    length = np.array([len(x) for x in text])
    return Pieces(base, check, value, score, int(score[plain].min()) - 10 * MILLION, byte_id, np.cumsum(length) - length, length, np.frombuffer(b"".join(text), dtype=np.uint8))


def _step(p: Pieces, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children by byte, and which exist."""
    t = p.base[state] + byte
    ok = t < len(p.check)
    t = np.where(ok, t, 0)
    return t, ok & (p.check[t] == state)


def _forward(p: Pieces, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best score up to each position of the segments in a byte matrix, and length and id of the last piece there."""
    n, wide = rows.shape
    best = np.full((n, wide + 1), NEVER, np.int64)
    best[:, 0] = 0
    back, token = np.ones((n, wide + 1), np.int16), np.full((n, wide + 1), -1, np.int32)
    for i in range(wide):
        live = np.flatnonzero((size > i) & (best[:, i] > NEVER))
        if not len(live):
            continue
        first = rows[live, i].astype(np.int64)
        step = np.minimum(_HEAD[first], size[live] - i)
        for k in range(int(step.max())):  # the bytes of the character, one piece each
            some = live[step > k]
            end = step[step > k] == k + 1
            value = best[some, i] + p.unknown
            better = end & (value > best[some, i + k + 1])
            set_ = some[better | ~end]
            token[set_, i + k + 1], back[set_, i + k + 1] = p.byte_id[rows[set_, i + k]], 1
            best[some[better], i + k + 1] = value[better]
        state, alive, depth = np.zeros(len(live), np.int64), live, 0
        while len(alive):
            state, ok = _step(p, state, rows[alive, i + depth].astype(np.int64))
            state, alive = state[ok], alive[ok]
            depth += 1
            piece = p.value[state]
            hit = piece >= 0
            who, piece = alive[hit], piece[hit]
            value = best[who, i] + p.score[piece]
            better = value > best[who, i + depth]
            who, piece = who[better], piece[better]
            best[who, i + depth], token[who, i + depth], back[who, i + depth] = value[better], piece, depth
            more = size[alive] > i + depth
            state, alive = state[more], alive[more]
    return best, back, token


def _viterbi(p: Pieces, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of the segments in a byte matrix."""
    n, wide = rows.shape
    _, back, token = _forward(p, rows, size)
    out, at, count = np.zeros((n, wide), np.int32), size.copy(), np.zeros(n, np.int64)
    live = np.flatnonzero(at > 0)
    while len(live):
        out[live, count[live]] = token[live, at[live]]
        count[live] += 1
        at[live] -= back[live, at[live]]
        live = live[at[live] > 0]
    start = np.arange(n) * wide
    flat = out[:, ::-1].ravel()
    return gather(flat, start + wide - count, count), count


def _uncrossed(p: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions in the segments data[start:end] that no piece found there and no character crosses, starts included."""
    size = end - start
    every, limit, change = spread(start, size), np.repeat(end, size), np.zeros(len(data) + 1, np.int32)
    for a in range(0, len(every), 1 << 20):
        at, most = every[a : a + (1 << 20)], limit[a : a + (1 << 20)]
        head = (data[at] & 0xC0) != 0x80
        at, most = at[head], most[head]
        change[at + 1] += 1
        change[np.minimum(at + _HEAD[data[at]], most)] -= 1
        state, depth = np.zeros(len(at), np.int64), 0
        while len(at):
            state, ok = _step(p, state, data[at + depth].astype(np.int64))
            state, at, most = state[ok], at[ok], most[ok]
            depth += 1
            hit = at[p.value[state] >= 0]
            change[hit + 1] += 1
            change[hit + depth] -= 1
            more = at + depth < most
            state, at, most = state[more], at[more], most[more]
    return every[np.cumsum(change)[every] == 0]


def _heads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The positions moved back to the first bytes of their characters."""
    for _ in range(3):
        at = at - ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)
    return at


def _viterbi_blocks(p: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
    """Ids of long segments data[start:end], in blocks with run-ups."""
    reach = int(p.text_length.max())
    n = -(-(end - start) // BLOCK)
    of = np.repeat(np.arange(len(start)), n)
    mid = np.maximum(_heads(data, start[of] + BLOCK * spread(np.zeros_like(n), n)), start[of])
    low = np.maximum(_heads(data, np.maximum(mid - max(RUN_UP, 2 * reach), start[of])), start[of])
    high = np.append(mid[1:], 0)
    high[np.cumsum(n) - 1] = end
    back, token = np.zeros(len(data) + 1, np.int16), np.zeros(len(data) + 1, np.int32)
    edges: list[list[np.ndarray]] = [[], []]
    for a in range(0, len(of), BLOCK_ROWS):
        lo, mi, hi, first = (x[a : a + BLOCK_ROWS] for x in (low, mid, high, start[of]))
        size = hi - lo
        at = lo[:, None] + np.arange(int(size.max()))[None, :]
        best, b, t = _forward(p, data[np.minimum(at, len(data) - 1)], size)
        row, place = np.repeat(np.arange(len(lo)), hi - mi), spread(mi + 1, hi - mi)
        back[place], token[place] = b[row, place - lo[row]], t[row, place - lo[row]]
        for kept, edge in zip(edges, (mi, hi), strict=True):  # scores before the block and at its end, less the last one
            seen = edge[:, None] - np.arange(reach + 1)[None, :]
            score = np.take_along_axis(best, np.maximum(seen - lo[:, None], 0), axis=1)
            kept.append(np.where(seen < first[:, None], 0, np.where(score > NEVER, score - score[:, :1], NEVER)))
    before, after = np.concatenate(edges[0]), np.concatenate(edges[1])
    holds = np.ones(len(of), dtype=bool)
    holds[1:] = (of[1:] != of[:-1]) | (before[1:] == after[:-1]).all(axis=1)
    whole = np.bincount(of, weights=~holds, minlength=len(start)) == 0
    out = []
    for a, b, ok in zip(start.tolist(), end.tolist(), whole.tolist(), strict=True):
        if not ok or reach + 4 > BLOCK:
            out.append(_viterbi_long(p, data[a:b].tobytes()))
            continue
        step, ids, at, path = back[a : b + 1].tolist(), token[a : b + 1].tolist(), b - a, []
        while at:
            path.append(ids[at])
            at -= step[at]
        out.append(path[::-1])
    return out


def _viterbi_long(p: Pieces, segment: bytes) -> list[int]:
    """The same for one long segment."""
    n = len(segment)
    base, check, value, score = _lists(p)
    best, back, token = [NEVER] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
    best[0] = 0
    for i in range(n):
        if best[i] == NEVER:
            continue
        k = min(int(_HEAD[segment[i]]), n - i)
        for j in range(1, k + 1):
            if j < k or best[i] + p.unknown > best[i + k]:
                token[i + j], back[i + j] = int(p.byte_id[segment[i + j - 1]]), 1
                if j == k:
                    best[i + k] = best[i] + p.unknown
        state, j = 0, i
        while j < n:
            t = base[state] + segment[j]
            if t >= len(check) or check[t] != state:
                break
            state, j = t, j + 1
            v = value[t]
            if v >= 0 and best[i] + score[v] > best[j]:
                best[j], token[j], back[j] = best[i] + score[v], v, j - i
    out, at = [], n
    while at:
        out.append(token[at])
        at -= back[at]
    return out[::-1]


_as_lists: dict[int, tuple] = {}


def _lists(p: Pieces) -> tuple:
    if id(p) not in _as_lists:
        _as_lists.clear()
        _as_lists[id(p)] = (p.base.tolist(), p.check.tolist(), p.value.tolist(), p.score.tolist())
    return _as_lists[id(p)]


def encode(p: Pieces, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another and their number per text; null is empty."""
    fronted = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise("", column, " ")) if len(column) else column
    out, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for t in words.texts(fronted):
        data, edge = t.data, t.edge
        space = data == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[edge[edge < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))[: len(start)]
        if (long := end - start > SHORT).any():
            start = np.sort(np.concatenate([start[~long], _uncrossed(p, data, start[long], end[long])]))
            end = np.append(start[1:], len(data))[: len(start)]
        value = words.BYTE_VALUES[data]
        keys = np.stack([words.spans_hash(value, start, end, b) for b in (words.WORD_BASE, words.WINDOW_BASE)], axis=1)
        _, first, which = np.unique(keys[:, 0], return_index=True, return_inverse=True)
        if (keys[first][which, 1] != keys[:, 1]).any():  # two segments under one hash
            first = which = np.arange(len(start))
        size = (end - start)[first]
        order = np.argsort(-size, kind="stable")
        long = int((size > SHORT).sum())
        far = first[order[:long]]
        ids = [np.array(x, np.int32) for x in _viterbi_blocks(p, data, start[far], end[far])] if long else []
        n = [np.array([len(x) for x in ids], np.int64)]
        for a in range(long, len(order), MATRIX_ROWS):
            part = order[a : a + MATRIX_ROWS]
            wide = int(size[part[0]])
            at = start[first[part]][:, None] + np.arange(wide)[None, :]
            one, m = _viterbi(p, data[np.minimum(at, len(data) - 1)], size[part])
            ids.append(one)
            n.append(m)
        length = np.concatenate(n)
        flat, begin = np.concatenate([np.zeros(0, np.int32), *ids]), np.cumsum(length) - length
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        slot = back[which]
        out.append(gather(flat, begin[slot], length[slot]))
        total = np.concatenate([[0], np.cumsum(length[slot])])
        counts.append(np.diff(total[np.searchsorted(start, edge)]))
    return np.concatenate(out), np.concatenate(counts)


def decode(p: Pieces, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Texts of lists of ids."""
    length = p.text_length[ids]
    flat = gather(p.text, p.text_start[ids], length)
    at = np.concatenate([[0], np.cumsum(length)])[offsets]
    raw = flat.tobytes()
    return [raw[a + 1 : b] if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with bounded bytes of text or ids."""
    c = batch.column(column)
    size = pc.fill_null(pc.binary_length(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else pc.list_value_length(c), 0)
    block = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64) // (4 * words.CHUNK_BYTES)
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def encoded(docs: DataFrame, pieces: Pieces, text_col: str = "text", into: str = "piece_ids") -> DataFrame:
    """docs with the column `into`, array<int>, of each text's piece ids; it replaces a column of that name."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # as large as the vocabulary

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for whole in batches:
            for batch in _blocks(whole, text_col):
                ids, n = encode(p, batch.column(text_col))
                offset = np.concatenate([[0], np.cumsum(n)])
                void = batch.column(text_col).is_null().to_numpy(zero_copy_only=False)
                yield _with_column(batch, into, pa.ListArray.from_arrays(pa.array(offset, pa.int32(), mask=np.append(void, False)), pa.array(ids)))

    return docs.mapInArrow(scan, docs.select("*", F.lit(None).cast("array<int>").alias(into)).schema)


def decoded(rows: DataFrame, pieces: Pieces, ids_col: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """rows with the column `into`, the text of each list of piece ids; it replaces a column of that name."""
    bounded_batches(rows.sparkSession)
    rows = rows.drop(into)
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for whole in batches:
            for batch in _blocks(whole, ids_col):
                lists = batch.column(ids_col)
                offset = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts = decode(p, lists.flatten().to_numpy(), offset)
                void = lists.is_null().to_pylist()
                yield _with_column(batch, into, pa.array([None if v else x.decode("utf-8", "replace") for x, v in zip(texts, void, strict=True)], pa.string()))

    return rows.mapInArrow(scan, rows.select("*", F.lit(None).cast("string").alias(into)).schema)
