"""Byte-level BPE over length-bucketed, padded matrices.

The pre-tokens of a slice are found without a loop, and each distinct one is encoded once: those of about equal
length share a matrix of ids, in which every row merges its leftmost pair of least rank each round. Pairs are
looked up in an open-addressing hash table; rows that are done leave the matrix, and its width follows the rest.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrays import byte_slices, span_hash, text_bytes
from .common import batch, id_text, list_array, released
from .pretoken import code_points, starts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLICE = 4 << 20
WIDEST = 256
MEMO_ROWS = 1 << 20
NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Merge ranks as arrays; ids are ranks."""

    byte_id: np.ndarray  # id of each single byte
    keys: np.ndarray  # open addressing: left << 32 | right, or -1
    values: np.ndarray  # id of the merged token
    shift: int
    token_bytes: np.ndarray
    token_start: np.ndarray

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NONE where there is none."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = ((key.view(np.uint64) * _MULTIPLIER) >> np.uint64(self.shift)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NONE)
        todo = np.flatnonzero((found != key) & (found != -1))
        mask = len(self.keys) - 1
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of these ids, one after the other."""
        a = self.token_start[ids]
        n = self.token_start[ids + 1] - a
        total = int(n.sum())
        return self.token_bytes[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(total)]


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Reads a rank file: a base64 token and its rank on each line; every single byte must be a token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    for t, r in ranks.items():
        tokens[r] = t
    pairs = [((ranks[t[:k]] << 32) | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    bits = max(4, int(len(pairs) * 2.5).bit_length())
    keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
    shift, mask = 64 - bits, (1 << bits) - 1
    for key, r in pairs:
        at = (key * int(_MULTIPLIER) & 0xFFFFFFFFFFFFFFFF) >> shift
        while keys[at] != -1:
            at = (at + 1) & mask
        keys[at], values[at] = key, r
    start = np.zeros(size + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=start[1:])
    return Vocabulary(np.array([ranks[bytes([b])] for b in range(256)], np.int32), keys, values, shift, np.frombuffer(b"".join(tokens), np.uint8), start)


def _merge_rows(v: Vocabulary, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges each padded row to the end; gives the rows and their sizes."""
    done_ids, done_size = ids.copy(), size.copy()
    rows = np.arange(len(ids))
    column = np.arange(ids.shape[1])
    rank = np.full((len(ids), max(1, ids.shape[1] - 1)), NONE, np.int32)
    if ids.shape[1] > 1:
        real = column[1:][None, :] < size[:, None]
        rank[real] = v.pair(ids[:, :-1][real], ids[:, 1:][real])
    while True:
        at = rank.argmin(axis=1)
        best = rank[np.arange(len(rank)), at]
        go = best != NONE
        if not go.all():
            stop = ~go
            w = ids.shape[1]
            done_ids[rows[stop], :w], done_size[rows[stop]] = ids[stop], size[stop]
            rows, ids, size, rank, at, best = rows[go], ids[go], size[go], rank[go], at[go], best[go]
        if not len(rows):
            return done_ids, done_size
        n, w = ids.shape
        source = column[:w][None, :] + (column[:w][None, :] > at[:, None])
        ids = np.take_along_axis(ids, np.minimum(source, w - 1), axis=1)
        ids[np.arange(n), at] = best
        size = size - 1
        w = max(int(size.max()), 2)
        ids = ids[:, :w]
        source = column[: w - 1][None, :] + (column[: w - 1][None, :] > at[:, None])
        rank = np.take_along_axis(rank, np.minimum(source, rank.shape[1] - 1), axis=1)
        rank[column[: w - 1][None, :] >= (size - 1)[:, None]] = NONE
        for k in (at - 1, at):
            ok = np.flatnonzero((k >= 0) & (k + 1 < size))
            rank[ok, k[ok]] = v.pair(ids[ok, k[ok]], ids[ok, k[ok] + 1])


def _merge_long(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """One very long pre-token by a heap over a linked list: the same merges in O(n log n)."""
    n = len(ids)
    tok, nxt, prv, alive = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    rank = v.pair(ids[:-1], ids[1:])
    heap = [(int(r), i, tok[i], tok[i + 1]) for i, r in enumerate(rank.tolist()) if r != NONE]
    heapq.heapify(heap)

    def push(i: int) -> None:
        j = nxt[i]
        if i >= 0 and j < n:
            r = int(v.pair(np.array([tok[i]], np.int32), np.array([tok[j]], np.int32))[0])
            if r != NONE:
                heapq.heappush(heap, (r, i, tok[i], tok[j]))

    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or tok[i] != a or tok[j] != b:
            continue
        tok[i], alive[j], nxt[i] = r, False, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        if prv[i] >= 0:
            push(prv[i])
        push(i)
    return np.array([t for t, a in zip(tok, alive, strict=True) if a], np.int32)


def encode_spans(v: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each span, flat, and how many each has."""
    n = end - start
    count = np.zeros(len(n), np.int64)
    pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = 0
    for width in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, WIDEST):
        pick = np.flatnonzero((n > low) & (n <= width))
        low = width
        for part in np.array_split(pick, max(1, len(pick) * width >> 20)):
            if len(part):
                at = start[part][:, None] + np.arange(width)[None, :]
                ids = v.byte_id[data[np.minimum(at, len(data) - 1)]]
                ids, size = _merge_rows(v, ids, n[part])
                count[part] = size
                pieces.append((part, ids, size))
    long = [(i, _merge_long(v, v.byte_id[data[start[i] : end[i]]])) for i in np.flatnonzero(n > WIDEST).tolist()]
    for i, ids in long:
        count[i] = len(ids)
    out_at = np.r_[0, np.cumsum(count)]
    flat = np.zeros(out_at[-1], np.int32)
    for part, ids, size in pieces:
        real = np.arange(ids.shape[1])[None, :] < size[:, None]
        flat[(out_at[part][:, None] + np.arange(ids.shape[1])[None, :])[real]] = ids[real]
    for i, ids in long:
        flat[out_at[i] : out_at[i + 1]] = ids
    return flat, count


class Memo:
    """Ids of the pre-tokens that a worker has met, by hash; beyond MEMO_ROWS it takes no more, and encoding goes on without."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def spans(self, v: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each distinct span's begin there, how many it has)."""
        at = np.searchsorted(self.hashes, h)
        known = np.zeros(len(h), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == h[inside]
        where, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        where[known], count[known] = self.start[at[known]], self.count[at[known]]
        new = np.flatnonzero(~known)
        if not len(new):
            return self.ids, where, count
        fresh, n = encode_spans(v, data, start[new], end[new])
        ids = np.r_[self.ids, fresh]
        where[new], count[new] = len(self.ids) + np.cumsum(n) - n, n
        if len(self.hashes) + len(new) <= MEMO_ROWS:
            order = np.argsort(h[new])
            place, new = at[new][order], new[order]
            self.hashes = np.insert(self.hashes, place, h[new])
            self.start, self.count = np.insert(self.start, place, where[new]), np.insert(self.count, place, count[new])
            self.ids = ids
        return ids, where, count


def memo_of(v: Vocabulary) -> Memo:
    """The worker's own memo of this vocabulary; it isn't sent with it."""
    if not hasattr(v, "_memo"):
        v._memo = Memo()
    return v._memo


def count_texts(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many ids each row of a slice has."""
    points, byte_at, rows = code_points(data, offsets)
    first = starts(points, rows)
    if not len(first):
        return np.zeros(len(offsets) - 1, np.int64)
    start = byte_at[first]
    end = np.r_[start[1:], len(data)]
    code, distinct = pd.factorize(span_hash(data, start, end))
    where = np.empty(len(distinct), np.int64)
    where[code[::-1]] = np.arange(len(code))[::-1]
    n = memo_of(v).spans(v, data, start[where], end[where], distinct)[2][code]
    return np.diff(np.r_[0, np.cumsum(n)][np.searchsorted(first, rows)])


def encode_texts(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every row of a slice, flat, and how many each row has."""
    points, byte_at, rows = code_points(data, offsets)
    first = starts(points, rows)
    if not len(first):
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    start = byte_at[first]
    end = np.r_[start[1:], len(data)]
    code, distinct = pd.factorize(span_hash(data, start, end))
    where = np.empty(len(distinct), np.int64)
    where[code[::-1]] = np.arange(len(code))[::-1]
    ids, count = encode_spans(v, data, start[where], end[where])
    at = np.r_[0, np.cumsum(count)]
    n = count[code]
    stop = np.cumsum(n)
    flat = ids[np.repeat(at[code] - (stop - n), n) + np.arange(int(stop[-1]))]
    per_row = np.diff(np.r_[0, stop][np.searchsorted(first, rows)])
    return flat, per_row


def token_batches(b: pa.RecordBatch, v: Vocabulary) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch with their bytes, offsets, flat ids and counts."""
    data, off = text_bytes(b.column("text"))
    for lo, hi in byte_slices(off, SLICE):
        part, rel = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        ids, count = encode_texts(v, part, rel)
        yield b.slice(lo, hi - lo), part, rel, ids, count


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, tokens, decoded: the text's ids, and whether decoding them gives back its bytes.

    An empty text has 0 tokens; a null text has null n_tokens, tokens and decoded; an empty table gives an empty
    result. Rows are kept as they are, repeated and null ids included; extra columns are ignored, whatever their names. Of
    pairs of equal rank the leftmost is merged first. Texts of any length are taken whole; pre-tokens over WIDEST bytes
    are merged by a heap, with the same result. Bytes that aren't UTF-8 count as U+FFFD, and ``decoded`` is about that
    text. The vocabulary is read on the driver; some MB of tables are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            for part, data, off, ids, count in token_batches(b, v):
                back = v.decode(ids)
                if np.array_equal(back, data):
                    same = np.ones(len(count), bool)
                else:
                    stop = np.r_[0, np.cumsum(count)]
                    same = np.array([np.array_equal(v.decode(ids[stop[i] : stop[i + 1]]), data[off[i] : off[i + 1]]) for i in range(len(count))], bool)
                gone = part.column("text").is_null()
                yield batch(doc_id=part.column("doc_id"), n_tokens=_unless(gone, pa.array(count.astype(np.int32))), tokens=_unless(gone, list_array(ids, count, pa.int32())), decoded=_unless(gone, pa.array(same)))

    return id_text(docs).mapInArrow(released(run), "doc_id long, n_tokens int, tokens array<int>, decoded boolean")


def _unless(gone: pa.Array, values: pa.Array) -> pa.Array:
    return pc.if_else(pc.invert(gone), values, pa.nulls(len(values), values.type)) if pc.any(gone).as_py() else values


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text from doc_id, tokens. Null tokens, an id outside the vocabulary or bytes that aren't UTF-8 give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        size = len(v.token_start) - 1
        for b in batches:
            texts: list[str | None] = []
            for ids in b.column("tokens"):
                a = None if not ids.is_valid or ids.values.null_count else ids.values.to_numpy().astype(np.int64)
                if a is None or (len(a) and (a.min() < 0 or a.max() >= size)):
                    texts.append(None)
                    continue
                try:
                    texts.append(v.decode(a).tobytes().decode("utf-8") if len(a) else "")
                except UnicodeDecodeError:
                    texts.append(None)
            yield batch(doc_id=b.column("doc_id"), text=pa.array(texts, pa.string()))

    return encoded.select("doc_id", "tokens").mapInArrow(released(run), "doc_id long, text string")
