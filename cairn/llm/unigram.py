"""Unigram token counts by dynamic programming over a trie of the distinct pre-tokens.

A pre-token is a run of characters without white space, with the word mark U+2581 before it. The best
segmentation of a prefix doesn't depend on what follows, so each trie node's forward score is computed once for
all pre-tokens that share the prefix; the nodes where pre-tokens end hold their token counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import BASE, U64, byte_slices, mix, runs, span_hash, text_bytes
from .common import batch, id_text, released
from .pretoken import SPACE, classes, code_points

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
UNKNOWN_PENALTY = 10.0
LONG_WORD = 256
SLICE = 4 << 20


@dataclass
class Pieces:
    """Pieces and their log-probabilities, also as a hash table of their polynomial hashes."""

    score: dict[str, float]
    keys: np.ndarray
    values: np.ndarray
    shift: int
    longest: int
    unknown: float

    def find(self, h: np.ndarray) -> np.ndarray:
        """Score of each hash, -inf where no piece has it."""
        h = mix(h)
        at = (h >> U64(self.shift)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == h, self.values[at], -np.inf)
        todo = np.flatnonzero((found != h) & (found != 0))
        mask = len(self.keys) - 1
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            found = self.keys[at[todo]]
            hit = found == h[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != 0)]
        return out


def make_pieces(score: dict[str, float]) -> Pieces:
    """Pieces from their scores; the score of an unknown character is the least score less UNKNOWN_PENALTY."""
    score = {p: s for p, s in score.items() if p}
    if not score:
        raise ValueError("no pieces")
    bits = max(4, (len(score) * 3).bit_length())
    keys, values = np.zeros(1 << bits, U64), np.full(1 << bits, -np.inf)
    for p, s in score.items():
        h = 0
        for c in p:
            h = (h * int(BASE) + ord(c) + 1) % (1 << 64)
        h = int(mix(np.array([h], U64))[0])
        at = h >> (64 - bits)
        while keys[at] != 0:
            at = (at + 1) & ((1 << bits) - 1)
        keys[at], values[at] = h, s
    return Pieces(score, keys, values, 64 - bits, max(map(len, score)), min(score.values()) - UNKNOWN_PENALTY)


def load_pieces(path: str = MODEL) -> Pieces:
    """The normal pieces of a sentencepiece model.

    Scores of a unigram model are taken as they are. Where the file only ranks its pieces (scores that are the
    negated rank), a piece's log-probability is that of Zipf's law, -log(rank + 2.7) up to a constant.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    usual = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    raw = {model.id_to_piece(i): model.get_score(i) for i in usual}
    ranked = all(float(s).is_integer() and s <= 0 for s in raw.values())
    norm = float(np.log(np.sum(1 / (np.arange(len(raw)) + 2.7))))
    return make_pieces({p: float(-np.log(2.7 - s) - norm) for p, s in raw.items()} if ranked else raw)


def utf8_length(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def count_word(v: Pieces, word: str) -> int:
    """Tokens of one word, mark included: the plain recurrence, used for very long words."""
    best, count = [0.0], [0]
    for i in range(1, len(word) + 1):
        top, least = -np.inf, 0
        for n in range(1, min(v.longest, i) + 1):
            s = v.score.get(word[i - n : i])
            extra = 1
            if s is None:
                if n > 1:
                    continue
                s, extra = v.unknown, len(word[i - 1].encode())
            s, c = best[i - n] + s, count[i - n] + extra
            if s > top or (s == top and c < least):
                top, least = s, c
        best.append(top)
        count.append(least)
    return count[-1]


def count_words(v: Pieces, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Token counts of distinct words, given as spans of code points without the mark."""
    size = end - start
    out = np.zeros(len(size), np.int64)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = count_word(v, chr(MARK) + points[start[i] : end[i]].tobytes().decode("utf-32-le"))
    # node 0 is the root, node 1 the mark; levels are appended one after the other
    mark = U64(MARK + 1)
    first = float(v.find(np.array([mark]))[0])
    known = first > -np.inf
    parent, path = [np.zeros(2, np.int64)], [np.array([0, mark], U64)]
    best = [np.array([0.0, first if known else v.unknown])]
    count = [np.array([0, 1 if known else 3], np.int64)]
    words = np.flatnonzero((size <= LONG_WORD) & (size > 0))
    node = np.ones(len(words), np.int64)
    total, depth = 2, 1
    power = [U64(1)]
    for _ in range(v.longest):
        power.append(U64(int(power[-1]) * int(BASE) % (1 << 64)))
    up, hashes, score, tokens = parent[0], path[0], best[0], count[0]
    room = 0
    while len(words):
        c = points[start[words] + depth - 1].astype(np.int64)
        code, key = pd.factorize((node << 21) | c)
        over, char = key >> 21, key & 0x1FFFFF
        m = len(key)
        if total + m > room:
            room = max(2 * (total + m), 1 << 16)
            grow = lambda x: np.r_[x[:total], np.zeros(room - total, x.dtype)]
            up, hashes, score, tokens = grow(up), grow(hashes), grow(score), grow(tokens)
        own = slice(total, total + m)
        up[own] = over
        hashes[own] = hashes[over] * BASE + (char + 1).astype(U64)
        top, least = np.full(m, -np.inf), np.zeros(m, np.int64)
        anc = over
        for n in range(1, min(v.longest, depth + 1) + 1):
            s = v.find(hashes[own] - hashes[anc] * power[n])
            extra = np.ones(m, np.int64)
            if n == 1:
                lost = s == -np.inf
                s = np.where(lost, v.unknown, s)
                extra = np.where(lost, utf8_length(char), 1)
            s = score[anc] + s
            k = tokens[anc] + extra
            better = (s > top) | ((s == top) & (k < least))
            top, least = np.where(better, s, top), np.where(better, k, least)
            anc = up[anc]
        score[own], tokens[own] = top, least
        node = total + code
        ends = size[words] == depth
        out[words[ends]] = tokens[node[ends]]
        words, node = words[~ends], node[~ends]
        total += m
        depth += 1
    return out


def count_rows(v: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, tokens) of each row of a slice."""
    points, byte_at, rows = code_points(data, offsets)
    start, end = runs(classes()[points] != SPACE, rows)
    if not len(start):
        return np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    code, distinct = pd.factorize(span_hash(data, byte_at[start], byte_at[end]))
    where = np.empty(len(distinct), np.int64)
    where[code[::-1]] = np.arange(len(code))[::-1]
    tokens = count_words(v, points, start[where], end[where])[code]
    at = np.searchsorted(start, rows)
    return np.diff(at), np.diff(np.r_[0, np.cumsum(tokens)][at])


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_words, n_tokens: tokens of the best unigram segmentation of each text's words.

    Of segmentations of equal score the one of fewer tokens counts. A character that no piece covers falls back to
    its bytes, a token each. Empty and white-space texts have 0 and 0, a null text nulls; an empty table gives an empty
    result. Texts of any length are taken whole; bytes that aren't UTF-8 count as U+FFFD. Rows are kept as they are,
    repeated and null ids included; extra columns are ignored, whatever their names. Words over LONG_WORD characters are scored one
    by one with the same result. The model is read on the driver and its tables, 2 MB or so, are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b.column("text"))
            for lo, hi in byte_slices(off, SLICE):
                part = b.slice(lo, hi - lo)
                n, t = count_rows(shared.value, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                gone = part.column("text").is_null().to_numpy(zero_copy_only=False)
                yield batch(doc_id=part.column("doc_id"), n_words=pa.array(n.astype(np.int32), mask=gone), n_tokens=pa.array(t.astype(np.int32), mask=gone))

    return id_text(docs).mapInArrow(released(run), "doc_id long, n_words int, n_tokens int")
