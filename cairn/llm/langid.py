"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, byte_slices, mix, sound, text_bytes
from .common import batch, filter_rows, id_text, released
from .pretoken import LETTER, classes, code_points

BITS = 15
ORDERS = (2, 3)
SMOOTHING = 0.5
SAMPLE_ROWS = 4000
LANGUAGES_AT_ONCE = 64
MIN_CONFIDENCE = 0.5


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order, the hashed n-gram that starts at each place (1 << BITS where none does); the places' row offsets.

    The text is in lower case, every run of other characters than letters is one blank, and a row begins and ends
    with a blank, so that n-grams see the ends of words.
    """
    points, _, rows = code_points(data, offsets)
    letter = classes()[points] == LETTER
    begin = np.zeros(len(points) + 1, bool)
    begin[rows] = True
    # a non-letter stays only as the first of its run; a row's first letter gets a blank before it, and its end one
    blank = ~letter
    again = np.zeros(len(points), bool)
    again[1:] = blank[1:] & blank[:-1] & ~begin[1 : len(points)]
    kept = np.flatnonzero(~again)
    seq = np.where(letter[kept], points[kept], 32).astype(np.uint32)
    at = np.searchsorted(kept, rows)
    n = len(offsets) - 1
    size = np.diff(at)
    new_at = np.r_[0, np.cumsum(size + 2)]
    out = np.full(int(new_at[-1]), 32, np.uint32)
    out[np.arange(len(seq)) + np.repeat(2 * np.arange(n) + 1, size)] = seq
    grams = []
    row_end = np.repeat(new_at[1:], size + 2)
    place = np.arange(len(out))
    wide = out.astype(U64)
    for k in ORDERS:
        m = max(len(out) - k + 1, 0)
        h, some = np.full(m, k, U64), np.zeros(m, bool)
        for j in range(k):
            h = (h << U64(21)) ^ (h >> U64(43)) ^ wide[j : j + m]
            some |= out[j : j + m] != 32
        some &= place[:m] + k <= row_end[:m]
        code = np.full(len(out), 1 << BITS, np.int32)
        code[:m][some] = (mix(h[some]) >> U64(64 - BITS)).astype(np.int32)
        grams.append(code)
    return grams, new_at, n


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (1 << BITS) + 1 rows, the last of zeros, by language
    prior: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-posteriors up to a constant, by row and language, and how many n-grams each row has."""
        grams, at, n = features(data, offsets)
        total, count = np.tile(self.prior, (n, 1)), np.zeros(n, np.int64)
        for code in grams:  # every row has two places at least: no empty sum
            if n == 1:  # a long text comes by itself: each n-gram's log-probability is taken once, times its count
                total[0] += np.bincount(code, minlength=(1 << BITS) + 1).astype(np.float64) @ self.log_p
                count += int((code != 1 << BITS).sum())
                continue
            for a in range(0, len(self.prior) if n else 0, LANGUAGES_AT_ONCE):
                part = slice(a, a + LANGUAGES_AT_ONCE)
                total[:, part] += np.add.reduceat(self.log_p[:, part][code], at[:-1], axis=0, dtype=np.float64)
            count += np.add.reduceat(code != 1 << BITS, at[:-1], dtype=np.int64) if n else 0
        return total, count


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def counted() -> pa.RecordBatch:
        out = batch(lang=pa.array(list(total), pa.string()), counts=pa.array([t.tobytes() for t in total.values()], pa.binary()))
        total.clear()
        return out

    for b in batches:
        data, off = text_bytes(pc.utf8_lower(sound(b.column("text"))))
        lang = b.column("lang").to_pylist()
        for lo, hi in byte_slices(off):
            grams, at, _ = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            for i in range(hi - lo):
                if lang[lo + i] not in total and len(total) == LANGUAGES_AT_ONCE:
                    yield counted()
                t = total.setdefault(lang[lo + i], np.zeros((1 << BITS) + 1, np.int64))
                for code in grams:
                    t += np.bincount(code[at[i] : at[i + 1]], minlength=(1 << BITS) + 1)
    yield counted()


def _add(t: pa.Table) -> pa.Table:
    total = np.zeros((1 << BITS) + 1, np.int64)
    for c in t.column("counts"):
        total += np.frombuffer(c.as_py(), np.int64)
    return pa.table({"lang": t.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits the model on about ``sample_rows`` labelled documents of each language, whole texts, chosen by a hash of their id.

    The bound is this parameter; a language of fewer documents teaches all of them, and every label of the table has a
    model. A language's prior is its share of all labelled documents. The counts are made by the executors. Rows
    without a label, a text or an id teach nothing.
    """
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and text is not null and doc_id is not null")
    drawn = named.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)))
    rows = {r["lang"]: r for r in drawn.groupBy("lang").agg(F.count("*").alias("docs"), F.min("draw").alias("least")).collect()}
    if not rows:
        return Model([], np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros(0))
    # the least draw is always in: repeated ids can't leave a language without a row
    below = [(k, max(int(min(1.0, sample_rows / r["docs"]) * (1 << 30)), r["least"] + 1)) for k, r in rows.items()]
    sample = drawn.join(F.broadcast(docs.sparkSession.createDataFrame(below, "lang string, below long")), "lang").where("draw < below")
    got = {r["lang"]: r["counts"] for r in sample.select("lang", "text").mapInArrow(released(_count), "lang string, counts binary").groupBy("lang").applyInArrow(_add, "lang string, counts binary").toLocalIterator()}
    names = sorted(got)
    log_p = np.zeros(((1 << BITS) + 1, len(names)), np.float32)
    for i, k in enumerate(names):
        counts = np.frombuffer(got[k], np.int64)[:-1]
        log_p[:-1, i] = np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * (1 << BITS)))
    n = np.array([rows[k]["docs"] for k in names], np.float64)
    return Model(names, log_p, np.log(n / n.sum()))


def _scorer(shared, min_confidence: float, wanted: tuple[str, ...] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = np.array(model.languages, object)
        ok = np.array([wanted is None or x in wanted for x in model.languages], bool)
        for b in batches:
            data, off = text_bytes(pc.utf8_lower(sound(b.column("text"))))
            for lo, hi in byte_slices(off):
                n = hi - lo
                if len(names):
                    s, count = model.scores(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    top = s.argmax(axis=1)
                    conf = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                    fits = (s.max(axis=1) - model.prior[top]) > -BITS * np.log(2) * count
                else:
                    top, conf, count, fits = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
                none = (count == 0) | (not len(names))
                accepted = ~none & fits & (conf >= min_confidence) & (ok[top] if len(names) else False)
                language = pa.array(names[top] if len(names) else [None] * n, pa.string(), mask=none)
                yield batch(**{k: b.column(k).slice(lo, n) for k in b.schema.names if k != "text"}, language=language, confidence=pa.array(np.where(none, 0.0, np.round(conf, 6))), n_grams=pa.array(count), accepted=pa.array(accepted))

    return run


def identify(docs: DataFrame, model: Model | None = None, min_confidence: float = MIN_CONFIDENCE, wanted: tuple[str, ...] | None = None, lang_col: str = "lang") -> DataFrame:
    """doc_id, language, confidence, n_grams, accepted for every document.

    Without a model, one is trained on the table's own labels. confidence is the posterior of the best language.
    A text without letters (null, empty) has a null language, confidence 0, and isn't accepted; nor is one under
    ``min_confidence``, nor one of a language that isn't ``wanted``, nor one whose n-grams the best language makes
    no likelier than uniform ones (a language that the model doesn't know). Of equal scores the language first in
    alphabetical order wins. Without any labelled text no document is accepted. Texts of any length are scored whole;
    bytes that aren't UTF-8 count as U+FFFD. Rows are kept as they are, repeated and null ids included; extra columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    model = train(docs, lang_col) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return id_text(docs).mapInArrow(released(_scorer(shared, min_confidence, wanted)), "doc_id long, language string, confidence double, n_grams long, accepted boolean")


def keep_identified(docs: DataFrame, model: Model | None = None, min_confidence: float = MIN_CONFIDENCE, wanted: tuple[str, ...] | None = None, lang_col: str = "lang") -> DataFrame:
    """The rows that ``identify`` accepts, with all their columns, whatever their names; those of null and empty texts go.

    Decided on the row itself, without a join: repeated and null ids don't matter, and an empty table stays empty.
    """
    model = train(docs, lang_col) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    score = _scorer(shared, min_confidence, wanted)
    return filter_rows(docs, "text", score)
