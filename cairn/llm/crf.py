"""Quality rules by line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

Each non-blank line has a vector of features; the chain scores labels and their changes from line to line, and
Viterbi decoding gives the best labels. The share of characters in content lines decides whether a document stays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import WORD_BYTE, byte_slices, runs, span_hash, text_bytes
from .common import batch, filter_rows, id_text, released

CONTENT, BOILERPLATE = 1, 0
MIN_SHARE = 0.5
SAMPLE_ROWS = 4000
WINDOW_LINES, WINDOWS = 32, 16
MIXED = 0.5
FEATURES = ("bias", "letters", "upper", "digits", "symbols", "bars", "words", "long_words", "word_size", "repeated", "marked_words", "stops", "short", "mostly_upper", "mostly_marked", "mostly_bars", "mostly_repeated", "few_letters")


def _table(*chars: str) -> np.ndarray:
    t = np.zeros(256, np.int64)
    for c in "".join(chars).encode():
        t[c] = 1
    return t


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _table("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _table("0123456789")
_BAR = _table("|\t<>{}[]\\")
_STOP = _table(".,;:?'\"()-")
_BLANK = _table(" \t\r\v\f")
_SYMBOL = np.where((np.arange(256) < 128) & (np.arange(256) > 32) & ~WORD_BYTE, 1, 0) - _STOP


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines that aren't blank, and each row's first of them."""
    start, end = runs(data != 10, offsets)
    solid = np.r_[0, np.cumsum((_BLANK[data] == 0) & (data != 10))]
    some = solid[end] > solid[start]
    start, end = start[some], end[some]
    return start, end, np.searchsorted(start, offsets)


def line_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each line: shares in [0, 1] but for the bias."""
    n = len(start)
    if not n:
        return np.zeros((0, len(FEATURES)))
    size = (end - start).astype(np.float64)

    def total(table: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(table[data])]
        return (c[end] - c[start]).astype(np.float64)

    upper, lower, digit, symbol, bar, stop = (total(t) for t in (_UPPER, _LOWER, _DIGIT, _SYMBOL, _BAR, _STOP))
    high = total((np.arange(256) >= 0xC0).astype(np.int64))
    letters = upper + lower + high
    solid = size - total(_BLANK)
    ws, we = runs(_BLANK[data] + (data == 10) == 0, np.zeros(0, np.int64))
    first = np.searchsorted(ws, np.r_[start, len(data) + 1])
    # words lie inside lines: a line's words are those that start in it
    last = np.searchsorted(ws, end)
    n_words = (last - first[:-1]).astype(np.float64)
    h = span_hash(data, ws, we)
    same = np.zeros(len(ws) + 1, np.int64)
    same[1 : len(ws)] = h[1:] == h[:-1]
    c = np.r_[0, np.cumsum(same[: len(ws)])]
    repeated = c[last] - c[np.minimum(first[:-1] + 1, last)]
    ending = _SYMBOL[data[we - 1]] if len(we) else np.zeros(0, np.int64)
    c = np.r_[0, np.cumsum(ending)]
    marked = c[last] - c[first[:-1]]
    c = np.r_[0, np.cumsum(we - ws > 20)]
    long = c[last] - c[first[:-1]]
    some, solid = np.maximum(n_words, 1), np.maximum(solid, 1)
    up, bars, again, mark = upper / np.maximum(letters, 1), np.minimum(bar / some, 1), repeated / np.maximum(n_words - 1, 1), marked / some
    return np.stack(
        [
            np.ones(n), letters / solid, up, digit / solid, np.minimum(symbol / solid * 4, 1), bars,
            np.minimum(n_words / 40, 1), long / some, np.minimum(solid / some / 20, 1), again, mark,
            np.minimum(stop / some, 1), n_words < 4, up > 0.6, mark > 0.4, bars > 0.3, again > 0.3, letters / solid < 0.5,
        ],
        axis=1,
    ).astype(np.float64)


@dataclass
class Model:
    emit: np.ndarray  # features x 2
    change: np.ndarray  # from x to

    def decode(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best label of each line; row r has the lines first[r]:first[r + 1]. Equal scores give boilerplate."""
        score = x @ self.emit
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        size = n[order]
        out = np.zeros(len(x), np.int64)
        most = int(size[0]) if len(size) else 0
        if not most:
            return out
        live = np.searchsorted(-size, -np.arange(1, most + 1), side="right")  # rows with over t lines
        back = []
        best = score[first[order[: live[0]]]].copy()
        for t in range(1, most):
            k = live[t]
            way = best[:k, :, None] + self.change[None]
            frm = way.argmax(axis=1)
            best[:k] = np.take_along_axis(way, frm[:, None, :], axis=1)[:, 0] + score[first[order[:k]] + t]
            back.append(frm.astype(np.int8))
        label = best.argmax(axis=1)
        for t in range(most - 1, -1, -1):
            k = live[t]
            if t < most - 1:
                m = live[t + 1]
                label[:m] = back[t][np.arange(m), label[:m]]
            out[first[order[:k]] + t] = label[:k]
        return out


def _step(a: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Log-sums over the label before of a chain's scores, for each label."""
    return np.stack([np.logaddexp(a[:, 0] + change[0, k], a[:, 1] + change[1, k]) for k in (0, 1)], axis=1)


def likelihood(emit: np.ndarray, change: np.ndarray, x: np.ndarray, y: np.ndarray, real: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log-likelihood of padded label sequences and its gradient, by forward and backward sums."""
    b, t, f = x.shape
    weight = np.ones(b) if weight is None else weight
    s = x @ emit
    fwd, bwd = np.zeros((t, b, 2)), np.zeros((t, b, 2))
    fwd[0] = s[:, 0]
    for i in range(1, t):
        fwd[i] = np.where(real[:, i, None], _step(fwd[i - 1], change) + s[:, i], fwd[i - 1])
    z = np.logaddexp(fwd[-1][:, 0], fwd[-1][:, 1])
    for i in range(t - 2, -1, -1):
        bwd[i] = np.where(real[:, i + 1, None], _step(s[:, i + 1] + bwd[i + 1], change.T), 0)
    fwd, bwd = fwd.transpose(1, 0, 2), bwd.transpose(1, 0, 2)
    on = real * weight[:, None]
    p = np.exp(fwd + bwd - z[:, None, None]) * on[:, :, None]
    gold = np.eye(2)[y] * on[:, :, None]
    g_emit = x.reshape(-1, f).T @ (gold - p).reshape(-1, 2)
    after = s[:, 1:] + bwd[:, 1:] - z[:, None, None]
    g_change, both = np.zeros((2, 2)), np.zeros((2, 2))
    for j in (0, 1):
        for k in (0, 1):
            both[j, k] = (on[:, 1:] * ((y[:, :-1] == j) & (y[:, 1:] == k))).sum()
            g_change[j, k] = both[j, k] - (on[:, 1:] * np.exp(fwd[:, :-1, j] + change[j, k] + after[:, :, k])).sum()
    ll = float((gold * s).sum() + (both * change).sum() - (weight * z).sum())
    return ll, g_emit, g_change


def fit(pure: list[tuple[np.ndarray, np.ndarray]], both: list[tuple[np.ndarray, np.ndarray]] | None = None, mixed_share: float = MIXED, part_of: list[int] | None = None, rounds: int = 120, ridge: float = 1e-5, rate: float = 0.3) -> Model:
    """Maximum likelihood by Adam on whole batches of padded sequences.

    Of the sequences of one label each weighs the inverse of its length, those of one document (in so many parts, by
    ``part_of``) weigh as much as one, and those of content weigh as much in all as the others: long documents and
    the commoner kind don't drown the rest. Sequences of ``both`` labels have ``mixed_share`` of all the weight.
    """
    k = len(FEATURES)
    parts = [n for n, (x, _) in zip(part_of or [1] * len(pure), pure, strict=True) if len(x)]
    pure, both = [(x, y) for x, y in pure if len(x)], [(x, y) for x, y in both or [] if len(x)]
    emit, change = np.zeros((k, 2)), np.zeros((2, 2))
    if len({int(v) for _, y in pure + both for v in np.unique(y)}) < 2:
        emit[0, CONTENT] = 1.0  # nothing to tell apart: all is content
        return Model(emit, change)
    kinds = np.bincount([int(y[0]) for _, y in pure], weights=[1 / n for n in parts], minlength=2)
    share = mixed_share if both else 0.0
    sequences = [(x, y, (1 - share) / len(x) / n / kinds[y[0]]) for (x, y), n in zip(pure, parts, strict=True)] + [(x, y, 2 * share / len(x) / len(both)) for x, y in both]
    sequences.sort(key=lambda s: len(s[0]))
    groups, a = [], 0
    while a < len(sequences):
        z = a + 1
        while z < len(sequences) and len(sequences[z][0]) <= 1.5 * len(sequences[a][0]) + 2:
            z += 1
        part = sequences[a:z]
        t = max(len(x) for x, *_ in part)
        x, y, real = np.zeros((len(part), t, k)), np.zeros((len(part), t), np.int64), np.zeros((len(part), t), bool)
        weight = np.array([w for *_, w in part])
        for i, (f, lab, _) in enumerate(part):
            x[i, : len(f)], y[i, : len(f)], real[i, : len(f)] = f, lab, True
        groups.append((x, y, real, weight))
        a = z
    theta = [emit, change]
    m, v = [np.zeros_like(w) for w in theta], [np.zeros_like(w) for w in theta]
    for step in range(1, rounds + 1):
        grad = [-ridge * w for w in theta]
        for group in groups:
            _, ge, gc = likelihood(*theta, *group)
            grad = [grad[0] + ge, grad[1] + gc]
        for i, g in enumerate(grad):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            theta[i] = theta[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Model(*theta)


def windows_of(lines: int, window_lines: int, windows: int) -> list[tuple[int, int]]:
    """Runs of lines that teach: all of them in runs of ``window_lines``, or ``windows`` such runs spread over the whole text."""
    starts = list(range(0, lines, window_lines))
    if len(starts) > windows:
        starts = [starts[round(k * (len(starts) - 1) / max(1, windows - 1))] for k in range(windows)]
    return [(a, min(lines, a + window_lines)) for a in starts]


def mixed(good: list[np.ndarray], bad: list[np.ndarray], seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences of lines of two documents, one of each kind, in which the kind changes twice.

    Content between boilerplate above and below it, and boilerplate amid content, by turns. Each line keeps the label
    of the document that it comes from, so that these sequences teach how labels follow each other. The shorter list
    is gone through again until the longer one is used up.
    """
    if not good or not bad:
        return []
    r = np.random.default_rng(seed)
    out = []
    for k in range(max(len(good), len(bad))):
        inner, outer = good[k % len(good)], bad[k % len(bad)]
        label = CONTENT
        if k % 2:
            inner, outer, label = outer, inner, BOILERPLATE
        cut = int(r.integers(0, len(outer) + 1))
        y = np.full(len(inner) + len(outer), CONTENT + BOILERPLATE - label)
        y[cut : cut + len(inner)] = label
        out.append((np.concatenate([outer[:cut], inner, outer[cut:]]), y))
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, window_lines: int = WINDOW_LINES, windows: int = WINDOWS, mixed_share: float = MIXED) -> Model:
    """Fits the model on at most ``sample_rows`` labelled documents, chosen by a hash of their id.

    Documents of any length teach: by all their lines in runs of ``window_lines``, or, where those are more than
    ``windows``, by that many runs spread over the whole text. These bounds are the parameters. The labels say what a
    document is, not a line: a document's lines carry its label, and ``mixed`` joins lines of documents of both kinds,
    with ``mixed_share`` of the weight, which teaches the changes that no document by itself can. Rows without id,
    text or label teach nothing; of several labels of an id the lower one holds.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    some = some.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample_rows)
    picked = {r["doc_id"]: r["quality"] for r in some.collect()}
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in sorted(picked)], "doc_id long"))  # sample_rows ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b.column("text"))
            for lo, hi in byte_slices(off):
                part = data[off[lo] : off[hi]]
                start, end, first = lines(part, off[lo : hi + 1] - off[lo])
                features = line_features(part, start, end).astype(np.float32)
                for r, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), lo):
                    spans = windows_of(z - a, window_lines, windows)
                    rows = [features[a + x : a + y].tobytes() for x, y in spans]
                    if rows:
                        yield batch(doc_id=pa.array([b.column("doc_id")[r].as_py()] * len(rows), pa.int64()), at=pa.array([x for x, _ in spans], pa.int64()), x=pa.array(rows, pa.binary()))

    got = id_text(docs).where("text is not null").join(wanted, "doc_id", "left_semi").mapInArrow(released(run), "doc_id long, at long, x binary").collect()
    kinds: dict[int, list[np.ndarray]] = {CONTENT: [], BOILERPLATE: []}
    pure, owner = [], []
    for r in sorted(got, key=lambda r: (r["doc_id"], r["at"], r["x"])):
        x = np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)).astype(np.float64)
        kind = CONTENT if picked[r["doc_id"]] else BOILERPLATE
        kinds[kind].append(x)
        pure.append((x, np.full(len(x), kind)))
        owner.append(r["doc_id"])
    times = Counter(owner)
    return fit(pure, mixed(kinds[CONTENT], kinds[BOILERPLATE]), mixed_share, [times[i] for i in owner])


def _labeller(shared, min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for b in batches:
            data, off = text_bytes(b.column("text"))
            for lo, hi in byte_slices(off):
                start, end, first = lines(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                label = model.decode(line_features(data[off[lo] : off[hi]], start, end), first)
                size = (end - start) * 1.0
                c = np.r_[0, np.cumsum(size)]
                every = c[first[1:]] - c[first[:-1]]
                c = np.r_[0, np.cumsum(np.where(label == CONTENT, size, 0))]
                good = c[first[1:]] - c[first[:-1]]
                c = np.r_[0, np.cumsum(label == CONTENT)]
                share = np.where(every > 0, good / np.maximum(every, 1), 0.0)
                yield batch(
                    **{k: b.column(k).slice(lo, hi - lo) for k in b.schema.names if k != "text"},
                    n_lines=pa.array(np.diff(first).astype(np.int32)),
                    content_lines=pa.array((c[first[1:]] - c[first[:-1]]).astype(np.int32)),
                    content_share=pa.array(np.round(share, 6)),
                    accepted=pa.array((every > 0) & (share >= min_share)),
                )

    return run


def assess(docs: DataFrame, labels: DataFrame, model: Model | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, n_lines, content_lines, content_share, accepted for every document.

    Blank lines don't count. content_share is that of the UTF-8 bytes in content lines. A text without lines (null,
    empty, blank) has share 0 and isn't accepted. Texts of any length are labelled whole, as one sequence. Of labellings of
    equal score the one with boilerplate wins, from the last line back; a share of just ``min_share`` is accepted. Rows are
    kept as they are, repeated and null ids included; extra columns are ignored, whatever their names; an empty table
    gives an empty result. Bytes that aren't UTF-8 count as U+FFFD. Without labels of both kinds every line is content.
    """
    model = train(docs, labels) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return id_text(docs).mapInArrow(released(_labeller(shared, min_share)), "doc_id long, n_lines int, content_lines int, content_share double, accepted boolean")


def keep_content(docs: DataFrame, labels: DataFrame, model: Model | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows that ``assess`` accepts, with all their columns, whatever their names; those of null and empty texts go.

    Decided row by row: repeated and null ids don't matter, and an empty table stays empty.
    """
    model = train(docs, labels) if model is None else model
    return filter_rows(docs, "text", _labeller(docs.sparkSession.sparkContext.broadcast(model), min_share))
