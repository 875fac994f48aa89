"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken 2003)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrays import BASE, BASE_INV, U64, byte_slices, mix, powers, sound, text_bytes
from .common import batch, id_text, list_array, released
from .pretoken import LETTER, NUMBER, classes, code_points

KGRAM, WINDOW = 40, 61


def fingerprints_of(points: np.ndarray, offsets: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position in the row, number of fingerprints of each row) of rows of code points.

    The position is the k-gram's first code point. A row of fewer than k points has none; one of fewer than
    w k-grams has the one minimum of all of them.
    """
    rows = len(offsets) - 1
    n = len(points)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((points.astype(U64) + U64(1)) * powers(BASE, n), out=prefix[1:])
    h = mix((prefix[k:] - prefix[:-k]) * powers(BASE_INV, n)[: n - k + 1])
    first, grams = offsets[:-1], np.maximum(np.diff(offsets) - k + 1, 0)
    # k-grams that lie in one row, packed; each window of w of them keeps its least, the rightmost of equals
    at = np.repeat(first - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
    h = h[at]
    start = np.cumsum(grams) - grams
    windows = np.where(grams > 0, np.maximum(grams - w + 1, 1), 0)
    m = len(h)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    best = np.arange(m)
    span = 1
    while span * 2 <= w:
        left, right = best[: m - span] if m > span else best[:0], best[span:]
        best = best.copy()
        best[: m - span] = np.where(h[right] <= h[left], right, left)
        span *= 2
    row = np.repeat(np.arange(rows), windows)
    begin = np.repeat(start - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    pick = np.empty(len(begin), np.int64)
    full = (grams >= w)[row]
    a, z = best[begin[full]], best[begin[full] + w - span]
    pick[full] = np.where(h[z] <= h[a], z, a)
    for r in np.flatnonzero((grams > 0) & (grams < w)):  # short rows: one window over all
        part = h[start[r] : start[r] + grams[r]]
        pick[np.searchsorted(row, r)] = start[r] + len(part) - 1 - int(np.argmin(part[::-1]))
    new = np.ones(len(pick), bool)
    new[1:] = pick[1:] != pick[:-1]
    pick, row = pick[new], row[new]
    return h[pick].view(np.int64), pick - start[row], np.bincount(row, minlength=rows)


def normalized(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and digits only, with each one's place in the text, and the rows' offsets."""
    kind = classes()[points]
    keep = np.flatnonzero((kind == LETTER) | (kind == NUMBER))
    return points[keep], keep, np.searchsorted(keep, offsets)


def fingerprints(docs: DataFrame, k: int = KGRAM, w: int = WINDOW) -> DataFrame:
    """doc_id, n_fingerprints, hashes, positions: the winnowed fingerprints of each text.

    The text is folded to lower case and only letters and digits count. Of each w consecutive k-grams the one of
    least hash is kept, the rightmost of equals; so any two texts that share w + k - 1 letters and digits in a row
    share a fingerprint, and none shorter than k can make one. positions are code points of the text itself at
    which the kept k-grams start. Texts of fewer than k letters and digits (empty ones too) have empty lists; a
    null text has nulls; an empty table gives an empty result. Texts of any length are taken whole; bytes that aren't
    UTF-8 count as U+FFFD. Rows are kept as they are, repeated and null ids included; extra columns are ignored, whatever
    their names.
    """
    if k < 1 or w < 1:
        raise ValueError("k and w are at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(pc.utf8_lower(sound(b.column("text"))))
            for lo, hi in byte_slices(off):
                points, _, rows = code_points(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                kept, place, rel = normalized(points, rows)
                h, at, count = fingerprints_of(kept, rel, k, w)
                owner = np.repeat(np.arange(hi - lo), count)
                where = place[rel[owner] + at] - rows[owner]
                gone = b.column("text").slice(lo, hi - lo).is_null()
                hashes, positions = list_array(h, count, pa.int64()), list_array(where.astype(np.int32), count, pa.int32())
                number = pa.array(count.astype(np.int32))
                if pc.any(gone).as_py():
                    keep = pc.invert(gone)
                    number, hashes, positions = (pc.if_else(keep, x, pa.nulls(hi - lo, x.type)) for x in (number, hashes, positions))
                yield batch(doc_id=b.column("doc_id").slice(lo, hi - lo), n_fingerprints=number, hashes=hashes, positions=positions)

    return id_text(docs).mapInArrow(released(run), "doc_id long, n_fingerprints int, hashes array<long>, positions array<int>")
