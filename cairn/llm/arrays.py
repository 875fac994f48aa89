"""Numpy views of Arrow text columns: byte offsets, word spans, rolling hashes.

Everything works on bounded slices of a batch (``byte_slices``), so that memory follows the slice and not
the batch or the corpus; one document is never split, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
SLICE_BYTES = 1 << 20

_POW: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** arange(n)`` modulo 2**64; the longest array asked for is kept in the worker."""
    kept = _POW.get(int(base))
    if kept is None or len(kept) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        kept = np.multiply.accumulate(steps)
        if size > 8 * SLICE_BYTES:
            return kept[:n]
        _POW[int(base)] = kept
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of MurmurHash3: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def sound(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as large strings of valid UTF-8: what isn't part of a character becomes U+FFFD; nulls stay."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        raw = column.cast(pa.large_binary())
        column = pa.array([None if not x.is_valid else x.as_py().decode("utf-8", "replace") for x in raw], pa.large_string())
    return column


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column, made ``sound``; a null counts as an empty text."""
    column = sound(column)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def byte_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def _word_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[ord("0") : ord("9") + 1] = table[ord("a") : ord("z") + 1] = table[ord("A") : ord("Z") + 1] = True
    table[128:] = True
    return table


WORD_BYTE = _word_table()
UNSPACED_BYTE = ~np.isin(np.arange(256), list(b" \t\n\r\f\v"))


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, none of which crosses an offset."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flags[:-1]
    start = flags & (~before | cut[:n])
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flags[1:]
    end = flags & (~after | cut[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, by prefix sums of a polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = powers(BASE, len(data)), powers(BASE_INV, len(data))
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (ASCII letters and digits, any byte over 127; or of the bytes of ``table``), and each row's first word."""
    starts, ends = runs(table[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int, table: np.ndarray = WORD_BYTE) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of word n-grams.

    A row of 1 to n - 1 words has one gram of all its words; a row without words has none.
    """
    starts, ends, first = words(data, offsets, table)
    h = span_hash(data, starts, ends)
    grams = chain(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(chain(h[a:b], b - a)[:1])
        else:
            out.append(np.zeros(0, U64))
    return out


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = h[:m].copy()
    for k in range(1, n):
        total *= BASE
        total += h[k : k + m]
    return mix(total + U64(n))
