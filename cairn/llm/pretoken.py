"""Pre-token spans over whole slices of text, without a loop over tokens.

The rule is that of the widely published byte-level BPE pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

whose tokens tile a text, so that they are given by their starts, which follow from classes of characters.
"""

from __future__ import annotations

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point; built once a worker."""
    global _CLASSES
    if _CLASSES is None:
        import regex

        points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
        every = points.tobytes().decode("utf-32-le")
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[points[m.start() : m.end()]] = kind
        _CLASSES = table
    return _CLASSES


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, the byte at which each starts (and the end), and the rows' offsets in code points."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    return points, np.r_[lead, len(data)], np.searchsorted(lead, offsets)


def starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens start, in code points."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    begin[n] = True
    run = begin[:n].copy()
    run[0] = True
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    blank = points == 0x20
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~begin[:n]
    # a run starts a token unless a blank before it does; the last white space before another class stands apart
    start = run & (space | ~after_blank)
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~begin[1:n]
    start |= last
    quote = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & run[:-1] & run[1:] & (kind[1:] == LETTER) & ~begin[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        padded = np.r_[points, 0, 0]
        inside = np.r_[kind, 0, 0]
        edge = np.r_[begin[:n], True, True]
        a, b = padded[quote + 1], padded[quote + 2]
        two = (inside[quote + 2] == LETTER) & ~edge[quote + 2]
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = two & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for hit, size in ((quote[short], 2), (quote[long & ~short], 3)):
            start[hit + 1] = False
            end = hit + size
            end = end[end < n]
            start[end] = True
    return np.flatnonzero(start)
