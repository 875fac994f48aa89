"""Hierarchical packing of documents into training windows of several context sizes.

A document goes to the smallest tier whose window holds it; one longer than the longest window gives full windows
of that size and a rest that is routed like a document. Each tier is packed by itself, longest piece first; the
gaps of longer windows are then filled from shorter tiers; what is left of a shorter tier makes its own windows.
Windows of a tier are dealt to step groups of equal token capacity, so that each has about the same work.

Only lengths are packed, and pieces are packed within buckets of a size that doesn't follow the corpus: a bucket's
last windows are all that is lost against packing everything at once.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import byte_slices, text_bytes
from .bpe import VOCABULARY, count_texts, load_vocabulary
from .common import batch, checkpoint, id_text, released

TIERS = (1024, 4096, 16384)
STEP_TOKENS = 131072
BUCKET_ROWS = 65536

PLACED = "doc_id long, piece int, start long, n_tokens int, tier int, window_id long, position int, step_group long"


@dataclass
class Lengths:
    """A multiset of pieces by length: the longest that fits in a gap, in O(log n)."""

    sizes: list[int]  # distinct, ascending
    rows: dict[int, list[int]]  # pieces of each size, the last first in line
    below: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.below = list(range(len(self.sizes)))

    def _live(self, i: int) -> int:
        """Greatest index <= i whose size still has pieces, -1 where none has; paths are halved."""
        while i >= 0:
            j = self.below[i]
            if j == i:
                return i
            if j >= 0:
                self.below[i] = self.below[j]
            i = j
        return -1

    def take(self, most: int) -> tuple[int, int] | None:
        """(piece, size) of the longest piece of at most this size."""
        i = self._live(bisect_right(self.sizes, most) - 1)
        if i < 0:
            return None
        size = self.sizes[i]
        piece = self.rows[size].pop()
        if not self.rows[size]:
            self.below[i] = i - 1
        return piece, size


def lengths_of(pieces: np.ndarray, size: np.ndarray) -> Lengths:
    """Pieces in the order given, of each size the first first."""
    order = np.lexsort((-pieces, size))
    cuts = np.flatnonzero(np.r_[True, np.diff(size[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
    rows = {int(size[order[a]]): pieces[order[a:z]].tolist() for a, z in zip(cuts[:-1], cuts[1:], strict=True)}
    return Lengths(sorted(rows), rows)


def plan(size: np.ndarray, tiers: tuple[int, ...]) -> list[tuple[int, list[int]]]:
    """Windows (tier, pieces in order) of pieces of these sizes, each at most the longest tier."""
    route = np.searchsorted(np.array(tiers), size)
    stock = [lengths_of(p := np.flatnonzero(route == k), size[p]) for k in range(len(tiers))]
    out: list[tuple[int, list[int]]] = []
    for k in range(len(tiers) - 1, -1, -1):
        own: list[tuple[int, list[int]]] = []
        while (got := stock[k].take(tiers[k])) is not None:
            inside, gap = [got[0]], tiers[k] - got[1]
            while gap > 0 and (got := stock[k].take(gap)) is not None:
                inside.append(got[0])
                gap -= got[1]
            own.append((gap, inside))
        for gap, inside in sorted(own, key=lambda w: (-w[0], w[1])):  # the widest gaps get the longest pieces
            for lower in range(k - 1, -1, -1):
                while gap > 0 and (got := stock[lower].take(gap)) is not None:
                    inside.append(got[0])
                    gap -= got[1]
            out.append((tiers[k], inside))
    return out


def balance(work: list[int], capacity: int) -> list[int]:
    """Group of each window: ceil(windows / capacity) groups of at most ``capacity`` windows and about equal work.

    The window of most work goes first, each to the group of least work that has room, the first of equals.
    """
    groups = -(-len(work) // capacity)
    heap = [(0, g, 0) for g in range(groups)]
    out = [0] * len(work)
    for i in sorted(range(len(work)), key=lambda i: (-work[i], i)):
        total, g, n = heapq.heappop(heap)
        out[i] = g
        if n + 1 < capacity:
            heapq.heappush(heap, (total + work[i], g, n + 1))
    return out


def place(ids: list[int | None], total: np.ndarray, bucket: int, tiers: tuple[int, ...], step_tokens: int) -> dict[str, list]:
    """The rows of PLACED for one bucket of documents of these token totals."""
    top = tiers[-1]
    order = np.lexsort((total, np.array([-(1 << 63) if i is None else i for i in ids], np.int64)))
    owner, piece, start, size = [], [], [], []
    for r in order.tolist():
        n = int(total[r])
        for p in range(-(-n // top)):
            owner.append(r)
            piece.append(p)
            start.append(p * top)
            size.append(min(top, n - p * top))
    sizes = np.array(size, np.int64)
    windows = plan(sizes, tiers)
    group = [0] * len(windows)
    seen = 0
    for t in tiers:
        mine = [w for w, (tier, _) in enumerate(windows) if tier == t]
        # attention grows with the square of a piece, the rest with its tokens
        work = [int((sizes[windows[w][1]] * (sizes[windows[w][1]] + t)).sum()) for w in mine]
        got = balance(work, max(1, step_tokens // t))
        for w, g in zip(mine, got, strict=True):
            group[w] = seen + g
        seen += max(got, default=-1) + 1
    out: dict[str, list] = {c.split()[0]: [] for c in PLACED.split(", ")}
    for w, (tier, inside) in enumerate(windows):
        position = 0
        for x in inside:
            for k, v in (("doc_id", ids[owner[x]]), ("piece", piece[x]), ("start", start[x]), ("n_tokens", size[x]), ("tier", tier), ("window_id", (bucket << 32) + w), ("position", position), ("step_group", (bucket << 32) + group[w])):
                out[k].append(v)
            position += size[x]
    return out


def measure(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = 1) -> DataFrame:
    """doc_id, n_tokens, salt of every document with at least one token; ``separator`` ids follow each document."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b.column("text"))
            for lo, hi in byte_slices(off):
                n = count_texts(shared.value, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                some = pa.array(n > 0)
                part = b.slice(lo, hi - lo).filter(some)
                yield batch(doc_id=part.column("doc_id"), n_tokens=pa.array(n[n > 0] + separator), salt=part.column("salt"))

    slim = id_text(docs).where("text is not null").select("doc_id", "text", F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))).alias("salt"))
    return slim.mapInArrow(released(run), "doc_id long, n_tokens long, salt long")


def pack_lengths(lengths: DataFrame, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Packs rows of (doc_id, n_tokens, salt): see ``pack``."""
    if not tiers or list(tiers) != sorted(set(tiers)) or tiers[0] < 1 or step_tokens < tiers[-1]:
        raise ValueError("tiers ascend, and a step holds a longest window at least")
    kept = checkpoint(lengths)
    buckets = max(1, -(-kept.count() // bucket_rows))

    def run(t: pa.Table) -> pa.Table:
        rows = place(t.column("doc_id").to_pylist(), t.column("n_tokens").to_numpy(), t.column("bucket")[0].as_py(), tiers, step_tokens)
        kinds = {"int": pa.int32(), "long": pa.int64()}
        return pa.table({name: pa.array(rows[name], kinds[kind]) for name, kind in map(str.split, PLACED.split(", "))})

    return kept.select("doc_id", "n_tokens", F.pmod("salt", F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInArrow(released(run), PLACED)


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, bucket_rows: int = BUCKET_ROWS, vocabulary: str = VOCABULARY, separator: int = 1) -> DataFrame:
    """doc_id, piece, start, n_tokens, tier, window_id, position, step_group: where each piece of each document lies.

    A document's n_tokens are its byte-level BPE tokens and ``separator`` more at its end. It has one piece unless
    it is longer than the last tier; ``start`` is the piece's first token in the document, ``position`` in its
    window. No token is lost and none is placed twice; a window never holds more than its tier. A step group has
    windows of one tier, step_tokens // tier at most. Null and empty texts have no tokens and no row. Repeated ids
    are documents of their own, null ids too; extra columns are ignored, whatever their names; an empty table gives an
    empty result. Texts of any length are counted whole; bytes that aren't UTF-8 count as U+FFFD. Equal lengths are placed
    in order of id.
    """
    return pack_lengths(measure(docs, vocabulary, separator), tiers, step_tokens, bucket_rows)
