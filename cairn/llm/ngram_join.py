"""Exact similarity join of documents under the Jaccard distance of their word n-gram sets.

1 - Jaccard is a metric: pivots split the documents into Voronoi regions, and the triangle inequality bounds which
documents outside a region can have a partner in it. Between unrelated texts nearly all distances are 1, where no
bound tells anything, so that pivots must be near what they attract. The steps:

1. ``profile``: every set's key and size in one pass, and the grams that a good share of all documents hold.
2. Grams meet by hash and learn how many sets hold them (``_counted``), and go back to their documents (``_fronts``).
   A document's grams are ordered rarest first. Two sets with similarity >= t have at least g common grams within
   their first n - ceil(t n) + k grams (prefix filter), with g from either's size. Grams of one document alone come
   first and are never sent again: most documents have nothing else in front and are done.
3. Pivots. The sets that share a gram in front attract each other: the least key among them is their pivot (``_lists``).
4. Regions. A set belongs to the regions of its pivots, with a weight: how many of its front grams lead there. Its
   nearest pivot is its home, the others make it a boundary document of their regions. Regions whose weights sum up
   to less than half of g are left, the weakest first: two sets that both do so still meet in one. A set whose
   weights sum up to less than g has no partner. All this is linear in the number of memberships; no pair is made.
5. Full sets travel to their regions. A region over CELL_GRAMS grams or CELL_SETS sets is cut into blocks that meet two by two.
6. ``metric_join`` joins a region exactly and recursively: pivots far apart, Voronoi cells of what is near them,
   windows by the triangle inequality for what must be looked at from outside, the remote rest with new pivots.
   A pair that meets in several regions counts in the least they have in common.

Equal sets are one node throughout, so copies cost no comparison. Grams are 64-bit hashes, keys of sets 128-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import U64, UNSPACED_BYTE, WORD_BYTE, byte_slices, mix, ngram_sets, sound, text_bytes
from .common import batch, checkpoint, id_text, released, shuffle_partitions
from .components import connected

NGRAM, THRESHOLD = 3, 0.5
LEAF = 64
PIVOTS = 16
CELL_GRAMS, CELL_SETS = 1 << 20, 4096
HOT_LIST, HOT_SHARE = 1 << 14, 0.005
FLUSH_GRAMS = 1 << 20
MARK_BITS = (16, 27)
WIDE = 5  # bytes of a gram on its way to be counted; with its bucket they name it


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit keys of sorted non-empty sets, as an (m, 2) array."""
    size = np.array([len(s) for s in sets], np.int64)
    if not len(size):
        return np.zeros((0, 2), U64)
    flat, at = np.concatenate(sets), np.cumsum(size) - size
    one, two = (np.add.reduceat(mix(flat ^ U64(c)), at) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    n = size.astype(U64)
    return np.stack([mix(one + n), mix(two ^ (n * U64(0x9E3779B97F4A7C15)))], axis=1)


def key_bytes(keys: np.ndarray) -> pa.Array:
    """Keys as 16 bytes each, in the order of their numbers."""
    raw = keys.astype(">u8").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(0, 16 * len(keys) + 1, 16, dtype=np.int32)), pa.py_buffer(raw)])


def prefix_common(n: np.ndarray | int) -> np.ndarray | int:
    """k of the prefix filter, by set size: larger sets must show more common rare grams."""
    return 3 + n // 16


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    return np.minimum(n, n - np.ceil(t * n - 1e-9).astype(np.int64) + prefix_common(n))


def needed(n: np.ndarray, t: float) -> np.ndarray:
    """g: common front grams that a set of n grams has at least with each set of similarity >= t.

    One less than the prefix filter gives: two grams of a document may have one name on their way.
    """
    least = np.ceil(t * n - 1e-9).astype(np.int64)  # of a partner's grams, and of common ones
    return np.maximum(np.minimum(prefix_common(least), least) - 1, 1)


def _slices(b: pa.RecordBatch, n: int, spaced: bool) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, gram sets of the rows from there) of bounded slices."""
    text = sound(b.column("text"))
    data, off = text_bytes(text if spaced else pc.utf8_lower(text))
    for lo, hi in byte_slices(off):
        yield lo, ngram_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n, UNSPACED_BYTE if spaced else WORD_BYTE)


def _profiler(n: int, spaced: bool, share: float = HOT_SHARE):
    """Rows (doc_id, version, node, n) of documents, and (gram, times, docs) of the task's frequent grams (lossy counting)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, times, docs = np.zeros(0, U64), np.zeros(0, np.int64), 0
        for b in batches:
            for lo, sets in _slices(b, n, spaced):
                some = np.flatnonzero([len(s) for s in sets])
                sets = [sets[i] for i in some.tolist()]
                if not sets:
                    continue
                docs += len(sets)
                g, c = np.unique(np.concatenate(sets), return_counts=True)
                often = c > max(1, share / 2 * len(sets))
                grams, at = np.unique(np.r_[grams, g[often]], return_inverse=True)
                times = np.bincount(at, weights=np.r_[times, c[often]], minlength=len(grams)).astype(np.int64)
                keep = times >= share / 2 * docs
                grams, times = grams[keep], times[keep]
                at = pa.array(lo + some)
                m = len(sets)
                yield batch(doc_id=b.column("doc_id").take(at), version=b.column("version").take(at), node=key_bytes(set_keys(sets)), n=pa.array([len(s) for s in sets], pa.int32()), gram=pa.nulls(m, pa.int64()), times=pa.nulls(m, pa.int64()))
        if m := len(grams):
            yield batch(doc_id=pa.nulls(m, pa.int64()), version=pa.nulls(m, pa.int64()), node=pa.nulls(m, pa.binary()), n=pa.nulls(m, pa.int32()), gram=pa.array(grams.view(np.int64)), times=pa.array(times))

    return released(run)


SPREAD = "bucket int, flush long, source int, ords binary, grams binary, classes binary, keys binary, sizes binary"


def _spread_row(**columns) -> pa.RecordBatch:
    m = len(columns["bucket"])
    kinds = {"bucket": pa.int32(), "flush": pa.int64(), "source": pa.int32()}
    return batch(**{k: columns.get(k, pa.nulls(m, kinds.get(k, pa.binary()))) for k in (c.split()[0] for c in SPREAD.split(", "))})


def _spreader(n: int, spaced: bool, buckets: int, hot_grams: np.ndarray, hot_times: np.ndarray):
    """All grams of all sets by bucket, with their document's number in its flush; a set that comes again in the task is left out.

    The table of a flush (the documents' keys and sizes) and its hot grams, whose counts are known, travel with it.
    """

    def flush(name: int, keys: np.ndarray, sizes: np.ndarray, grams: np.ndarray) -> Iterator[pa.RecordBatch]:
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
        home = int(mix(np.array([name], U64))[0] % U64(buckets))
        ids = gram_ids(grams, buckets)
        hot_at = np.minimum(np.searchsorted(hot_grams, grams), max(0, len(hot_grams) - 1))
        hot = hot_grams[hot_at] == grams if len(hot_grams) else np.zeros(len(grams), bool)
        yield _spread_row(bucket=pa.array([home], pa.int32()), flush=pa.array([name], pa.int64()), keys=pa.array([keys.tobytes()], pa.binary()), sizes=pa.array([sizes.astype(np.int32).tobytes()], pa.binary()))
        if hot.any():
            yield _spread_row(
                bucket=pa.array([home], pa.int32()), flush=pa.array([name], pa.int64()), source=pa.array([-1], pa.int32()), ords=pa.array([owner[hot].tobytes()], pa.binary()),
                grams=pa.array([ids[hot].tobytes()], pa.binary()), classes=pa.array([class_of(hot_times[hot_at[hot]]).tobytes()], pa.binary()),
            )
            owner, ids = owner[~hot], ids[~hot]
        where = ids % buckets
        order = np.argsort(where.astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
        where, owner, short = where[order], owner[order], (ids[order] // buckets).view(np.uint8).reshape(-1, 8)[:, :WIDE]
        cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True]) if len(where) else np.zeros(1, np.int64)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        target = pa.array(where[cuts[:-1]].astype(np.int32), pa.int32())
        yield _spread_row(bucket=target, flush=pa.array([name] * len(spans), pa.int64()), source=target, ords=pa.array([owner[a:z].tobytes() for a, z in spans], pa.binary()), grams=pa.array([short[a:z].tobytes() for a, z in spans], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = done = 0
        task = TaskContext.get().partitionId() << 32

        def out() -> Iterator[pa.RecordBatch]:
            yield from flush(task + done, np.stack([k for k, _ in held]), np.array([len(s) for _, s in held], np.int64), np.concatenate([s for _, s in held]))

        for b in batches:
            for _, sets in _slices(b, n, spaced):
                sets = [s for s in sets if len(s)]
                for key, s in zip(set_keys(sets), sets, strict=True):
                    if (name := key.tobytes()) not in seen:
                        seen.add(name)
                        held.append((key, s))
                        total += len(s)
                    if total > FLUSH_GRAMS or len(held) == 1 << 16:
                        yield from out()
                        held, total, done = [], 0, done + 1
        if held:
            yield from out()

    return released(run)


def gram_ids(grams: np.ndarray, buckets: int) -> np.ndarray:
    """A gram's name: WIDE bytes of it and its bucket."""
    where = grams % U64(buckets)
    return ((grams // U64(buckets) & U64((1 << 8 * WIDE) - 1)) * U64(buckets) + where).astype(np.int64)


def class_of(times: np.ndarray) -> np.ndarray:
    """Steps of a quarter power of two: what the order of grams goes by."""
    return np.minimum(np.rint(4 * np.log2(np.maximum(times, 1))), 255).astype(np.uint8)


def _joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of blobs, and how many each blob has."""
    blobs = [x.as_buffer() for x in column.combine_chunks()]
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(blobs), kind), np.array([len(x) // size for x in blobs], np.int64)


def _counted(tab: pa.Table) -> pa.Table:
    """Of one bucket's grams those that two documents or more hold, with the class of their number; what is no gram goes on."""
    rest = tab.filter(pc.or_kleene(pc.is_null(tab.column("source")), pc.equal(tab.column("source"), -1)))
    tab = tab.filter(pc.greater_equal(tab.column("source"), 0))
    if not tab.num_rows:
        return rest
    ords, n = _joined(tab.column("ords"), np.uint16)
    raw = np.frombuffer(b"".join(x.as_buffer() for x in tab.column("grams").combine_chunks()), np.uint8).reshape(-1, WIDE)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :WIDE] = raw
    gram = wide.reshape(-1).view(np.int64)
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    start = np.flatnonzero(np.r_[True, ~same])
    times = np.diff(np.r_[start, len(gram)])
    classes = np.empty(len(gram), np.uint8)
    classes[order] = np.repeat(class_of(times), times)
    keep = np.zeros(len(gram), bool)
    keep[order] = np.repeat(times > 1, times)
    row = np.repeat(np.arange(len(n)), n)[keep]
    ords, raw, classes = ords[keep], raw[keep], classes[keep]
    cuts = np.searchsorted(row, np.arange(len(n) + 1)).tolist()
    out = {
        "bucket": tab.column("bucket"), "flush": tab.column("flush"), "source": tab.column("source"), "ords": pa.array([ords[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        "grams": pa.array([raw[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), "classes": pa.array([classes[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
    }
    out |= {k: pa.nulls(tab.num_rows, pa.binary()) for k in ("keys", "sizes")}
    return pa.concat_tables([rest, pa.table(out).filter(pa.array(np.diff(cuts) > 0))])


def _fronts(tab: pa.Table, t: float, buckets: int, hot: int) -> pa.Table:
    """Of the documents of one flush the front grams that others hold too, by the gram's bucket.

    Rows (bucket, salt, keys, sizes, grams). The list of a gram of over ``hot`` documents is dealt to several tasks: its
    rows carry a salt from 1.
    """
    head = tab.filter(pc.is_valid(tab.column("keys")))
    keys = np.frombuffer(head.column("keys")[0].as_py(), U64).reshape(-1, 2)
    sizes = np.frombuffer(head.column("sizes")[0].as_py(), np.int32).astype(np.int64)
    tab = tab.filter(pc.is_valid(tab.column("ords")))
    names = ("bucket", "salt", "keys", "sizes", "grams")
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    empty = pa.table({k: pa.array([], d) for k, d in zip(names, kinds, strict=True)})
    if not tab.num_rows:
        return empty
    owner, _ = _joined(tab.column("ords"), np.uint16)
    classes, n = _joined(tab.column("classes"), np.uint8)
    source = tab.column("source").to_numpy()
    parts = []
    for blob, s in zip(tab.column("grams").combine_chunks(), source.tolist(), strict=True):
        if s < 0:
            parts.append(np.frombuffer(blob.as_buffer(), np.int64))
        else:
            raw = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, WIDE)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :WIDE] = raw
            parts.append(wide.reshape(-1).view(np.int64) * buckets + s)
    gram = np.concatenate(parts)
    order = np.lexsort((gram, classes, owner))
    owner, gram, classes = owner[order].astype(np.int64), gram[order], classes[order]
    shared = np.bincount(owner, minlength=len(sizes))
    # the grams of one document alone come first: what they leave of the front is for the others
    room = prefix_length(sizes, t) - (sizes - shared)
    place = np.arange(len(owner)) - (np.cumsum(shared) - shared)[owner]
    keep = (place < room[owner]) & (np.minimum(room, shared) >= needed(sizes, t))[owner]
    owner, gram, classes = owner[keep], gram[keep], classes[keep]
    if not len(owner):
        return empty
    dealt = np.maximum(np.ceil(np.exp2(classes / 4.0) / hot), 1).astype(np.int64)
    salt = np.where(dealt > 1, 1 + (keys[owner, 1] % dealt.astype(U64)).astype(np.int64), 0)
    where = gram % buckets
    order = np.lexsort((salt, where))
    owner, gram, where, salt = owner[order], gram[order], where[order], salt[order]
    cuts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (salt[1:] != salt[:-1]), True])
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    cols = (where[cuts[:-1]], salt[cuts[:-1]], *([x[a:z].tobytes() for a, z in spans] for x in (keys[owner], sizes[owner].astype(np.int32), gram)))
    return pa.table({k: pa.array(c, d) for k, c, d in zip(names, cols, kinds, strict=True)})


def _lists(tab: pa.Table) -> pa.Table:
    """Memberships (head, node, n, weight) of the sets that share a gram; of a salted gram its part's, under the gram's name."""
    keys, n, gram = (_joined(tab.column(k), d)[0] for k, d in (("keys", U64), ("sizes", np.int32), ("grams", np.int64)))
    keys = keys.reshape(-1, 2)
    dealt = tab.column("salt")[0].as_py() > 0  # one salt a group
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    first = np.r_[True, (keys[order][1:] != keys[order][:-1]).any(axis=1)]
    node = np.empty(len(keys), np.int64)
    node[order] = np.cumsum(first) - 1
    keys, n = keys[order][first], n[order][first]  # numbers follow the order of keys
    order = np.lexsort((node, gram))
    node, gram = node[order], gram[order]
    fresh = np.r_[True, (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])]
    node, gram = node[fresh], gram[fresh]
    cuts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1], True])
    length = np.diff(cuts)
    head = np.repeat(node[cuts[:-1]], length)
    keep = (np.repeat(length, length) > 1) | dealt
    head, node, name = head[keep], node[keep], gram[keep] if dealt else np.zeros(int(keep.sum()), np.int64)
    order = np.lexsort((node, head, name))
    head, node, name = head[order], node[order], name[order]
    cuts = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (node[1:] != node[:-1]) | (name[1:] != name[:-1]), True]) if len(head) else np.zeros(1, np.int64)
    at = cuts[:-1]
    return pa.table({"head": key_bytes(keys[head[at]]), "node": key_bytes(keys[node[at]]), "n": pa.array(n[node[at]], pa.int32()), "weight": pa.array(np.diff(cuts), pa.int64()), "gram": pa.array(name[at], pa.int64()) if dealt else pa.nulls(len(at), pa.int64())})


class Cell:
    """Sparse sets of one cell with what the join needs at hand."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(sets)), self.size)
        _, col = np.unique(flat, return_inverse=True)
        often = np.bincount(col) if len(col) else np.zeros(0, np.int64)
        keep = often[col] > 1 if len(col) else np.zeros(0, bool)
        row, col = row[keep], col[keep]
        self.start = np.searchsorted(row, np.arange(len(sets) + 1))
        self.col = col
        order = np.argsort(col, kind="stable")
        self.by_col = row[order]
        self.col_start = np.searchsorted(col[order], np.arange(len(often) + 1))

    def common(self, i: int) -> np.ndarray:
        """Common grams of set i with every set; its own size with itself."""
        cols = self.col[self.start[i] : self.start[i + 1]]
        lo, n = self.col_start[cols], self.col_start[cols + 1] - self.col_start[cols]
        total = int(n.sum())
        c = np.bincount(self.by_col[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)], minlength=len(self.size)) if total else np.zeros(len(self.size), np.int64)
        c[i] = self.size[i]
        return c

    def distances(self, i: int) -> np.ndarray:
        c = self.common(i)
        return 1 - c / (self.size + self.size[i] - c)


def metric_join(sets: list[np.ndarray], tau: float, leaf: int = LEAF, side: np.ndarray | None = None, trace: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, partners, common grams) over all pairs of these non-empty sorted sets with Jaccard distance <= tau, each pair once.

    An item of work is some members, of which those at home need their partners. Over ``leaf`` members it gets
    pivots, each the home member farthest from those before. Home members within ``inner`` of their nearest pivot make
    its cell; from outside a cell only y with d(y, pivot) <= radius + tau can have a partner in it, by the triangle
    inequality, and only such y are looked at. ``inner`` is under 1 - tau, so that a window never takes in what shares
    nothing with the pivot. The remote rest is an item of its own, with new pivots; a cell is one again. Where windows
    spare less than a fifth of the comparisons the item is counted directly. With ``side``, pairs of one side are left out.
    ``trace`` gets the members and the cells of every item that was split.
    """
    work = [(np.arange(len(sets)), np.ones(len(sets), bool))]
    while work:
        members, home = work.pop()
        if not home.any() or len(members) < 2:
            continue
        cell = Cell([sets[i] for i in members])
        parts = _voronoi(cell, home, tau, leaf) if len(members) > leaf else None
        if parts is not None:
            if trace is not None:
                trace.append((len(members), len(parts)))
            work.extend((members[p], h) for p, h in parts)
            continue
        rank = np.cumsum(home) - 1  # of two home members the later one is met by the earlier
        for i in np.flatnonzero(home).tolist():
            c = cell.common(i)
            ok = (c > 0) & (~home | (rank > rank[i])) & (c >= (1 - tau) * (cell.size + cell.size[i] - c) - 1e-9)
            if side is not None:
                ok &= side[members] != side[members[i]]
            j = np.flatnonzero(ok)
            if len(j):
                yield int(members[i]), members[j], c[j]


def connect(sets: list[np.ndarray], tau: float) -> np.ndarray:
    """For each set the least number of a set that it is joined with, over distances <= tau.

    Only connections matter here, so that a set is compared with all others only while it is outside the largest group:
    of two sets in different groups one is. A family of near copies costs one comparison each, not one for each two.
    """
    cell = Cell(sets)
    label = np.arange(len(sets))
    done = np.zeros(len(sets), bool)
    i = 0
    while True:
        done[i] = True
        c = cell.common(i)
        near = np.flatnonzero((c > 0) & (c >= (1 - tau) * (cell.size + cell.size[i] - c) - 1e-9))
        ends = np.unique(label[near])
        if len(ends) > 1:
            label[np.isin(label, ends)] = ends[0]
        todo = np.flatnonzero(~done & (label != np.bincount(label).argmax()))
        if not len(todo):
            return label
        i = int(todo[0])


def _voronoi(cell: Cell, home: np.ndarray, tau: float, leaf: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """(members, which of them are at home) of each cell and of the remote rest; None where that spares too little."""
    m, inner = len(cell.size), 0.9 * (1 - tau)
    pivot, dist = int(np.flatnonzero(home)[0]), []
    nearest = np.full(m, np.inf)
    for _ in range(min(PIVOTS, max(2, m // leaf))):
        dist.append(cell.distances(pivot))
        nearest = np.minimum(nearest, dist[-1])
        pivot = int(np.argmax(np.where(home, nearest, -1)))
        if nearest[pivot] <= inner:
            break
    d = np.stack(dist)
    of = np.where(home & (nearest <= inner), np.argmin(d, axis=0), len(d))
    parts, cost = [], 0
    for i in range(len(d)):
        own = of == i
        if own.any():
            # members of earlier cells have met this one as visitors already
            inside = own | ((d[i] <= d[i][own].max() + tau + 1e-9) & ((of > i) | ~home))
            parts.append((np.flatnonzero(inside), own[inside]))
            cost += int(own.sum()) * int(inside.sum())
    rest = home & (of == len(d))
    if rest.any():
        far = d[:, rest].min(axis=1, keepdims=True) - d > tau + 1e-9  # visitors too near to a pivot for any of the rest
        inside = rest | (~home & ~far.any(axis=0))
        parts.append((np.flatnonzero(inside), rest[inside]))
        cost += int(rest.sum()) * int(inside.sum())
    return parts if cost <= 0.8 * int(home.sum()) * m else None


def _marker(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            k = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            seen[(mix(k) & U64((1 << bits) - 1)).astype(np.int64)] = True
        yield batch(one=pa.array([0], pa.int32()), bits=pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary()))

    return run


def _either(tab: pa.Table) -> pa.Table:
    total = np.frombuffer(tab.column("bits")[0].as_py(), np.uint8).copy()
    for blob in tab.column("bits"):
        total |= np.frombuffer(blob.as_py(), np.uint8)
    return pa.table({"bits": pa.array([total.tobytes()], pa.binary())})


def _carrier(n: int, spaced: bool, wanted):
    """Full sets of the documents that stand for the nodes of regions; a bitmap spares nearly all others the work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        mask = U64(len(bits) * 8 - 1)
        for b in batches:
            at = (mix(b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)) & mask).astype(np.int64)
            b = b.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for _, sets in _slices(b, n, spaced):
                sets = [s for s in sets if len(s)]
                if sets:
                    yield batch(node=key_bytes(set_keys(sets)), grams=pa.array([s.tobytes() for s in sets], pa.binary()))

    return released(run)


def _region_pairs(tab: pa.Table, t: float, forest: bool, counted: bool) -> Iterator[pa.Table]:
    """Joins the regions and blocks of one bucket.

    Gives (a, b, jaccard) of every pair, or with ``forest`` (a = node, b = the least node it is joined with, links = how
    many pairs it is in; 0 unless ``counted``). A pair of several regions counts in the least of those that both belong to; a pair of one
    sub-block in that sub-block's own block.
    """
    tab = tab.sort_by([("head", "ascending"), ("block", "ascending"), ("node", "ascending")])
    block = tab.column("block").to_numpy()
    heads = tab.column("head").to_pylist()
    cuts = [0, *(k for k in range(1, len(heads)) if heads[k] != heads[k - 1] or block[k] != block[k - 1]), len(heads)]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        if z - a < 2:
            continue
        part = tab.slice(a, z - a)
        sets = [np.frombuffer(x.as_py(), U64) for x in part.column("grams")]
        size = np.array([len(s) for s in sets])
        node = part.column("node").combine_chunks()
        if forest and not counted:
            label = connect(sets, 1 - t)
            some = np.flatnonzero(label != np.arange(z - a))
            yield pa.table({"a": node.take(pa.array(some)), "b": node.take(pa.array(label[some])), "links": pa.array(np.zeros(len(some), np.int64))})
            continue
        sub = part.column("sub").to_numpy()
        # regions before this one to which a set belongs as well, as small numbers
        low = [frozenset(h for h in hs if h < heads[a]) for hs in part.column("heads").to_pylist()]
        kinds = list(dict.fromkeys(low))
        number = {k: i for i, k in enumerate(kinds)}
        kind = np.array([number[x] for x in low])
        apart: dict[int, np.ndarray] = {}
        cross = bool(block[a] >> 31 != block[a] & ((1 << 31) - 1))
        label, links = np.arange(z - a), np.zeros(z - a, np.int64)
        ia, ib, jac = [], [], []
        for i, j, c in metric_join(sets, 1 - t, side=sub if cross else None):
            if forest:
                ends = np.unique(label[np.r_[i, j]])
                if len(ends) > 1:
                    label[np.isin(label, ends)] = ends[0]
            if (k := int(kind[i])) not in apart:
                apart[k] = np.array([kinds[k].isdisjoint(y) for y in kinds])
            ok = apart[k][kind[j]]
            j, c = j[ok], c[ok]
            links[i] += len(j)
            links[j] += 1
            if not forest:
                ia.append(np.full(len(j), i))
                ib.append(j)
                jac.append(c / (size[i] + size[j] - c))
        if forest:
            some = np.flatnonzero((links > 0) | (label != np.arange(z - a)))
            yield pa.table({"a": node.take(pa.array(some)), "b": node.take(pa.array(label[some])), "links": pa.array(links[some], pa.int64())})
        elif ia:
            i, j = np.concatenate(ia), np.concatenate(ib)
            lo, hi = np.minimum(i, j), np.maximum(i, j)
            yield pa.table({"a": node.take(pa.array(lo)), "b": node.take(pa.array(hi)), "jaccard": pa.array(np.concatenate(jac), pa.float64())})


def similar_nodes(docs: DataFrame, t: float = THRESHOLD, n: int = NGRAM, forest: bool = False, counted: bool = True, cell_sets: int = CELL_SETS, cell_grams: int = CELL_GRAMS, hot: int = HOT_LIST, spaced: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, node) of every row with an id and words, and (a, b, jaccard) of every two nodes with similarity >= t.

    ``version`` is a hash of the text. With ``forest`` the second is (a, b, links): the pairs of a spanning forest of
    each region, and for a the number of its pairs (0 unless ``counted``), to be added up over all rows of a: linear in
    the memberships. ``spaced``: words are what white space parts, of texts that the caller has put in lower case.
    """
    if not 0 < t <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    spark = docs.sparkSession
    sc = spark.sparkContext
    slim = id_text(docs).where("doc_id is not null and text is not null")
    buckets = shuffle_partitions(spark)
    profile = checkpoint(slim.select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(_profiler(n, spaced), "doc_id long, version long, node binary, n int, gram long, times long"))
    nodes = profile.where("gram is null").select("doc_id", "version", "node")
    # grams in at least this share of all documents: at most the mean size of a set over the share
    bound = max(hot, HOT_SHARE * nodes.count())
    often = {r["gram"]: r["times"] for r in profile.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")).where(F.col("times") >= bound).toLocalIterator()}
    hot_grams = np.sort(np.array(list(often), np.int64).view(U64))
    hot_times = np.array([often[g] for g in hot_grams.view(np.int64).tolist()], np.int64)

    spread = slim.mapInArrow(_spreader(n, spaced, buckets, hot_grams, hot_times), SPREAD)
    tallied = spread.groupBy("bucket").applyInArrow(released(_counted), SPREAD)
    fronts = tallied.groupBy("flush").applyInArrow(released(lambda tab: _fronts(tab, t, buckets, hot)), "bucket int, salt long, keys binary, sizes binary, grams binary")
    listed = checkpoint(fronts.groupBy("bucket", "salt").applyInArrow(released(_lists), "head binary, node binary, n int, weight long, gram long"))
    # a gram whose list was dealt to several tasks has the least of their heads
    whole, dealt = listed.where("gram is null").drop("gram"), listed.where("gram is not null")
    named = dealt.groupBy("gram").agg(F.min("head").alias("least"))
    dealt = dealt.drop("head").join(named, "gram").select(F.col("least").alias("head"), "node", "n", "weight")
    weighed = whole.unionByName(dealt).groupBy("head", "node").agg(F.max("n").alias("n"), F.sum("weight").alias("weight"))
    least = F.ceil(F.col("n") * F.lit(t) - F.lit(1e-9))
    need = F.greatest(F.least(F.lit(3) + F.floor(least / 16), least) - 1, F.lit(1))
    own = Window.partitionBy("node")
    ranked = weighed.withColumn("need", need).withColumn("all", F.sum("weight").over(own)).withColumn("below", F.sum("weight").over(own.orderBy("weight", F.desc("head")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = ranked.where((F.col("all") >= F.col("need")) & (F.col("below") > F.floor((F.col("need") - 1) / 2)))
    region = kept.groupBy("head").agg(F.count("*").alias("sets"), F.sum("n").alias("grams")).where("sets > 1")
    region = region.select("head", F.ceil(F.greatest(F.col("sets") / F.lit(cell_sets), F.col("grams") / F.lit(cell_grams))).cast("long").alias("blocks"))
    member = kept.join(region, "head").select("head", "node", "blocks", F.sort_array(F.collect_list("head").over(own)).alias("heads"))
    member = member.withColumn("sub", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), "blocks")).otherwise(F.lit(0)).cast("long"))
    member = checkpoint(member.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("sub", j).alias("x"), F.greatest("sub", j).alias("y"))))).drop("blocks"))

    reps = checkpoint(nodes.join(member.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    bits = min(max(MARK_BITS[0], (16 * reps.count()).bit_length()), MARK_BITS[1])
    marks = np.zeros((1 << bits) // 8, np.uint8)
    for r in reps.select("doc_id").repartition(4).mapInArrow(_marker(bits), "one int, bits binary").groupBy("one").applyInArrow(_either, "bits binary").toLocalIterator():
        marks |= np.frombuffer(r["bits"], np.uint8)  # one row, 16 MB at most
    wanted = sc.broadcast(marks.tobytes())
    full = slim.mapInArrow(_carrier(n, spaced, wanted), "node binary, grams binary").join(reps.select("node"), "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams"))
    cells = member.join(full, "node").withColumn("bucket", F.pmod(F.xxhash64("head", "block"), F.lit(buckets)))
    kind = "a binary, b binary, links long" if forest else "a binary, b binary, jaccard double"
    empty = pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), **({"links": pa.array([], pa.int64())} if forest else {"jaccard": pa.array([], pa.float64())})})

    def join(tab: pa.Table) -> pa.Table:
        x = tab.column("block").combine_chunks()
        both = pa.array(x.field("x").to_numpy() * (1 << 31) + x.field("y").to_numpy())
        return pa.concat_tables([empty, *_region_pairs(tab.set_column(tab.column_names.index("block"), "block", both), t, forest, counted)])

    pairs = cells.select("bucket", "head", "block", "sub", "node", "heads", "grams").groupBy("bucket").applyInArrow(released(join), kind)
    return nodes, pairs


def ngram_jaccard_join(docs: DataFrame, t: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """Every two different texts whose sets of lower-case word n-grams have Jaccard similarity >= t, exactly.

    Result: doc_id_a < doc_id_b, jaccard, where a document stands for all of an equal n-gram set: the one of least
    doc_id (``similar_classes`` says for which). Words are runs of ASCII letters and digits and of any non-ASCII
    characters. A document of fewer than n words has one gram, all its words; one without words (null, empty,
    punctuation only) has none and no partner. A null doc_id joins with none. The texts of a repeated doc_id are
    compared each by itself, never with one another; of several pairs of the same two ids the most similar is given.
    Texts of any length are taken whole. Extra columns are ignored, whatever their names. An empty table gives an
    empty result.
    """
    nodes, pairs = similar_nodes(docs, t, n)
    rep = nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    out = pairs.join(rep.select(F.col("node").alias("a"), F.col("doc_id").alias("x")), "a").join(rep.select(F.col("node").alias("b"), F.col("doc_id").alias("y")), "b").where("x <> y")
    return out.groupBy(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).agg(F.max("jaccard").alias("jaccard"))


def _classes(docs: DataFrame, t: float, n: int, counted: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, node) of rows, and (node, class, links): a node's component and how many nodes are similar to it."""
    nodes, found = similar_nodes(docs, t, n, forest=True, counted=counted)
    found = checkpoint(found)
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comp = connected(found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return nodes, links.join(comp.select(F.col("id").alias("node"), F.col("root").alias("class")), "node", "full")


def similar_classes(docs: DataFrame, t: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs``.

    n_links counts the other texts (distinct n-gram sets) of similarity >= t to the row's own, whoever has them; copies
    of one set aren't told apart. class_id is the least doc_id of all documents that equal sets and links connect
    with the row, its own where there are none. Rows without words have themselves as class and no links; a null
    doc_id has a null class and is in no one else's. Repeated rows give repeated results; the texts of a repeated
    doc_id are in classes of their own. Words, short and long texts, extra columns and empty tables: as in
    ``ngram_jaccard_join``.
    """
    nodes, found = _classes(docs, t, n, counted=True)
    rep = nodes.groupBy("node").agg(F.min("doc_id").alias("rep"))
    placed = rep.join(found, "node", "left").select("node", "rep", F.coalesce("class", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    head = placed.groupBy("class").agg(F.min("rep").alias("class_id"))
    placed = placed.join(head, "class").select("node", "class_id", "links")
    named = nodes.join(placed, "node").select("doc_id", "class_id", F.col("links").alias("n_links"))
    spoken = nodes.select("doc_id", "version").distinct()
    slim = id_text(docs).select("doc_id", F.xxhash64("text").alias("version"))
    silent = slim.join(spoken, ["doc_id", "version"], "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return named.unionByName(silent)


def drop_similar(docs: DataFrame, t: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """The rows without the later members of each group of similar ones: the row of least doc_id of a group stays.

    Groups are the classes of ``similar_classes``. It is rows that go, not ids: where an id is repeated, only the row
    whose own text is in the group goes. Of rows of equal doc_id and equal text all stay or go together. Rows with a
    null doc_id and rows without words stay. All columns are kept, whatever their names; an empty table stays empty.
    """
    nodes, found = _classes(docs, t, n, counted=False)
    placed = nodes.join(found.select("node", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    stays = placed.groupBy("class").agg(F.min(F.struct("doc_id", "version")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    gone = placed.join(stays, "class").where(F.struct("doc_id", "version") != F.col("first")).select("doc_id", "version").distinct()
    mark, taken = "gone", {c.lower() for c in docs.columns}
    while mark in taken or f"{mark}_id" in taken:
        mark += "_"
    gone = gone.select(F.col("doc_id").alias(f"{mark}_id"), F.col("version").alias(mark))
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col(f"{mark}_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col(mark)), "left_anti")
