"""Directly addressable codes: token ids with random access to any of them, without decoding a block.

An id is split into chunks of the given widths, lowest bits first. Level k holds the k-th chunks of the ids that
have one, packed, and a bitmap that says of each whether the id goes on; the place of the next chunk is the
bitmap's rank there, which a directory of running counts, one every 512 bits, gives in constant time.

Payload, little-endian: b"DAC1", uint8 number of levels, their widths (uint8 each), uint32 number of ids of each
level, then for each level but the last: the bitmap (whole bytes) and the directory (uint32), and for each level
the packed chunks (whole bytes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, load_vocabulary, token_batches
from .common import batch, checkpoint, id_text, released

MAGIC = b"DAC1"
WIDTHS = (8, 4, 4, 16)
RANK_BITS = 512
ASKED_BITS = 16
ASKED = 1 << ASKED_BITS


def _check(widths: tuple[int, ...]) -> None:
    if not widths or any(w not in (1, 2, 4, 8, 16, 32) for w in widths):
        raise ValueError("a chunk is 1, 2, 4, 8, 16 or 32 bits wide")


def pack(values: np.ndarray, width: int) -> bytes:
    if width >= 8:
        return values.astype(f"<u{width // 8}").tobytes()
    each = 8 // width
    v = np.zeros(-(-len(values) // each) * each, np.uint8)
    v[: len(values)] = values
    v = v.reshape(-1, each) << (np.arange(each, dtype=np.uint8) * np.uint8(width))
    return np.bitwise_or.reduce(v, axis=1).astype(np.uint8).tobytes() if len(v) else b""


def directory(bits: np.ndarray) -> np.ndarray:
    """Ones before every RANK_BITS-th bit."""
    padded = np.zeros(-(-len(bits) // RANK_BITS) * RANK_BITS, np.uint32)
    padded[: len(bits)] = bits
    sums = padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint32)
    return np.r_[0, np.cumsum(sums)[:-1]].astype("<u4") if len(sums) else np.zeros(0, "<u4")


def encode_ids(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The payload of these non-negative ids."""
    return encode_rows(np.asarray(ids), np.array([len(ids)]), widths)[0]


def encode_rows(ids: np.ndarray, counts: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[bytes]:
    """A payload for each row of a flat array; the levels are split for all rows at once."""
    _check(widths)
    ids = ids.astype(np.int64)
    if len(ids) and (ids.min() < 0 or int(ids.max()) >> sum(widths)):
        raise ValueError("an id is negative or wider than all chunks together")
    rest, row = ids, np.repeat(np.arange(len(counts)), counts)
    chunks, goes_on, ends = [], [], []
    for k, w in enumerate(widths):
        ends.append(np.r_[0, np.cumsum(np.bincount(row, minlength=len(counts)))] if len(counts) else np.zeros(1, np.int64))
        chunks.append(rest & ((1 << w) - 1))
        rest = rest >> w
        more = rest > 0
        goes_on.append(more)
        if k == len(widths) - 1 or not more.any():
            break
        rest, row = rest[more], row[more]
    out = []
    for r in range(len(counts)):
        n = [int(e[r + 1] - e[r]) for e in ends]
        levels = max(1, sum(1 for x in n if x))
        head = [MAGIC, bytes([levels]), bytes(widths[:levels]), np.array(n[:levels], "<u4").tobytes()]
        body = []
        for k in range(levels - 1):
            bits = goes_on[k][ends[k][r] : ends[k][r + 1]]
            body += [np.packbits(bits, bitorder="little").tobytes(), directory(bits).tobytes()]
        body += [pack(chunks[k][ends[k][r] : ends[k][r + 1]], widths[k]) for k in range(levels)]
        out.append(b"".join(head + body))
    return out


class Codes:
    """Reads a payload; ``codes[i]`` and ``at`` touch one chunk a level and one directory entry between levels."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a DAC payload")
        levels = payload[4]
        self.widths = list(payload[5 : 5 + levels])
        self.n = np.frombuffer(payload, "<u4", levels, 5 + levels).astype(np.int64).tolist()
        at = 5 + 5 * levels
        self.bits, self.ranks, self.chunks = [], [], []
        for k in range(levels - 1):
            size = -(-self.n[k] // 8)
            self.bits.append(np.frombuffer(payload, np.uint8, size, at))
            at += size
            size = -(-self.n[k] // RANK_BITS)
            self.ranks.append(np.frombuffer(payload, "<u4", size, at))
            at += 4 * size
        for k, w in enumerate(self.widths):
            size = -(-self.n[k] * w // 8)
            self.chunks.append(np.frombuffer(payload, np.uint8, size, at))
            at += size

    def __len__(self) -> int:
        return self.n[0]

    def _chunk(self, k: int, i: np.ndarray) -> np.ndarray:
        w = self.widths[k]
        if w >= 8:
            return np.frombuffer(self.chunks[k], f"<u{w // 8}")[i].astype(np.int64)
        each = 8 // w
        return (self.chunks[k][i // each] >> ((i % each) * w) & ((1 << w) - 1)).astype(np.int64)

    def _rank(self, k: int, i: np.ndarray) -> np.ndarray:
        """Ones before bit i of level k: a directory entry and the set bits of at most 63 bytes and a part."""
        from_dir = self.ranks[k][i // RANK_BITS].astype(np.int64)
        first = i // RANK_BITS * (RANK_BITS // 8)
        span = np.arange(RANK_BITS // 8)
        byte = first[:, None] + span[None, :]
        whole = byte < (i // 8)[:, None]
        inside = np.where(whole, _ONES[self.bits[k][np.minimum(byte, len(self.bits[k]) - 1)]], 0).sum(axis=1)
        part = _ONES[self.bits[k][i // 8] & ((1 << (i % 8)) - 1)]
        return from_dir + inside + part

    def at(self, positions: np.ndarray) -> np.ndarray:
        """The ids at these positions."""
        i = np.asarray(positions, np.int64)
        if len(i) and (i.min() < 0 or i.max() >= self.n[0]):
            raise IndexError("position outside the ids")
        out, who, shift = np.zeros(len(i), np.int64), np.arange(len(i)), 0
        for k in range(len(self.widths)):
            if not len(i):
                break
            out[who] |= self._chunk(k, i) << shift
            shift += self.widths[k]
            if k == len(self.widths) - 1:
                break
            more = (self.bits[k][i // 8] >> (i % 8) & 1).astype(bool)
            who, i = who[more], self._rank(k, i[more])
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.at(np.array([i]))[0])

    def decode(self) -> np.ndarray:
        """All ids, level by level."""
        out, who, shift = np.zeros(self.n[0], np.int64), np.arange(self.n[0]), 0
        for k, w in enumerate(self.widths):
            out[who] |= self._chunk(k, np.arange(self.n[k])) << shift
            shift += w
            if k < len(self.widths) - 1:
                who = who[np.unpackbits(self.bits[k], bitorder="little")[: self.n[k]].astype(bool)]
        return out


_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


def encode_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """doc_id, n_tokens, n_bytes, codes: the text's BPE ids as a directly addressable payload.

    An empty text has a payload of 0 ids; a null text has nulls; an empty table gives an empty result. Rows are kept as
    they are, repeated and null ids included; extra columns are ignored, whatever their names. Texts of any length are
    taken whole; bytes that aren't UTF-8 count as U+FFFD. The ids are made and packed in one pass, without a shuffle.
    """
    _check(widths)
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, _, _, ids, count in token_batches(b, shared.value):
                gone = part.column("text").is_null().to_pylist()
                rows = [None if g else p for g, p in zip(gone, encode_rows(ids, count, widths), strict=True)]
                yield batch(
                    doc_id=part.column("doc_id"),
                    n_tokens=pa.array([None if g else c for g, c in zip(gone, count.tolist(), strict=True)], pa.int32()),
                    n_bytes=pa.array([None if p is None else len(p) for p in rows], pa.int32()),
                    codes=pa.array(rows, pa.binary()),
                )

    return id_text(docs).mapInArrow(released(run), "doc_id long, n_tokens int, n_bytes int, codes binary")


def write_shards(encoded: DataFrame, folder: str) -> DataFrame:
    """Writes the payloads of (doc_id, n_tokens, codes) to binary files, one a task, and gives doc_id, shard, start, n_bytes,
    n_tokens: where each lies. Null payloads have no row.

    ``folder`` is a path or URI that all executors reach. A task writes under a name of its attempt and renames at its
    end, so that one that is tried again replaces its own file only. The places are checkpointed: files are written once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.dac"
        temp = f"{base}/_{name}.{task.taskAttemptId()}"
        out, at = None, 0
        for b in batches:
            b = b.filter(b.column("codes").is_valid())
            if out is None and b.num_rows:
                fs.create_dir(base)
                out = fs.open_output_stream(temp)
            sizes = []
            for c in b.column("codes"):
                out.write(c.as_buffer())
                sizes.append(c.as_buffer().size)
            if sizes:
                size = np.array(sizes, np.int64)
                yield batch(doc_id=b.column("doc_id"), shard=pa.array([name] * len(size), pa.string()), start=pa.array(at + np.cumsum(size) - size), n_bytes=pa.array(size), n_tokens=b.column("n_tokens"))
                at += int(size.sum())
        if out is not None:
            out.close()
            fs.move(temp, f"{base}/{name}")

    return checkpoint(encoded.select("doc_id", "n_tokens", "codes").mapInArrow(released(run), "doc_id long, shard string, start long, n_bytes long, n_tokens int"))


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _asked(positions: DataFrame) -> DataFrame:
    """doc_id, at, times: the places asked in a document with how often each, at most ASKED places in a row.

    Counted before they are gathered: neither a document that is asked for often nor a place that is makes a long list.
    """
    one = positions.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("position").cast("long").alias("position")).where("doc_id is not null and position is not null")
    times = one.groupBy("doc_id", "position").agg(F.count("*").alias("times"))
    some = times.groupBy("doc_id", F.shiftright("position", ASKED_BITS).alias("part")).agg(F.collect_list(F.struct("position", "times")).alias("asked"))
    return some.select("doc_id", F.col("asked.position").alias("at"), F.col("asked.times").alias("times"))


def _answers(rows: Iterator[tuple[int, Codes | None, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id, position, token of (doc_id, codes, places, how often each), in pieces of ASKED rows at most."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def pieces() -> Iterator[pa.RecordBatch]:
        ids, at, times, token, inside = (np.concatenate(x) for x in zip(*held, strict=True))
        ends = np.cumsum(times)
        for lo in range(0, int(ends[-1]), ASKED):
            k = np.searchsorted(ends, np.arange(lo, min(lo + ASKED, int(ends[-1]))), side="right")
            yield batch(doc_id=pa.array(ids[k]), position=pa.array(at[k]), token=pa.array(token[k], mask=~inside[k]))

    for d, codes, at, times in rows:
        inside = (at >= 0) & (at < (0 if codes is None else len(codes)))
        token = np.zeros(len(at), np.int64)
        if codes is not None and inside.any():
            token[inside] = codes.at(at[inside])
        held.append((np.full(len(at), d, np.int64), at, times, token, inside))
        size += len(at)
        if size >= ASKED:
            yield from pieces()
            held, size = [], 0
    if held:
        yield from pieces()


def _lists(b: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    return (x.values.to_numpy(zero_copy_only=False) for x in b.column(name))


def tokens_in_shards(places: DataFrame, positions: DataFrame, folder: str) -> DataFrame:
    """doc_id, position, token for the asked (doc_id, position), read from the shards; a position outside gives a null token.

    Only the payloads of the asked documents are read. A null id or position is no question and has no row; one asked
    several times has as many rows. Extra columns of either table are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)

        def rows() -> Iterator[tuple[int, Codes | None, np.ndarray, np.ndarray]]:
            for b in batches:
                for d, shard, start, size, at, times in zip(*(b.column(c).to_pylist() for c in ("doc_id", "shard", "start", "n_bytes")), _lists(b, "at"), _lists(b, "times"), strict=True):
                    with fs.open_input_file(f"{base}/{shard}") as f:
                        f.seek(start)
                        yield d, Codes(f.read(size)), at, times

        yield from _answers(rows())

    where = places.select("doc_id", "shard", "start", "n_bytes")
    return where.join(_asked(positions), "doc_id").mapInArrow(released(run), "doc_id long, position long, token long")


def decode_tokens(encoded: DataFrame) -> DataFrame:
    """doc_id, tokens from doc_id, codes; null codes give null tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [None if c is None else Codes(c).decode().astype(np.int32) for c in b.column("codes").to_pylist()]
            yield batch(doc_id=b.column("doc_id"), tokens=pa.array(rows, pa.list_(pa.int32())))

    return encoded.select("doc_id", "codes").mapInArrow(released(run), "doc_id long, tokens array<int>")


def tokens_at(encoded: DataFrame, positions: DataFrame) -> DataFrame:
    """doc_id, position, token for the asked (doc_id, position); a position outside the document, or null codes, give a null token.

    A null id or position is no question and has no row; one asked several times has as many rows, and a repeated id of
    ``encoded`` answers once for each of its rows. Extra columns of either table are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _answers((d, None if c is None else Codes(c), at, times) for b in batches for d, c, at, times in zip(b.column("doc_id").to_pylist(), b.column("codes").to_pylist(), _lists(b, "at"), _lists(b, "times"), strict=True))

    return encoded.select("doc_id", "codes").join(_asked(positions), "doc_id").mapInArrow(released(run), "doc_id long, position long, token long")
