"""Members of zip archives, nested ones too, from bytes in memory: nothing is unpacked to disk."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "archive string, member string, depth int, size_bytes long, content binary, problem string"
KINDS = {"archive": pa.string(), "member": pa.string(), "depth": pa.int32(), "size_bytes": pa.int64(), "content": pa.binary(), "problem": pa.string()}
BATCH_BYTES, BATCH_ROWS = 8 << 20, 10_000


def unsafe(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or (len(parts[0]) == 2 and parts[0][1] == ":")


def members(archive: str, data: bytes | pa.Buffer, max_depth: int = 3, max_bytes: int = 32 << 20) -> Iterator[tuple]:
    """Rows of SCHEMA, breadth first; a member that leaves its folder or is too large is named and not read."""
    queue = [(archive, data, 1)]
    while queue:
        name, blob, depth = queue.pop(0)
        try:
            z = zipfile.ZipFile(io.BytesIO(blob))
        except zipfile.BadZipFile as e:
            yield (name, None, depth, None, None, str(e))
            continue
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            if info.is_dir():
                continue
            problem = "leaves the archive" if unsafe(info.filename) else "too large" if info.file_size > max_bytes else None
            content = None
            if problem is None:
                try:
                    content = z.read(info)
                except (RuntimeError, zipfile.BadZipFile, NotImplementedError) as e:
                    problem = str(e)
            yield (name, info.filename, depth, info.file_size, content, problem)
            if content is not None and info.filename.lower().endswith(".zip") and depth < max_depth:
                queue.append((f"{name}!/{info.filename}", content, depth + 1))


def rows(batches: Iterator[pa.RecordBatch], max_depth: int = 3, content: bool = True) -> Iterator[pa.RecordBatch]:
    """The members of all archives of (path, content) batches: many small archives share a batch, which holds BATCH_BYTES
    of content, or the one member that is larger."""
    held, size = [], 0
    for b in batches:
        for p, c in zip(b.column("path"), b.column("content"), strict=True):
            if not c.is_valid:
                continue
            for row in members(p.as_py(), c.as_buffer(), max_depth):
                held.append(row)
                size += len(row[4] or b"") if content else 0
                if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield _batch(held, content)
                    held, size = [], 0
    if held:
        yield _batch(held, content)


def _batch(held: list[tuple], content: bool) -> pa.RecordBatch:
    columns = dict(zip(KINDS, zip(*held, strict=True), strict=True))
    return pa.RecordBatch.from_pydict({k: pa.array(columns[k], kind) for k, kind in KINDS.items() if content or k != "content"})


def expand(archives: DataFrame, max_depth: int = 3, content: bool = True) -> DataFrame:
    """Members of (path, content) rows. Without ``content`` members are read all the same, but their bytes stay in the worker."""
    schema = ", ".join(c for c in SCHEMA.split(", ") if content or c != "content binary")
    return archives.select("path", "content").mapInArrow(lambda batches: rows(batches, max_depth, content), schema)
