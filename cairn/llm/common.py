"""What the operators share: reading tables, the checkpoint folder, Arrow helpers, tidy input columns."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import table

__all__ = ["batch", "checkpoint", "ensure_checkpoint_dir", "filter_rows", "id_text", "ids_of", "list_array", "released", "shuffle_partitions", "split_rows", "table"]


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, under fixed names: nothing clashes with the input's other columns.

    The id becomes a BIGINT, the text a STRING; both may be null.
    """
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that the cluster names; one of our own only in local mode, where one machine does all."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairn-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@functools.cache
def _libc() -> Any:
    """The C library where it can be told how to keep freed memory, else None.

    A large array gets pages of its own, which go back when it is freed, rather than a place in a heap that only grows.
    """
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 22)  # M_MMAP_THRESHOLD: once set it no longer follows what is freed
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        return None
    return libc


def released(run: Callable) -> Callable:
    """``run`` of a worker, with freed memory given back to the machine before its first and after its last batch.

    Workers live on through many stages; what one stage has touched isn't there for the next one else.
    """

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        if (libc := _libc()) is not None:
            libc.malloc_trim(0)

    def over_batches(x: Any) -> Any:
        trim()
        if isinstance(x, pa.Table):
            try:
                return run(x)
            finally:
                trim()
        return stream(x)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return over_batches


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def batch(**columns: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=list(columns))


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column over one flat array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as int64 for arithmetic; a null is -1 there and must be carried beside it where it matters."""
    return np.asarray(column.fill_null(-1).to_numpy(zero_copy_only=False), dtype=np.int64)


def split_rows(table_or_batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for a in range(0, table_or_batch.num_rows, rows):
        yield table_or_batch.slice(a, rows)


def filter_rows(docs: DataFrame, text_col: str, decide: Any) -> DataFrame:
    """The rows of ``docs`` for which ``decide`` yields accepted = True, with their own columns and types.

    ``decide`` maps batches of one column ``text`` to batches with a column ``accepted``, in the same order.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.RecordBatch.from_arrays([b.column(at).cast(pa.string())], names=["text"])
            keep = [r.column("accepted") for r in decide(iter([text]))]
            if keep:
                yield b.filter(pa.concat_arrays(keep))

    return docs.mapInArrow(released(run), docs.schema)
