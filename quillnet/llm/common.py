"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.graph import _table

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 2 << 20
#: Bytes of a batch on its way to a Python worker; Spark itself counts rows only, whatever their length.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers by bytes, where the session does not bound them (the setting stays, as plans run later)."""
    if not spark.conf.get(BATCH_SETTING, None):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the folder that all executors share and read it back, which cuts its lineage."""
    return _table(df, name)


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those of these names, whatever their case."""
    return [c for c in df.columns if c.lower() not in names]


def quoted(names: list[str]) -> list:
    """Columns by their names, which may hold any character."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def widened(df: DataFrame, names: list[str], more: str) -> StructType:
    """The schema of these columns of ``df`` and of the columns in ``more``."""
    return StructType([df.schema[c] for c in names] + StructType.fromDDL(more).fields)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list:
    """Two columns that identify a row by content, also where ``doc_id`` is null or repeated.

    Rows with equal keys are repeated rows and get equal results.
    """
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("_qn_k0"), F.xxhash64(F.col(doc_id).isNull(), F.col(text)).alias("_qn_k1")]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``limit`` bytes of text each; a single longer text stays whole."""
    col = batch.column(column)
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


_HELD: dict = {}


def held(name: str, make: Callable[[], object]) -> object:
    """A worker's one large object, such as a coder with its caches, kept from task to task of the same operator."""
    if name not in _HELD:
        release(name)
        _HELD[name] = make()
    return _HELD[name]


def release(but: str | None = None) -> None:
    """Drop what tasks of other operators have left in a reused worker, and give the memory back."""
    if any(k != but for k in _HELD):
        for k in [k for k in _HELD if k != but]:
            del _HELD[k]
        gc.collect()
        trim()


@lru_cache(maxsize=1)
def frugal() -> None:
    """Large arrays of this worker live in pages of their own, which go back to the system as soon as they are freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        # of glibc's malloc.h: M_TRIM_THRESHOLD, M_MMAP_THRESHOLD, M_ARENA_MAX
        for name, value in ((-1, 8 << 20), (-3, 4 << 20), (-8, 2)):
            libc.mallopt(name, value)


def trim() -> None:
    """Give freed memory back to the system; a worker that waits for its next task then holds only what it keeps."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, column: str = "text", limit: int = SLICE_BYTES, holds: str | None = None) -> DataFrame:
    """``mapInArrow`` with batches cut to a bounded number of text bytes; ``holds`` names the large object that the tasks keep."""

    bounded_batches(df.sparkSession)
    # columns travel under plain names, as theirs may hold any character
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, plain_out = df.columns, [f"o{k}" for k in range(len(schema))]
    plain = StructType([StructField(n, f.dataType, True) for n, f in zip(plain_out, schema.fields, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        release(holds)
        for batch in batches:
            for piece in slices(pa.RecordBatch.from_arrays(batch.columns, names), column, limit):
                if (out := fn(piece)) is not None:
                    yield pa.RecordBatch.from_arrays(out.columns, plain_out)
        batch = piece = out = None
        trim()

    return df.toDF(*[f"i{k}" for k in range(len(names))]).mapInArrow(run, plain).toDF(*schema.names)


def texts_as_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def concatenated(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column as one array, and the offsets of its rows; null is empty."""
    arr = pc.fill_null(col.cast(pa.large_binary()), b"")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(arr) else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]
