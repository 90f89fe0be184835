"""Column access shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession


#: Rows in an Arrow batch: texts may be long, and Spark's own 10,000 of them needn't fit in a worker.
ROWS_PER_BATCH = 500


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; from then on the session hands Python at most ``ROWS_PER_BATCH`` rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Freed memory goes back to the system: Python workers live on from task to task, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that ``column`` holds at most about ``limit`` bytes in each."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, min(rows, int(rows * limit / max(size, 1)) or 1))
        for start in range(0, rows, step):
            yield batch.slice(start, step)
    release()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column, null read as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def packed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers, compressed: their bytes by place, as the higher ones hardly change."""
    planes = np.ascontiguousarray(numbers.astype(kind)).view(np.uint8).reshape(len(numbers), np.dtype(kind).itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(data: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    planes = planes.reshape(np.dtype(kind).itemsize, len(planes) // np.dtype(kind).itemsize)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)
