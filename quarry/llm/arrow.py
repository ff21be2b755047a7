"""Arrow batches in and out of Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession

#: Bytes of text that one output batch covers at most, unless one text is longer.
BATCH_BYTES = 2_000_000
#: Bytes of an Arrow batch between the JVM and a Python worker, and Spark's setting for that.
ARROW_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Let no Arrow batch of this session be larger than ARROW_BYTES, but for a single longer row: Spark's own bound is
    64 MB, which each running task would hold several times over."""
    if _bytes(spark.conf.get(BATCH_CONF, "64m")) > ARROW_BYTES:
        spark.conf.set(BATCH_CONF, f"{ARROW_BYTES}b")


def _bytes(size: str) -> int:
    number, unit = size.lower().rstrip("b") or "0", 1
    if number[-1] in "kmg":
        number, unit = number[:-1], 1024 ** (1 + "kmg".index(number[-1]))
    return int(number) * unit if int(number) > 0 else 1 << 62


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts in each have about BATCH_BYTES; a longer text comes alone."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64)
            cut = np.flatnonzero(np.diff(np.cumsum(size) // BATCH_BYTES)) + 1
            at = [0, *cut.tolist(), batch.num_rows]
            for a, b in zip(at, at[1:]):
                if b > a:
                    yield batch.slice(a, b - a)
    finally:
        pa.default_memory_pool().release_unused()  # a worker lives on between tasks


def text_list(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch, empty for null."""
    return [x or "" for x in batch.column(text).to_pylist()]


def byte_list(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts of a batch in UTF-8, empty for null."""
    column = batch.column(text)
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
