"""Batches for Python workers: bounded by bytes on their way, and cut where an operator makes much of a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

TEXT_BYTES = 1 << 20  # of texts that are tokenized at once
CELLS = 1 << 20  # of a matrix of scores or distances


def bound_batches(df: DataFrame, most: int = 4 << 20) -> None:
    """From here on the session hands batches of about ``most`` bytes to Python workers, unless it was set to less than
    the default of 64 MB; a worker holds several copies of a batch, and so does the executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark = df.sparkSession
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))  # it may have a unit
    if size >= 64 << 20:
        spark.conf.set(key, str(most))


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of a column take up to ``most`` bytes each (one longer text by itself)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, n = 0, batch.num_rows
        while at < n:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def by_rows(batches: Iterator[pa.RecordBatch], width: int, most: int = CELLS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``width`` numbers a row make up to ``most`` (one row at least)."""
    step = max(1, most // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
