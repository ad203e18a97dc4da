"""Helpers shared by the operators of this subpackage.

Text operators read the Arrow string column of a batch as one byte buffer, so
that word boundaries, hashes and window minima of thousands of documents are
found by a few numpy passes.  A null text is the empty text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wardlens.sources.sinks import materialize  # noqa: F401  (re-exported for the operators)

TEXT_BATCH_BYTES = 8 << 20  # bytes of text that a task holds as numpy arrays at once
ARROW_BATCH_BYTES = 7 << 20  # bytes of rows that Spark hands to a task's Python side at once


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; bounds the Arrow batches of its session in bytes, unless the session sets a bound of its own.

    Spark's bound counts rows: ten thousand long texts fill a task's memory."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(key, None) is None:
        conf.set(key, str(ARROW_BATCH_BYTES))
    return df


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores appended until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets): text i is ``bytes[offsets[i]:offsets[i + 1]]``; null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    if data is None or not len(col) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, column: str = "text",
           limit: int = TEXT_BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of ``batch`` of about ``limit`` text bytes (one text may be longer): slice, bytes, offsets."""
    data, off = text_bytes(batch.column(column))
    n, at = batch.num_rows, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[off[at]:off[to]], off[at:to + 1] - off[at]
        at = to
