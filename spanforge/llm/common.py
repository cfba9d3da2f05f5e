"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanforge.sources.shared import written as cut  # noqa: F401  lineage is cut by tables in the shared folder

#: Bytes of text that a task turns into NumPy arrays at a time; a longer text is taken alone.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts come to about ``limit`` bytes; one row at least."""
    text = batch.column(column)
    size = np.zeros(len(text), np.int64)
    if len(text):
        size = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
    total, start = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(size):
        yield batch.slice(start)


_kept: dict[str, dict] = {}


def turn(own: str = "") -> dict:
    """What this worker process keeps for ``own`` from task to task. What it keeps for others is let go: Spark hands a worker on to any operator, and memory that the last one kept would stand beside the next one's."""
    for name in [n for n in _kept if n != own]:
        del _kept[name]
    return _kept.setdefault(own, {}) if own else {}


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and each row's offsets (n + 1) in them; null rows are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text, "").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bounds the bytes that go to a Python worker at a time, for the session: 10,000 rows, Spark's bound, may be pairs of long texts. A bound that the session has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's own
        spark.conf.set(name, f"{size}b")


def sampled(df: DataFrame, key: str, rows: int, spare: int = 8) -> DataFrame:
    """About ``spare * rows`` rows of ``df``, those with the smallest hashes of ``key`` (all of a small table), with the hash as _h.

    The share follows from a count, so what a limit then gathers stays of one size however many partitions there are.
    """
    share = min(1.0, spare * rows / max(1, df.count()))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), key), 11) / F.lit(float(1 << 53))
    return df.withColumn("_h", unit).where(F.col("_h") <= share)
