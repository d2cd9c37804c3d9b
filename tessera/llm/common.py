"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import stage_derived, table

#: Rows of one slice of an Arrow batch that a task works on at a time.
SLICE_ROWS = 256


def text_bytes(name: str = "text") -> Column:
    """A text column as UTF-8 bytes, which Python gets without decoding."""
    return F.col(name).cast("string").cast("binary")


def fold(name: str, parts: int) -> Column:
    """Remainder of crc32 of a value as text; a NULL value gives NULL."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % parts


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of few rows, so that work space stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def fields(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def thinned(rows: DataFrame, target: int) -> DataFrame:
    """About ``target`` rows, or all if there are fewer, chosen by a hash of ``doc_id``."""
    count = rows.count()
    if count <= target:
        return rows
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(target / count * (1 << 31)))


def bounded_sample(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows, chosen by a hash of their id.

    The choice depends on the ids alone, so it is the same on every run. Tasks
    send about twice the sample between them, the driver collects the sample
    (``rows`` is its bound) and hands it back as a small frame that any join
    may broadcast.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id"), *[F.col(c) for c in labels.columns if c != "doc_id"]]
    chosen = thinned(labels, 2 * rows).orderBy(*order).limit(rows).collect()
    return labels.sparkSession.createDataFrame(chosen, labels.schema)


__all__ = [
    "SLICE_ROWS", "Column", "DataFrame", "SparkSession", "bounded_sample", "fields", "fold",
    "list_array", "slices", "stage_derived", "table", "text_bytes", "thinned",
]
