"""Cutting batches of texts into pieces of bounded size inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows of whole texts go to Python in batches of so many rows and bytes.
BATCH_ROWS = 1000
BATCH_BYTES = "16m"


def runs(texts: pa.Array, size: int = 4_000_000) -> Iterator[pa.Array]:
    """Slices of an array of texts, each of about ``size`` bytes at most or one text.

    An empty array gives one empty slice.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for at, length in enumerate(sizes):
        if held and held + length > size:
            yield texts.slice(start, at - start)
            start, held = at, 0
        held += length
    yield texts.slice(start)


def pieces(text: str, size: int) -> Iterator[str]:
    """A long text in parts of at most ``size`` characters, cut at spaces where there are any."""
    start = 0
    while len(text) - start > size:
        cut = text.rfind(" ", start + 1, start + size)
        cut = cut if cut > start else start + size
        yield text[start:cut]
        start = cut
    yield text[start:]


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: str = BATCH_BYTES) -> None:
    """Set the session's Arrow batches to a size that fits rows of whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
