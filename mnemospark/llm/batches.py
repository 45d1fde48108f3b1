"""Small Arrow batches for tables of texts.

Spark sends ten thousand rows at once by default: with texts of a few kilobytes that is tens
of megabytes in the JVM, again in Python, and more as Python objects.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

SENT = 2000
ROWS = 500
_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def send_small(spark: SparkSession) -> None:
    """Batches of at most ``SENT`` rows from here on in this session."""
    now = int(spark.conf.get(_CONF))
    if now <= 0 or now > SENT:
        spark.conf.set(_CONF, SENT)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows``; what a batch held goes back to the system behind it."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        del batch
        pa.default_memory_pool().release_unused()
