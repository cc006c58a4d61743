"""Sizes of the batches that Python workers get."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of texts that a worker holds at once, with all that it makes of them.
ROWS = 256


def small_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """Bound the rows of an Arrow batch, so that Python workers stay small however many rows come; a lower bound of the caller's stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, str(rows))
