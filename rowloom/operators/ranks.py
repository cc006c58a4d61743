"""Row numbers within groups without one task for a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .written import forget, written


def ranked(rows: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_place``, 1.. within each group by ``order`` (null first); and each group's size as (keys, n).

    ``rows`` are computed and written once, then sorted by ranges of (keys,
    order), of any type; a row's place is its number in its range after what
    the ranges before hold of its group. Null keys are a group like others.
    Give only the columns that are needed.
    """
    by = [*[F.col(k).asc_nulls_first() for k in keys], F.col(order).asc_nulls_first()]
    base = written(rows, "rows")
    ranged = base.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("_range", F.shiftright("_at", 33)), "ranges")
    forget(base)
    names = [*keys, "_range"]
    parts = ranged.groupBy(*names).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(names)], (F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = reduce(lambda a, b: a & b, [ranged[k].eqNullSafe(starts[f"_of_{i}"]) for i, k in enumerate(names)])
    out = ranged.join(starts, same).withColumn("_place", F.col("_at") + F.col("_shift"))
    return out.select(*rows.columns, "_place"), ranged.groupBy(*keys).agg(F.count("*").alias("n"))


def placed(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of :func:`ranked`."""
    return ranked(rows, keys, order)[0]
