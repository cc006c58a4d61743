"""Folds of event tables by small state machines, composed from ranges of events.

An event is a map from state to state. Maps compose associatively, so a key's
events need not meet: events are sorted by ranges of (key, order), each task
composes the runs of a key in its range into one map, and the few maps of a
key that ranges cut are composed in the order of ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, StructField, StructType

from .written import written


def composed(maps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One map for each run of rows that starts at ``starts``, the first row applied first.

    Neighbours are joined pairwise, all runs at once, until each has one map.
    """
    run = np.zeros(len(maps), np.int64)
    run[starts[1:]] = 1
    run = np.cumsum(run)
    while len(maps) > len(starts):
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        place = np.arange(len(run)) - first[run]
        left = np.flatnonzero(place % 2 == 0)
        paired = (left + 1 < len(run)) & (run[np.minimum(left + 1, len(run) - 1)] == run[left])
        out = maps[left]
        later = maps[left[paired] + 1]
        out[paired] = np.take_along_axis(later, out[paired].astype(np.int64), axis=1)
        maps, run = out, run[left]
    return maps


def _new_run(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; null equals null."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _compose(n_keys: int, states: int):
    """Maps of consecutive rows with equal keys, composed; the columns are keys and ``map``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.RecordBatch | None = None
        for b in batches:
            if carry is not None:
                b = pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for i in range(n_keys):
                new[1:] |= _new_run(b.column(i))
            starts = np.flatnonzero(new)
            maps = b.column(n_keys).flatten().to_numpy(zero_copy_only=False).reshape(-1, states)
            done = composed(maps, starts)
            cols = [b.column(i).take(pa.array(starts)) for i in range(n_keys)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(done) + 1, dtype=np.int32) * states), pa.array(done.ravel().astype(np.int8)))
            out = pa.RecordBatch.from_arrays([*cols, lists.cast(b.schema.field(n_keys).type)], schema=b.schema)
            carry = out.slice(len(done) - 1)
            if len(done) > 1:
                yield out.slice(0, len(done) - 1)
        if carry is not None:
            yield carry

    return run


def final_states(events: DataFrame, keys: list[str], order: str, kind: str, maps: dict[str, list[int]], start: int = 0) -> DataFrame:
    """``state`` of each key after its events, in order (null first), from ``start``.

    ``maps``: for each kind the next state of every state; other kinds change
    nothing. Null keys are keys like others.
    """
    states = len(next(iter(maps.values())))
    step = F.lit(None)
    for name, to in maps.items():
        step = F.when(F.col(kind) == name, F.array(*[F.lit(s) for s in to]).cast("array<tinyint>")).otherwise(step)
    same = F.array(*[F.lit(s) for s in range(states)]).cast("array<tinyint>")
    by = [F.col(k).asc_nulls_first() for k in keys]
    rows = events.select(*keys, F.col(order).alias("_order"), F.coalesce(step, same).alias("map"))
    sliced = rows.repartitionByRange(*by, F.col("_order").asc_nulls_first()).sortWithinPartitions(*by, F.col("_order").asc_nulls_first())
    schema = StructType([*[rows.schema[k] for k in keys], StructField("map", ArrayType(ByteType()))])
    parts = sliced.select(*keys, "map").mapInArrow(_compose(len(keys), states), schema).withColumn("_range", F.spark_partition_id())
    parts = written(parts, "folded")
    again = parts.repartition(*keys).sortWithinPartitions(*by, "_range").select(*keys, "map").mapInArrow(_compose(len(keys), states), schema)
    return again.select(*keys, F.col("map")[start].cast("int").alias("state"))
