"""First, last and best of rows with equal keys; merges of event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spread import looked_up
from .written import forget, written

# Registry statuses by rank, the highest wins.
STATUS_RANK = {"external_probe": 5, "probe_holdout": 4, "active_holdout": 3, "retired_holdout": 2, "train_seen": 1}
REGISTRY_KEY = (
    "source_dataset_id", "source_dataset_subset", "source_dataset_split", "source_dataset_row_id", "question_id", "text_hash",
)


def _ranked(rows: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_wins(rows: DataFrame, keys: list[Column | str], order: str) -> DataFrame:
    """The first row of each key."""
    return _ranked(rows, keys, [F.col(order)]).where("_place = 1").drop("_place")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; rows with a blank key all stay, and meet in no task."""
    blank = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    return _ranked(rows.where(~blank), [key], [F.col(order).desc()]).where("_place = 1").drop("_place").unionByName(rows.where(blank))


def first_by_any_key(rows: DataFrame, keys: str, order: str) -> DataFrame:
    """Rows none of whose keys (array ``keys``) an earlier kept row has; ``order`` is unique and not null.

    A row that is dropped does not close its keys: with rows ab, bc, c the
    last stays. In rounds, a row is kept once it is the first undecided one by
    each of its keys, and those that share a key with a kept row go. Nearly
    all rows are decided in the first rounds; a chain of n rows, each sharing
    a key with the next, takes n / 2. Rows without a key stay.
    """
    own = F.array_distinct(F.array_compact(keys))
    flat = rows.select(F.col(order).alias("o"), F.explode(own).alias("k"), F.size(own).alias("n"))
    left, kept = written(flat, "keys"), []
    while not left.isEmpty():
        firsts = left.groupBy("k").agg(F.min(F.struct("o", "n")).alias("f")).select("k", "f.o", "f.n")
        firsts = written(firsts, "firsts")
        won = written(firsts.groupBy("o", "n").agg(F.count("*").alias("c")).where("c = n").select("o"), "won")
        kept.append(won)
        closed = firsts.join(won, "o", "left_semi").select("k")
        gone = looked_up(left.select("k", "o"), closed, "k", F.col("o"), "inner").select("o").distinct()
        rest = written(left.join(gone, "o", "left_anti"), "keys")
        forget(left, firsts)
        left = rest
    bare = rows.where(F.coalesce(F.size(own), F.lit(0)) <= 0)
    if not kept:
        return bare
    chosen = reduce(DataFrame.unionByName, kept).withColumnRenamed("o", order)
    return rows.join(chosen, order, "left_semi").unionByName(bare)


def status_rank(status: Column) -> Column:
    out = F.lit(0)
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def registry_state(events: DataFrame) -> DataFrame:
    """One row for each registry key: the highest status, the later event on ties."""
    filled = events.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in REGISTRY_KEY})
    return _ranked(filled, list(REGISTRY_KEY), [status_rank(F.col("status")).desc(), F.col("seq").desc()]).where("_place = 1").drop("_place")


def registry_append(events: DataFrame, more: DataFrame) -> DataFrame:
    """The state after more events."""
    return registry_state(events.unionByName(more, allowMissingColumns=True))


def union_new(known: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``known`` and the rows of ``more`` whose keys it lacks."""
    return known.unionByName(more.join(known.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def bounded_append(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The first ``most`` rows."""
    return rows.orderBy(order).limit(most)


def ids_by_group(rows: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """Each group's distinct ids in the order of first sight."""
    firsts = rows.groupBy(group, key).agg(F.min(order).alias("o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", key))), lambda s: s[key])
    return firsts.groupBy(group).agg(listed.alias("ids"))


def mode_first_seen(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Each group's most common value; ties go to the value seen first."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    best = F.max(F.struct(F.col("n"), (-F.col("o")).alias("o"), F.col(value).alias("v")))
    return counts.groupBy(*group).agg(best.alias("b")).select(*group, F.col("b.v").alias(value), F.col("b.n").alias("n"))
