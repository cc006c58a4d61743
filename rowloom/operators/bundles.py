"""The training bundle: filters, splits and the manifest in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dedup, overlap, sampling, splits


def manifest(rows: DataFrame, *axes: str) -> DataFrame:
    """Row counts in all, by split, and by split and each axis."""
    own = ", ".join(f"(split, {a})" for a in axes)
    names = ", ".join(("split", *axes))
    rows.createOrReplaceTempView("rowloom_bundle")
    return rows.sparkSession.sql(f"select {names}, count(*) as n from rowloom_bundle group by grouping sets ((), (split), {own})")


def pressure(rows: DataFrame, difficulty: str = "difficulty") -> DataFrame:
    """Whether hard rows prevail, and whether training rows are too few."""
    one = rows.agg(F.count("*").alias("n"), F.count_if(F.col(difficulty) == "hard").alias("hard"), F.count_if(F.col("split") == "train").alias("train"))
    return one.select("n", "hard", "train", (F.try_divide("hard", "n") >= 0.80).alias("hard_dominated"), (F.col("train") < 64).alias("train_short"))


def build(
    questions: DataFrame,
    registry: DataFrame,
    quotas: DataFrame,
    keys: list[str],
    ratios: dict[str, float],
    total: int,
    row_id: str = "question_id",
    order: str = "seq",
) -> DataFrame:
    """Questions that no holdout blocks, deduplicated, sampled by plan, split and carved; with ``split``."""
    free = overlap.registry_block(questions, registry, overlap.TRAIN_BLOCKING)
    single = dedup.first_wins(free, ["text_hash"], order)
    chosen = sampling.plan_sample(single, quotas, keys, row_id, total)
    split = splits.stratified_split(chosen, keys, order, ratios)
    train = splits.validation_carve(split.where("split = 'train'"), order)
    return train.unionByName(split.where("split <> 'train'").select(*train.columns))
