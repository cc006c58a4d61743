"""Repeated attempts per question: scores, histograms, difficulty, mastery.

Attempts are rows (question_id, rollout_idx, correct, ...).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked

# Passes out of eight that make a question easy or medium, before and from round 5.
THRESHOLDS = {"early": (5, 2), "late": (8, 4)}
LATE_ROUND = 5
TRIES = 8
MASTERED_SHARE = 0.75


def scores(attempts: DataFrame, *firsts: str) -> DataFrame:
    """Per question: flags in order, passes, tries, rate, first vote that is not unknown, first values of ``firsts``."""
    order = "rollout_idx"
    flags = F.transform(F.array_sort(F.collect_list(F.struct(order, "correct"))), lambda s: s["correct"])
    aggregates = [
        flags.alias("correct_flags"),
        F.count_if("correct").alias("pass_count"),
        F.count("*").alias("rollout_count"),
        *[F.min_by(c, order).alias(c) for c in firsts],
    ]
    if "vote" in attempts.columns:
        sure = F.col("vote").isNotNull() & (F.col("vote") != "unknown")
        aggregates.append(F.coalesce(F.min_by(F.when(sure, F.col("vote")), F.when(sure, F.col(order))), F.lit("unknown")).alias("vote"))
    out = attempts.groupBy("question_id").agg(*aggregates)
    return out.withColumn("pass_rate", F.col("pass_count") / F.col("rollout_count"))


def pass_histogram(scored: DataFrame, tries: int = TRIES) -> DataFrame:
    """Questions by passes 0..tries, empty bins included; other numbers of tries are rescaled half-even."""
    own = F.bround(F.col("pass_count") * tries / F.col("rollout_count"), 0).cast("int")
    counts = scored.groupBy(F.least(F.greatest(own, F.lit(0)), F.lit(tries)).alias("passes")).agg(F.count("*").alias("n"))
    bins = scored.sparkSession.range(tries + 1).select(F.col("id").cast("int").alias("passes"))
    return bins.join(counts, "passes", "left").select(
        F.concat_ws("/", "passes", F.lit(tries)).alias("bin"), "passes", F.coalesce("n", F.lit(0)).alias("n")
    )


def thresholds(tries: int = TRIES, round_id: int | None = None) -> tuple[int, int]:
    """Passes for easy and for medium, kept within the number of tries."""
    late = round_id is not None and round_id >= LATE_ROUND
    easy, medium = THRESHOLDS["late" if late else "early"]
    if tries <= 1:
        return 1, 1
    medium = min(max(1, medium), tries)
    return min(max(medium + 1, easy), tries), medium


def threshold_policy(histogram: DataFrame, tries: int = TRIES, round_id: int | None = None) -> DataFrame:
    """One row (easy_min, medium_min, reason) from a pass histogram.

    Medium begins at two passes when a quarter of the questions is in between
    and fewer than 70 % pass at most once.
    """
    easy, medium = thresholds(tries, round_id)
    total = F.sum("n")
    low = F.try_divide(F.sum(F.when(F.col("passes") <= 1, F.col("n")).otherwise(0)), total)
    border = F.try_divide(F.sum(F.when(F.col("passes").between(2, easy - 1), F.col("n")).otherwise(0)), total)
    one = histogram.agg(F.coalesce(low, F.lit(0.0)).alias("low"), F.coalesce(border, F.lit(0.0)).alias("border"))
    relax = (F.col("border") >= 0.25) & (F.col("low") < 0.70) & (tries > 1)
    return one.select(
        F.lit(easy).alias("easy_min"),
        F.when(relax, max(1, min(medium, 2))).otherwise(medium).alias("medium_min"),
        F.when(relax, "relaxed").when((F.col("low") >= 0.70) & (tries > 1), "mostly_impossible").otherwise("canonical").alias("reason"),
    )


def difficulty(passes: Column, tries: Column, easy: int, medium: int) -> Column:
    return F.when(tries <= 0, "unknown").when(passes >= easy, "easy").when(passes >= medium, "medium").otherwise("hard")


def stage_difficulty(correct: Column, stage: Column) -> Column:
    """Hard if wrong; easy if right at once, medium if right after thinking."""
    return F.when(~correct, "hard").when(stage == "answer_only", "easy").when(stage == "thinking", "medium").otherwise("unknown")


def cascade(first: DataFrame, second: DataFrame) -> DataFrame:
    """Results of two stages; the second counts for questions that failed the first."""
    again = second.select("question_id", F.col("correct").alias("later"))
    out = first.join(again, "question_id", "left")
    won = F.col("correct") | F.coalesce("later", F.lit(False))
    stage = F.when(F.col("correct") | F.col("later").isNull(), "answer_only").otherwise("thinking")
    return out.select("question_id", won.alias("correct"), stage.alias("rollout_stage"), stage_difficulty(won, stage).alias("difficulty"))


def mastery_threshold(tries: Column, usual: int = TRIES, share: float = MASTERED_SHARE) -> Column:
    """Passes that show mastery: fixed for the usual number of tries, else that share rounded up."""
    fixed = max(1, math.floor(usual * share + 0.999999))
    needed = F.when(tries == usual, fixed).otherwise(F.floor(tries * share + 0.999999))
    return F.least(F.greatest(F.lit(1), needed), F.greatest(F.lit(1), tries))


def mastered(scored: DataFrame, usual: int = TRIES) -> DataFrame:
    return scored.where(F.col("pass_count") >= mastery_threshold(F.col("rollout_count"), usual))


def pass_at_k(attempts: DataFrame) -> DataFrame:
    """One row: questions, share with at least one pass, mean pass rate."""
    s = scores(attempts)
    return s.agg(
        F.count("*").alias("n"), F.avg((F.col("pass_count") > 0).cast("double")).alias("pass_at_k"), F.avg("pass_rate").alias("mean_rate")
    )


def accuracy(predictions: DataFrame, *by: str) -> DataFrame:
    """Share of correct predictions, in all or by columns; 0 without any."""
    own = F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("accuracy")
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), own)


def shard(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """``shard`` 0.. of contiguous rows of nearly equal number, null ``order`` last.

    Places come from ranges that are cut and written once (:func:`ranks.ranked`): ranges cut again are others.
    """
    placed, sizes = ranked(rows.withColumn("_by", F.struct(F.col(order).isNull(), F.col(order))), [], "_by")
    out = placed.crossJoin(F.broadcast(sizes.withColumnRenamed("n", "_total"))).withColumn("shard", F.expr(f"(_place - 1) * {int(shards)} div _total"))
    return out.select(*rows.columns, "shard")
