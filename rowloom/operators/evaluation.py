"""Gates, rewards and decisions over rows of evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tolerances and bonuses.
FROZEN_TOLERANCE = 0.03
FORGETTING_TOLERANCE = 0.10
TOTAL_GAIN = 0.10
PROBE_GATE = 0.75
GATE_BONUS, STOP_BONUS = 0.05, 0.15
MAX_ROUNDS = 10


def gates(rounds: DataFrame) -> DataFrame:
    """Pass flags, promote and stop of each round.

    Needs probe_acc, champion_probe_acc and base_probe_acc (either may be
    null), old_before, old_after, old_count, forgetting, new_before, new_after.
    """
    error = 1 - F.col("probe_acc")
    rival = F.coalesce(1 - F.col("champion_probe_acc"), 1 - F.col("base_probe_acc"))
    frozen = rival.isNull() | (error - rival <= FROZEN_TOLERANCE)
    old = (F.col("old_count") < 2) | (F.col("forgetting") <= FORGETTING_TOLERANCE)
    gain = F.coalesce(rival - error, F.lit(0.0)) + (F.col("old_after") - F.col("old_before")) + (F.col("new_after") - F.col("new_before"))
    out = rounds.withColumns({"pass_frozen": frozen, "pass_old": old, "total_gain": gain})
    out = out.withColumn("pass_new", F.col("total_gain") > TOTAL_GAIN)
    out = out.withColumn("promote", F.col("pass_frozen") & F.col("pass_old") & F.col("pass_new"))
    return out.withColumns({"pass_probe": F.col("probe_acc") >= PROBE_GATE, "stop": F.col("promote") & (F.col("probe_acc") >= PROBE_GATE)})


def gate_adjustment(rounds: DataFrame) -> DataFrame:
    """Looser gates after three rollbacks in a row, a stricter probe gate when all goes well."""
    loose = F.col("rollback_streak") >= 3
    tight = ~loose & F.col("promote") & (F.col("rollback_streak") == 0) & (F.col("round_id") > 2) & (F.col("mean_acc") > 0.80)
    return rounds.withColumns(
        {
            "frozen_tolerance": F.when(loose, min(0.15, FROZEN_TOLERANCE + 0.03)).otherwise(FROZEN_TOLERANCE),
            "forgetting_tolerance": F.when(loose, min(0.20, FORGETTING_TOLERANCE + 0.05)).otherwise(FORGETTING_TOLERANCE),
            "probe_gate": F.when(tight, min(0.95, PROBE_GATE + 0.05)).otherwise(PROBE_GATE),
            "adjusted": loose | tight,
        }
    )


def reward(rounds: DataFrame) -> DataFrame:
    """Weighted accuracies and gains, with bonuses for promotion and for reaching the target."""
    raw = (
        0.45 * F.col("probe_acc") + 0.25 * F.col("new_after") + 0.15 * F.col("cotest_after")
        + 0.10 * (F.col("new_after") - F.col("new_before")) + 0.05 * (F.col("cotest_after") - F.col("cotest_before"))
    )
    bonus = F.when(F.col("promote"), GATE_BONUS).otherwise(0.0) + F.when(F.col("stop"), STOP_BONUS).otherwise(0.0)
    return rounds.withColumn("raw_reward", raw).withColumn("reward", F.col("raw_reward") + bonus)


def drop_is_small(before: Column, after: Column, n: Column, z: float = 1.64) -> Column:
    """Whether a share fell by no more than ``z`` standard errors of the difference of both, each over ``n`` rows."""
    inside = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    a, b = inside(before), inside(after)
    error = F.sqrt((a * (1 - a) + b * (1 - b)) / F.nullif(n, F.lit(0)))
    return F.coalesce((n > 1) & ((before - after <= 0) | ((error > 0) & (before - after <= z * error))), F.lit(False))


# Falls of the new skill that are borne, and the signals that make a candidate promising.
SMALL_SAMPLE, SMALL_SAMPLE_FALL, FALL = 50, 0.10, 0.02
OLD_GAIN, COTEST_GAIN, COTEST_LEVEL, PROBE_LEVEL, PROBE_LEAD, LEAST_REWARD = 0.05, 0.10, 0.55, 0.30, 0.03, 0.24
# By how much a trend must exceed the best of the rounds before.
TREND = {"probe_acc": 0.03, "cotest_after": 0.10, "raw_reward": 0.03}


def promising(rounds: DataFrame) -> DataFrame:
    """``promising``: safe, with a new skill that does not fall much, and one more signal.

    Needs what :func:`gates` and :func:`reward` give, and new_count.
    """
    gain = F.col("new_after") - F.col("new_before")
    few = (F.col("new_count") > 0) & (F.col("new_count") <= SMALL_SAMPLE) & (gain >= -SMALL_SAMPLE_FALL)
    stable = (gain >= -FALL) | few | drop_is_small(F.col("new_before"), F.col("new_after"), F.col("new_count"))
    signal = (
        (F.col("old_after") - F.col("old_before") >= OLD_GAIN) | (F.col("forgetting") < 0)
        | (F.col("cotest_after") - F.col("cotest_before") >= COTEST_GAIN) | (F.col("cotest_after") >= COTEST_LEVEL)
        | (F.col("probe_acc") >= PROBE_LEVEL) | F.coalesce(F.col("probe_acc") - F.col("champion_probe_acc") >= PROBE_LEAD, F.lit(False))
        | (F.col("raw_reward") >= LEAST_REWARD)
    )
    return rounds.withColumn("promising", F.col("pass_frozen") & F.col("pass_old") & stable & signal)


def positive_trend(rounds: DataFrame) -> DataFrame:
    """``positive_trend``: promising, or well above the best of earlier rounds.

    Needs :func:`promising` and best_probe_acc, best_cotest_after and
    best_raw_reward of earlier rounds, null without any.
    """
    above = [F.coalesce(F.col(c) >= F.col(f"best_{c}") + d, F.lit(False)) for c, d in TREND.items()]
    return rounds.withColumn("positive_trend", F.col("promising") | above[0] | above[1] | above[2])


def inspection(rounds: DataFrame) -> DataFrame:
    """``decision``, in the order of budget, prune, promote, promise and streak; needs :func:`positive_trend`."""
    safe, streak = F.col("pass_frozen") & F.col("pass_old"), F.col("rollback_streak") >= 4
    return rounds.withColumn(
        "decision",
        F.when(F.col("round_id") >= MAX_ROUNDS, F.when(safe, "promote").otherwise("rollback"))
        .when(streak & ~F.col("positive_trend"), "prune")
        .when(safe & F.col("pass_new"), "promote")
        .when(F.col("promising"), "provisional_promote")
        .when(streak, "keep_branch")
        .otherwise("rollback"),
    )


def contract_violations(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Messages whose (type, sender) has rules, none of which allows their receiver."""
    known = rules.select("message_type", "sender").distinct()
    return messages.join(known, ["message_type", "sender"], "left_semi").join(
        rules.select("message_type", "sender", "receiver"), ["message_type", "sender", "receiver"], "left_anti"
    )


def side_by_side(candidate: DataFrame, champion: DataFrame, keys: list[str]) -> DataFrame:
    """Both models' correctness on the same prompts, and whether the candidate won or lost it."""
    a = candidate.select(*keys, F.col("correct").alias("candidate"))
    b = champion.select(*keys, F.col("correct").alias("champion"))
    return a.join(b, keys).withColumns(
        {"gained": F.col("candidate") & ~F.col("champion"), "lost": ~F.col("candidate") & F.col("champion")}
    )
