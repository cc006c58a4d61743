"""Choices that follow from metrics: search, resources, branches, checks of proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quotas

# Thresholds of the situations, and weights of each change by situation.
HARD_SHARE = 0.80
SITUATIONS = {"repeated_rollback": 3, "high_forgetting": 0.10, "low_probe": 0.75, "low_new_skill": 0.50, "low_cotest": 0.50}
BRANCH_WEIGHTS = {
    "high_forgetting": {"forget_recovery": 1.00, "forgetting_recovery": 0.70, "probe": 0.25, "new_skill": 0.15, "cotest": 0.10},
    "low_probe": {"probe": 1.00, "forget_recovery": 0.25, "new_skill": 0.15, "cotest": 0.10},
    "low_new_skill": {"new_skill": 1.00, "probe": 0.20, "forget_recovery": 0.20, "cotest": 0.10},
    "low_cotest": {"cotest": 1.00, "probe": 0.20, "forget_recovery": 0.20, "new_skill": 0.10},
}
EFFECTS = ("forget_recovery", "forgetting_recovery", "probe", "new_skill", "cotest")
DECISIONS = ("promote", "provisional_promote", "keep_branch", "prune", "rollback")


def situation(rounds: DataFrame) -> DataFrame:
    """``situation`` of each round: the first that holds, empty if none does."""
    s = SITUATIONS
    return rounds.withColumn(
        "situation",
        F.when((F.col("rollback_streak") >= s["repeated_rollback"]) | (F.col("previous_decision") == "prune"), "repeated_rollback")
        .when(F.coalesce("forgetting", F.lit(0.0)) > s["high_forgetting"], "high_forgetting")
        .when(F.coalesce("probe", F.lit(1.0)) < s["low_probe"], "low_probe")
        .when(F.coalesce("new_skill", F.lit(1.0)) < s["low_new_skill"], "low_new_skill")
        .when(F.coalesce("cotest", F.lit(1.0)) < s["low_cotest"], "low_cotest")
        .otherwise(""),
    )


def branch_score(which: str) -> Column:
    """Score of a branch from the columns EFFECTS, reward and decision."""
    bonus = F.when(F.col("decision") == "promote", 0.15).when(F.col("decision").isin("provisional_promote", "keep_branch"), 0.08).otherwise(0.0)
    penalty = F.when(F.col("decision") == "rollback", 0.10).otherwise(0.0)
    reward = F.coalesce("reward", F.lit(0.0))
    if which == "repeated_rollback":
        best = F.greatest("forget_recovery", "probe", "new_skill", "cotest")
        return best + 0.30 * reward + 2.0 * bonus - penalty
    if which not in BRANCH_WEIGHTS:
        return F.lit(0.0)
    return sum((w * F.col(c) for c, w in BRANCH_WEIGHTS[which].items()), 0.20 * reward) + bonus - penalty


def rank_branches(branches: DataFrame, which: str, k: int) -> DataFrame:
    return branches.withColumn("score", branch_score(which)).orderBy(F.col("score").desc(), "seq").limit(k)


def action_evidence(branches: DataFrame, which: str, most: float = 0.25) -> DataFrame:
    """Per action: supporting and failed branches, and mean score within bounds."""
    scored = branches.withColumn("score", branch_score(which))
    return scored.groupBy("action_key").agg(
        F.count_if((F.col("score") > 0) & (F.col("decision") != "rollback")).alias("support"),
        F.count_if((F.col("score") <= 0) | (F.col("decision") == "rollback")).alias("failures"),
        F.least(F.greatest(F.avg("score"), F.lit(-most)), F.lit(most)).alias("evidence"),
    )


def difficulty_feedback(hard_share: float, n: int, target: str = "") -> dict:
    """Target and weights after a batch; easier when hard rows prevail."""
    hard = n > 0 and hard_share >= HARD_SHARE
    return {
        "target": "medium" if hard else target,
        "policy": "merge_or_replace" if hard else "single_shard",
        "weights": {"easy": 0.25, "medium": 0.60, "hard": 0.15} if hard else {"easy": 0.15, "medium": 0.70, "hard": 0.15},
    }


def search_policy(goal: str, round_id: int, hard_share: float, train_short: bool, accuracy: dict[str, float], default: str = "medium") -> dict:
    """What to look for next: the goal first, then relief of the data's pressure, then the weakest difficulty."""
    if round_id <= 0:
        return {"query": goal.strip(), "target": "", "weights": {}, "policy": "single_shard"}
    if hard_share >= HARD_SHARE:
        return {"query": f"{goal.strip()} medium", "target": "medium", "weights": {"easy": 0.35, "medium": 0.55, "hard": 0.10}, "policy": "merge_or_replace"}
    if train_short:
        return {"query": f"{goal.strip()} medium", "target": "medium", "weights": {"easy": 0.25, "medium": 0.60, "hard": 0.15}, "policy": "merge_shards"}
    weakest = min(accuracy, key=lambda k: (accuracy[k], k)) if accuracy else default
    return {"query": goal.strip(), "target": weakest, "weights": quotas.deficits(accuracy) if accuracy else {}, "policy": "single_shard"}


def resources(logs: DataFrame) -> DataFrame:
    """Batch size, accumulation and sample cap from ``oom_lines`` and the current values of each run."""
    several, any_oom = F.col("oom_lines") >= 3, F.col("oom_lines") >= 1
    half = F.greatest(F.lit(1), F.floor(F.col("batch") / 2)).cast("long")
    return logs.withColumns(
        {
            "action": F.when(several, "reduce_samples").when(any_oom, "reduce_batch").otherwise("keep"),
            "new_batch": F.when(any_oom, half).otherwise(F.col("batch")),
            "new_accumulation": F.when(any_oom, F.col("accumulation") * 2).otherwise(F.col("accumulation")),
            "new_samples": F.when(several, F.greatest(F.lit(100), F.floor(F.col("samples") / 2)).cast("long")).otherwise(F.col("samples")),
        }
    )


def proposal_errors(proposals: DataFrame, actions: list[str]) -> DataFrame:
    """``errors`` of proposed decisions (all columns text): unknown actions and decisions, shares outside 0..1."""

    def share(name: str) -> list[Column]:
        v = F.col(name).try_cast("double")
        return [
            F.when(F.col(name).isNotNull() & v.isNull(), f"{name}_not_number"),
            F.when((v < 0) | (v > 1), f"{name}_out_of_range"),
        ]

    checks = [
        F.when(F.col("action_key").isNull(), "missing_action_key"),
        F.when(~F.col("action_key").isin(*actions), "invalid_action_key"),
        F.when(~F.col("decision").isin(*DECISIONS), "invalid_decision"),
        *share("replay_ratio"),
        *share("confidence"),
    ]
    return proposals.withColumn("errors", F.array_compact(F.array(*checks)))


def worst_questions(failures: DataFrame, accuracy: DataFrame, n: int = 20) -> DataFrame:
    """Failures of the weakest difficulty first, then others, ``n`` in all."""
    weakest = accuracy.orderBy("accuracy", "difficulty").limit(1).select("difficulty", F.lit(0).alias("_tier"))
    return failures.join(weakest, "difficulty", "left").orderBy(F.coalesce("_tier", F.lit(1)), "seq").limit(n).drop("_tier")


def needs_rerollout(accuracy: Column, cached: Column, age: Column, gain: float, every: int | None = None) -> Column:
    """Whether labels are stale: accuracy rose by ``gain``, or they are ``every`` rounds old."""
    better = (accuracy - cached) >= gain
    return (better | (age >= every)) if every else better


def focus_counts(failures: DataFrame, module: str = "module") -> DataFrame:
    """Failures by module; those without a known one do not count."""
    known = F.coalesce(F.col(module), F.lit(""))
    return failures.where((known != "") & (known != "unknown")).groupBy(F.col(module).alias("module")).agg(F.count("*").alias("n"))


def set_error(questions: DataFrame, verdicts: DataFrame, key: str, order: str, most: int = 50) -> DataFrame:
    """``errors``, ``error_rate`` and ``n`` over the first ``most`` questions; one without a verdict (key, correct) is an error.

    No questions make no errors.
    """
    first = questions.orderBy(order).limit(most).select(key)
    one = first.join(verdicts.groupBy(key).agg(F.max("correct").alias("correct")), key, "left")
    out = one.agg(F.count_if(~F.coalesce("correct", F.lit(False))).alias("errors"), F.count("*").alias("n"))
    return out.select("errors", F.coalesce(F.try_divide("errors", "n"), F.lit(0.0)).alias("error_rate"), "n")


def set_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """``forgetting`` (rise of the error rate on what was known) and ``gain`` (its fall on new questions), of one-row tables (old_error, new_error)."""
    a = before.select(F.col("old_error").alias("_o"), F.col("new_error").alias("_n"))
    both = a.withColumn("_one", F.lit(1)).join(after.withColumn("_one", F.lit(1)), "_one")
    return both.select(F.greatest(F.lit(0.0), F.col("old_error") - F.col("_o")).alias("forgetting"), (F.col("_n") - F.col("new_error")).alias("gain"))
