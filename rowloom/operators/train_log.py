"""Summaries and diagnoses of training series (run, seq, step, value columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds of failure by pattern, in order of precedence.
FAILURES = {
    "cuda_oom": r"(?i)out of memory",
    "timeout": r"(?i)\btimed out\b|\btimeout\b|time limit exceeded",
    "no_loadable_model": r"(?i)no loadable model|no model can be loaded|could not load .*model|cannot load .*model",
    "not_found": r"(?i)filenotfounderror|no such file or directory|(?:checkpoint|model|artifact).{0,40}\bnot found\b",
}


def summary(log: DataFrame, value: str, run: str = "run", seq: str = "seq", step: str = "step") -> DataFrame:
    """First, last, extremes with their steps, deviation, slope and trend (5 % of the first value) of each run."""
    rows = log.where(F.col(value).isNotNull())
    at = F.struct(F.col(seq), F.col(step).cast("double").alias("st"), F.col(value).cast("double").alias("v"))
    low = F.struct(F.col(value).cast("double").alias("v"), F.col(seq), F.col(step).cast("double").alias("st"))
    high = F.struct(F.col(value).cast("double").alias("v"), (-F.col(seq)).alias("s"), F.col(step).cast("double").alias("st"))
    out = rows.groupBy(run).agg(
        F.min(at).alias("f"), F.max(at).alias("l"), F.min(low).alias("lo"), F.max(high).alias("hi"),
        F.stddev_pop(F.col(value).cast("double")).alias("std"), F.count("*").alias("count"),
    )
    first, last = F.col("f.v"), F.col("l.v")
    steps = F.col("l.st") - F.col("f.st")
    slope = F.when(steps.isNotNull() & (steps != 0), F.try_divide(last - first, steps)).when(
        F.col("count") > 1, F.try_divide(last - first, F.col("count") - 1)
    )
    margin = F.greatest(F.abs(first) * 0.05, F.lit(1e-12))
    trend = F.when(last < first - margin, "falling").when(last > first + margin, "rising").otherwise("flat")
    return out.select(
        run, first.alias("first"), last.alias("last"), F.col("lo.v").alias("min"), F.col("lo.st").alias("min_at_step"),
        F.col("hi.v").alias("max"), F.col("hi.st").alias("max_at_step"), "std", slope.alias("slope"), trend.alias("trend"), "count",
    )


def _previous(value: str, run: str, seq: str) -> Column:
    return F.lag(value).over(Window.partitionBy(run).orderBy(seq))


def spikes(log: DataFrame, value: str = "loss", run: str = "run", seq: str = "seq", factor: float = 1.20) -> DataFrame:
    """How often a value is over ``factor`` times the one before."""
    rows = log.where(F.col(value).isNotNull()).withColumn("_before", _previous(value, run, seq))
    return rows.groupBy(run).agg(F.count_if(F.col(value) > F.col("_before") * factor).alias("spikes"), F.count("*").alias("count"))


def schedule_shape(log: DataFrame, value: str = "learning_rate", run: str = "run", seq: str = "seq") -> DataFrame:
    """constant, warming_up, decaying or warmup_then_decay."""
    rows = log.where(F.col(value).isNotNull()).withColumn("_before", _previous(value, run, seq))
    up = F.coalesce(F.bool_or(F.col(value) > F.col("_before")), F.lit(False))
    down = F.coalesce(F.bool_or(F.col(value) < F.col("_before")), F.lit(False))
    shape = F.when(up & down, "warmup_then_decay").when(down, "decaying").when(up, "warming_up").otherwise("constant")
    return rows.groupBy(run).agg(shape.alias("shape"), F.count("*").alias("count"))


def phase(train: DataFrame, evals: DataFrame, shapes: DataFrame, run: str = "run") -> DataFrame:
    """The trajectory of each run from the summaries of its series."""
    t = train.select(run, *[F.col(c).alias(f"t_{c}") for c in ("first", "last", "std", "trend", "count")])
    e = evals.select(run, *[F.col(c).alias(f"e_{c}") for c in ("last", "trend", "count")])
    rows = t.join(e, run, "left").join(shapes.select(run, "shape"), run, "left")
    first, last = F.col("t_first"), F.col("t_last")
    gap = F.col("e_last") - last
    flat = (F.col("t_trend") == "flat") | F.coalesce((F.col("e_count") >= 2) & (F.col("e_trend") == "flat"), F.lit(False))
    reduced = F.when(first != 0, (first - last) / F.greatest(F.abs(first), F.lit(1e-12))).otherwise(0.0)
    wild = (F.col("t_trend") == "rising") | (F.col("t_std") > F.greatest(F.abs(first) * 0.35, F.lit(0.35)))
    name = (
        F.when(F.col("t_count") < 2, "insufficient_data")
        .when(wild, "unstable")
        .when(F.coalesce(gap > 0.10, F.lit(False)) & (F.col("t_trend") == "falling"), "overfit_or_distribution_gap")
        .when(flat, "plateau")
        .when(reduced < 0.20, "underfit")
        .when(F.coalesce(F.col("shape") == "warmup_then_decay", F.lit(False)), "warmup_then_decay")
        .when(F.col("t_trend") == "falling", "converging")
        .otherwise("stable")
    )
    return rows.select(run, name.alias("phase"), (flat & (F.col("t_count") >= 2)).alias("plateau"))


def first_failure(lines: DataFrame, run: str = "run", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """The first line of each run that shows a failure, and its kind."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(FAILURES.items()):
        kind = F.when(F.col(line).rlike(pattern), name).otherwise(kind)
    rows = lines.withColumn("kind", kind).where(F.col("kind").isNotNull())
    first = F.min(F.struct(line_no, "kind", line))
    return rows.groupBy(run).agg(first.alias("f")).select(run, F.col("f.kind").alias("kind"), F.col(f"f.{line_no}").alias("line_no"), F.col(f"f.{line}").alias("line"))


def outcome(exit_code: Column, failure: Column, available: Column) -> Column:
    """failed, success or unknown."""
    return F.when((F.coalesce(exit_code, F.lit(0)) != 0) | failure.isNotNull(), "failed").when(available, "success").otherwise("unknown")


def log_events(lines: DataFrame, run: str = "run", line: str = "line") -> DataFrame:
    """Per run: out-of-memory lines, warnings, the largest GPU figure in MB, the last batch size."""
    mb = F.nullif(F.regexp_extract(line, r"(?i)(\d+(?:\.\d+)?)\s*Mi?B", 1), F.lit("")).cast("double")
    batch = F.nullif(F.regexp_extract(line, r"(?i)batch[_ ]size\D{0,3}(\d+)", 1), F.lit("")).cast("long")
    return lines.groupBy(run).agg(
        F.count_if(F.col(line).rlike(FAILURES["cuda_oom"])).alias("oom_lines"),
        F.count_if(F.col(line).rlike("(?i)warn")).alias("warnings"),
        F.max(mb).alias("gpu_mb"),
        F.max_by(batch, F.when(batch.isNotNull(), F.col("line_no"))).alias("batch_size"),
    )
