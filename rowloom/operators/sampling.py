"""Deterministic samples: hash order stands in for shuffles.

Takes per group keep ranks up to a literal, the largest quota, so that Spark
cuts every group down within each task before it shuffles and ranks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import hash_order
from .dedup import first_wins, last_wins
from .quotas import capped_table
from .ranks import ranked


def take_per_group(rows: DataFrame, quotas: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first ``quota`` rows of each group by ``order``."""
    most = quotas.agg(F.max("quota")).first()[0] or 0
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    few = rows.withColumn("_place", place).where(F.col("_place") <= most)
    return few.join(quotas.select(*keys, "quota"), keys).where("_place <= quota").drop("_place", "quota")


def plan_sample(rows: DataFrame, quotas: DataFrame, keys: list[str], row_id: str, total: int, seed: str = "plan") -> DataFrame:
    """Quotas by group, topped up from all other rows to ``total``."""
    order = hash_order(seed, F.col(row_id))
    first = take_per_group(rows, quotas, keys, order)
    rest = rows.join(first.select(row_id), row_id, "left_anti")
    both = first.withColumn("_tier", F.lit(0)).unionByName(rest.withColumn("_tier", F.lit(1)))
    return both.orderBy("_tier", order).limit(total).drop("_tier")


def supplement(pool: DataFrame, lacking: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of other pools up to each key's shortfall, in order."""
    quotas = lacking.select(key, F.col("shortfall").alias("quota"))
    return take_per_group(pool, quotas, [key], F.struct(*order))


def round_robin(rows: DataFrame, group: str, row_id: str, total: int, seed: str = "probe") -> DataFrame:
    """One row of each group in turn until there are ``total``."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, F.col(row_id))))
    # no group gives more than the total
    return rows.withColumn("turn", place).where(F.col("turn") <= total).orderBy("turn", group).limit(total)


def focus_sample(rows: DataFrame, tier: Column, row_id: str, total: int, share: float = 0.7, seed: str = "focus") -> DataFrame:
    """Up to ``share`` of ``total`` from focused rows (tier under 3), the rest in hash order."""
    order = hash_order(seed, F.col(row_id))
    tiered = rows.withColumn("_tier", tier)
    focused = tiered.where("_tier < 3").orderBy("_tier", order).limit(int(total * share))
    rest = tiered.join(focused.select(row_id), row_id, "left_anti").orderBy(order).limit(total)
    both = focused.withColumn("_first", F.lit(0)).unionByName(rest.withColumn("_first", F.lit(1)))
    return both.orderBy("_first", "_tier", order).limit(total).drop("_tier", "_first")


def newest_versions(entries: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The newest version of each id, all rows with a blank id, newest first, at most ``most``."""
    return last_wins(entries, key, order).orderBy(F.col(order).desc()).limit(most)


def least_used(entries: DataFrame, bucket: str, n: int, row_id: str, target: str = "", seed: str = "replay") -> DataFrame:
    """``n`` replay entries: unused of the target bucket, unused others, then the target's and others' least and longest unused."""
    used = F.size("used_in_rounds")
    own = (F.col(bucket) == target) if target else F.lit(True)
    tier = F.when((used == 0) & own, 0).when(used == 0, 1).when(own, 2).otherwise(3)
    last = F.coalesce(F.array_max("used_in_rounds"), F.lit(-1))
    return entries.orderBy(tier, used, last, hash_order(seed, F.col(row_id))).limit(n)


def replay_mix(new: DataFrame, replay: DataFrame, ratio: float, bucket: str, row_id: str, target: str = "") -> DataFrame:
    """New rows with replayed ones, ``ratio`` of their number, each with its role."""
    n = min(replay.count(), int(new.count() * ratio))
    again = least_used(replay, bucket, n, row_id, target).withColumn("source_role", F.lit("replay"))
    return new.withColumn("source_role", F.lit("new")).unionByName(again, allowMissingColumns=True)


def admit(buffer: DataFrame, candidates: DataFrame, key: str, score: str, order: str, most: int = 1000) -> DataFrame:
    """The buffer with new ids added, the best ``most`` by score, earlier rows first on ties."""
    more = candidates.join(buffer.select(key), key, "left_anti")
    return buffer.unionByName(more).orderBy(F.col(score).desc(), F.col(order)).limit(most)


def hardest(rows: DataFrame, rate: str, row_id: str, most: int = 200) -> DataFrame:
    return rows.orderBy(F.col(rate), F.col(row_id)).limit(most)


def filled(
    rows: DataFrame, quotas: DataFrame, bucket: str, tier: str, row_id: str, seed: str = "fill", shares: tuple[tuple[str, int], ...] = (("easy", 2), ("hard", 1))
) -> DataFrame:
    """row_id, bucket, tier and ``taken_as`` of rows up to each bucket's ``quota``.

    A bucket's quota is met from its first tier; what that lacks is carried to
    the next. What all tiers lack, over all buckets, is filled from rows of
    the first tier that are left (``taken_as`` backfill): from the first bucket
    of ``shares`` by its part of all parts, rounded down, from the next what
    then lacks, and so on, as far as there are rows. Ranks are taken once; the
    rest is arithmetic over a table of (bucket, tier), part of the same plan.
    """
    own = rows.select(row_id, bucket, tier).withColumn("_hash", hash_order(seed, F.col(row_id)))
    ranks, sizes = ranked(own, [bucket, tier], "_hash")
    have = sizes.withColumnRenamed("n", "have").join(quotas.select(bucket, "quota"), bucket, "full").fillna(0, ["have", "quota"])
    earlier = Window.partitionBy(bucket).orderBy(tier).rowsBetween(Window.unboundedPreceding, -1)
    lack = F.greatest(F.lit(0), F.col("quota") - F.coalesce(F.sum("have").over(earlier), F.lit(0)))
    have = have.withColumn("take", F.least("have", lack))
    supply = F.sum("have").over(Window.partitionBy(bucket))
    # every bucket counts once: at its first tier
    first = F.row_number().over(Window.partitionBy(bucket).orderBy(F.col(tier).asc_nulls_last())) == 1
    have = have.withColumns({"_lack": F.when(first, F.greatest(F.lit(0), F.col("quota") - supply)).otherwise(0), "_least": F.min(tier).over(Window.partitionBy())})
    have = have.withColumns({"lacking": F.sum("_lack").over(Window.partitionBy()), "spare": F.when(F.col(tier) == F.col("_least"), F.col("have") - F.col("take")).otherwise(0)})
    parts, given, extra = sum(n for _, n in shares), F.lit(0), F.lit(0)
    for i, (name, n) in enumerate(shares):
        spare = F.sum(F.when(F.col(bucket) == name, F.col("spare")).otherwise(0)).over(Window.partitionBy())
        wanted = F.floor(F.col("lacking") * n / parts) if i < len(shares) - 1 else F.col("lacking") - given
        mine = F.least(spare, wanted)
        extra = F.when((F.col(bucket) == name) & (F.col(tier) == F.col("_least")), mine).otherwise(extra)
        given = given + mine
    takes = have.select(bucket, tier, "take", extra.alias("extra"))
    out = ranks.join(takes, [bucket, tier]).where(F.col("_place") <= F.col("take") + F.col("extra"))
    return out.select(row_id, bucket, tier, F.when(F.col("_place") <= F.col("take"), "quota").otherwise("backfill").alias("taken_as"))


def round_sample(
    rows: DataFrame,
    total: int,
    bucket_weights: DataFrame | None = None,
    module_weights: DataFrame | None = None,
    mastered: DataFrame | None = None,
    focus: DataFrame | None = None,
    row_id: str = "question_id",
    order: str = "seq",
    seed: str = "round",
) -> DataFrame:
    """The rows of a round: row_id, difficulty, module and ``tier``, at most ``total``.

    ``rows``: (row_id, order, dedup_key, difficulty, module). The first row of
    each dedup key stays, mastered ids go. With ``bucket_weights`` (difficulty,
    weight) every difficulty has a quota within its supply, shared out to
    modules by ``module_weights`` (module, weight); tier 0 are rows within the
    quota of their module, tier 1 others that fill the quota of their
    difficulty, tier 2 the rest. Without weights, or without a row of a known
    difficulty, rows whose module is in ``focus`` (module) are tier 0, others
    tier 1. Rows are taken by tier, then in hash order.
    """
    pool = first_wins(rows.select(row_id, order, "dedup_key", "difficulty", "module"), ["dedup_key"], order)
    if mastered is not None:
        pool = pool.join(mastered.select(row_id).distinct(), row_id, "left_anti")
    pool = pool.select(row_id, F.coalesce(F.nullif("difficulty", F.lit("")), F.lit("unknown")).alias("difficulty"), F.coalesce(F.nullif("module", F.lit("")), F.lit("unknown")).alias("module"))
    pool = pool.withColumn("_hash", hash_order(seed, F.col(row_id)))
    if bucket_weights is not None:
        ranks, sizes = ranked(pool, ["difficulty", "module"], "_hash")
        sizes = sizes.withColumnRenamed("n", "available")
        by_bucket = sizes.groupBy("difficulty").agg(F.sum("available").alias("available")).join(bucket_weights.select("difficulty", "weight"), "difficulty")
        buckets = capped_table(by_bucket, total, "difficulty").select("difficulty", F.col("quota").alias("bucket_quota"))
        if module_weights is not None:
            cells = sizes.join(buckets, "difficulty").join(module_weights.select("module", "weight"), "module")
            cells = capped_table(cells, "bucket_quota", "module", ["difficulty"]).select("difficulty", "module", "quota")
        else:
            cells = sizes.select("difficulty", "module", F.lit(0).cast("long").alias("quota"))
        ranks = ranks.join(cells, ["difficulty", "module"], "left").withColumn("_in", F.col("_place") <= F.coalesce("quota", F.lit(0)))
        again, halves = ranked(ranks.select(row_id, "difficulty", "module", "_in", "_hash"), ["difficulty", "_in"], "_hash")
        used = halves.where("_in").select("difficulty", F.col("n").alias("_used"))
        rest = F.coalesce("bucket_quota", F.lit(0)) - F.coalesce("_used", F.lit(0))
        pool = again.join(buckets, "difficulty", "left").join(used, "difficulty", "left").withColumn("tier", F.when(F.col("_in"), 0).when(F.col("_place") <= rest, 1).otherwise(2))
    elif focus is not None:
        mark = focus.where("module <> 'unknown'").select("module", F.lit(0).alias("tier")).distinct()
        pool = pool.join(mark, "module", "left").fillna(1, ["tier"])
    else:
        pool = pool.withColumn("tier", F.lit(0))
    return pool.orderBy("tier", "_hash").limit(total).select(row_id, "difficulty", "module", "tier")


def oversampled(rows: DataFrame, bucket: str, target: str, total: int, row_id: str, share: float = 0.7, seed: str = "bucket") -> DataFrame:
    """``total`` rows, ``share`` of them of the target bucket as far as it goes, the rest of the others."""
    own, order = F.col(bucket).eqNullSafe(F.lit(target)), hash_order(seed, F.col(row_id))
    first = rows.where(own).orderBy(order).limit(int(total * share)).withColumn("_own", F.lit(1))
    others = rows.where(~own).orderBy(order).limit(total).withColumn("_own", F.lit(0))
    rest = F.lit(total) - F.sum("_own").over(Window.partitionBy())  # at most twice the total in one task
    both = first.unionByName(others).withColumns({"_rest": rest, "_place": F.row_number().over(Window.partitionBy("_own").orderBy(order))})
    return both.where((F.col("_own") == 1) | (F.col("_place") <= F.col("_rest"))).select(*rows.columns)
