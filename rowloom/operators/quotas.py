"""Shares and quotas. Tables of keys are small; totals are numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normalized(weights: dict[str, float]) -> dict[str, float]:
    """Positive weights scaled to one."""
    good = {k: float(w) for k, w in weights.items() if w and w > 0}
    total = sum(good.values())
    return {k: w / total for k, w in good.items()} if total else {}


def bounded(weights: dict[str, float], low: float = 0.05, high: float = 0.80) -> dict[str, float]:
    """Every key gets ``low`` and a share of the rest by weight, none more than ``high``.

    So each is ``min(high, low + x * weight)`` with one ``x`` for all: the
    heaviest keys are at ``high``, as few as leave no other above it. Bounds
    that no distribution meets are moved to the even one.
    """
    good = {k: max(0.0, float(w or 0)) for k, w in weights.items()}
    n = len(good)
    if not n:
        return {}
    low = min(low, 1 / n)
    high = max(high, 1 / n, low)
    order = sorted(good, key=good.get, reverse=True)
    for full in range(n):
        free = order[full:]
        rest, mass = max(0.0, 1 - full * high - len(free) * low), sum(good[k] for k in free)
        of = lambda w: rest * w / mass if mass > 1e-290 else rest * (w / mass)  # noqa: E731  products of the least numbers are 0
        more = {k: of(good[k]) if mass else rest / len(free) for k in free}
        if low + max(more.values()) <= high + 1e-12:
            return {k: low + more[k] if k in more else high for k in good}
    return normalized(dict.fromkeys(good, high))


#: Shares of the difficulties where no accuracy is known.
USUAL = {"easy": 0.15, "medium": 0.70, "hard": 0.15}


def deficits(accuracy: dict[str, float | None], usual: dict[str, float] | None = None) -> dict[str, float]:
    """Weights by what is lacking to full accuracy, within bounds.

    A bucket of ``usual`` without an accuracy keeps its usual weight beside
    them; with no accuracy at all, or nothing lacking, all do.
    """
    usual = usual or USUAL
    known = {k: min(1.0, max(0.0, float(a))) for k, a in (accuracy or {}).items() if k in usual and a is not None}
    lacking = {k: 1 - known[k] if k in known else max(0.0, w) for k, w in usual.items()}
    return bounded(lacking if known and any(lacking.values()) else usual)


def largest_remainder(weights: DataFrame, total: int, key: str = "key", weight: str = "weight") -> DataFrame:
    """``quota`` of each key: floors, then one more for the largest fractions, by key on ties. In SQL."""
    good = weights.where(F.col(weight) > 0)
    exact = F.col(weight) * total / F.sum(weight).over(Window.partitionBy())
    parts = good.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = total - F.sum("_floor").over(Window.partitionBy())
    order = Window.orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col(key))
    more = F.when(F.row_number().over(order) <= left, 1).otherwise(0)
    return parts.select(key, (F.col("_floor") + more).cast("long").alias("quota"))


def capped(weights: dict[str, float], total: int, available: dict[str, int], caps: dict[str, int] | None = None, of_all: bool = False) -> dict[str, int]:
    """Quotas within supply: floors, then one at a time in the order of fractions while any key has room.

    Shares are of the weights of keys with supply, or with ``of_all`` of all
    weights. ``caps`` bound only what the rounds after the floors add.
    """
    has = {k for k in weights if available.get(k, 0) > 0}
    share = {k: w for k, w in normalized({k: w for k, w in weights.items() if of_all or k in has}).items() if k in has}
    quota = {k: min(available[k], math.floor(total * w)) for k, w in share.items()}
    limit = {k: min(available[k], (caps or {}).get(k, available[k])) for k in share}
    order = sorted(share, key=lambda k: -(total * share[k] - math.floor(total * share[k])))
    left = total - sum(quota.values())
    while left > 0:
        open_keys = [k for k in order if quota[k] < limit[k]][:left]
        if not open_keys:
            break
        for k in open_keys:
            quota[k] += 1
        left -= len(open_keys)
    return {k: n for k, n in quota.items() if n > 0}


def capped_table(groups: DataFrame, total: str | int, key: str, within: list[str] | None = None) -> DataFrame:
    """``quota`` of each row of ``groups`` (key, weight, available), as :func:`capped`, without leaving the plan.

    ``within``: columns whose values have quotas of their own, of ``total``
    (a column) each. Keys without supply or weight have no share, equal
    fractions go by key. What the
    floors leave goes round the keys, largest fraction first, each time to
    those with room: after some full rounds every key has had as much, up to
    its room, so the rounds are one level, found among the sorted rooms.
    """
    by = within or []
    share = F.when((F.col("weight") > 0) & (F.col("available") > 0), F.col("weight").cast("double")).otherwise(0.0)
    all_, ones = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.col("_room"), F.col(key))
    want = F.col(total) if isinstance(total, str) else F.lit(total)
    whole = F.sum(share).over(all_)
    out = groups.withColumn("_exact", F.when(whole > 0, want * share / whole).otherwise(0.0))
    out = out.withColumn("_floor", F.when(F.col("_exact") > 0, F.least("available", F.floor("_exact"))).otherwise(0).cast("long"))
    out = out.withColumn("_room", F.when(F.col("_exact") > 0, F.col("available") - F.col("_floor")).otherwise(0).cast("long"))
    out = out.withColumn("_left", F.greatest(F.lit(0), want - F.sum("_floor").over(all_)).cast("long"))
    # filling every room up to the i-th takes what the rooms before hold, and that much of all others
    open_ = F.count_if(F.col("_room") > 0).over(all_)
    upto = F.sum("_room").over(ones.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.count("*").over(all_) - F.row_number().over(ones)
    out = out.withColumns({"_upto": upto + after * F.col("_room"), "_open": open_})
    level = F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_left"), F.col("_room"))).over(all_), F.lit(0))
    out = out.withColumn("_level", level)
    out = out.withColumn("_rest", F.col("_left") - F.sum(F.least("_room", "_level")).over(all_))
    out = out.withColumn("_more", F.count_if(F.col("_room") > F.col("_level")).over(all_))
    out = out.withColumn("_level", F.col("_level") + F.when(F.col("_more") > 0, F.expr("_rest div greatest(_more, 1)")).otherwise(0))
    out = out.withColumn("_rest", F.when(F.col("_more") > 0, F.col("_rest") % F.greatest("_more", F.lit(1))).otherwise(0))
    turn = Window.partitionBy(*by, F.col("_room") > F.col("_level")).orderBy((F.col("_exact") - F.floor("_exact")).desc(), F.col(key))
    one = F.when((F.col("_room") > F.col("_level")) & (F.row_number().over(turn) <= F.col("_rest")), 1).otherwise(0)
    return out.withColumn("quota", (F.col("_floor") + F.least("_room", "_level") + one).cast("long")).select(*groups.columns, "quota")


def capped_hard(weights: dict[str, float], total: int, available: dict[str, int]) -> dict[str, int]:
    """As :func:`capped`, shares over all keys, with hard held near its weight unless that is a quarter or more."""
    hard = normalized(weights).get("hard", 0.0)
    cap = total if hard >= 0.25 else min(available.get("hard", 0), max(math.ceil(total * hard), math.ceil(total * 0.15)))
    return capped(weights, total, available, {"hard": cap}, of_all=True)


def shortfall(quota: DataFrame, selected: DataFrame, available: DataFrame, key: str = "key") -> DataFrame:
    """What each key's quota lacks after selected and available rows."""
    got = selected.groupBy(key).agg(F.count("*").alias("_s"))
    more = available.groupBy(key).agg(F.count("*").alias("_a"))
    lack = F.col("quota") - F.coalesce("_s", F.lit(0)) - F.coalesce("_a", F.lit(0))
    return quota.join(got, key, "left").join(more, key, "left").select(key, F.greatest(F.lit(0), lack).alias("shortfall"))


def pool_target(target: int, train_share: float, val_share: float) -> int:
    """Rows to roll out so that training gets ``target`` after the splits."""
    return math.ceil(target / max(1e-9, train_share * (1 - val_share)))
