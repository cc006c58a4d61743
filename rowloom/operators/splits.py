"""Splits of rows into train, cotest, test and probe."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import hash_order
from .ranks import ranked

ROLES = ("train", "cotest", "test", "probe")


def ratio_split(rows: DataFrame, row_id: str, test_ratio: float, seed: str = "split") -> DataFrame:
    """``split`` by hash order; at least one row trains. The cut is a hash value, so no task ranks all rows."""
    n = rows.count()
    n_train = max(1, int(n * (1 - test_ratio)))
    keyed = rows.withColumn("_hash", hash_order(seed, F.col(row_id)))
    if n_train >= n:
        return keyed.withColumn("split", F.lit("train")).drop("_hash")
    cut = _nth(keyed, "_hash", n_train)
    return keyed.withColumn("split", F.when(F.col("_hash") <= cut, "train").otherwise("test")).drop("_hash")


def _nth(rows: DataFrame, hashed: str, n: int) -> str:
    """The n-th smallest of uniform hex strings: counts by prefix narrow it down until few are left."""
    prefix, before = "", 0
    while True:
        own = rows.where(F.col(hashed).startswith(prefix)) if prefix else rows
        counts = sorted((r[0], r[1]) for r in own.groupBy(F.substring(hashed, 1, len(prefix) + 2)).count().collect())
        for value, k in counts:
            if before + k >= n:
                break
            before += k
        prefix = value
        if len(prefix) >= 32:  # rows of one identifier
            return prefix
        if k <= 10_000:
            few = sorted(r[0] for r in rows.where(F.col(hashed).startswith(prefix)).select(hashed).collect())
            return few[n - before - 1]


def existing_split(rows: DataFrame, label: str, row_id: str, test_ratio: float) -> DataFrame:
    """``split`` from the rows' own labels; rows of neither label go. Without test rows all are split anew."""
    low = F.lower(F.col(label))
    if rows.where(low == "test").isEmpty():
        return ratio_split(rows, row_id, test_ratio)
    return rows.where(low.isin("train", "test")).withColumn("split", low)


def holdout_by_key(rows: DataFrame, key: str, row_id: str, test_ratio: float, seed: str = "holdout") -> DataFrame:
    """``split`` within each key: at least one row, and a tenth, are tests."""
    tests = F.greatest(F.lit(1), F.floor(F.col("n") * max(test_ratio, 0.1)))
    out, sizes = ranked(rows.where(F.col(key).isNotNull()).withColumn("_hash", hash_order(seed, F.col(row_id))), [key], "_hash")
    out = out.join(sizes.select(key, tests.alias("_tests")), key)
    return out.withColumn("split", F.when(F.col("_place") <= F.col("_tests"), "test").otherwise("train")).select(*rows.columns, "split")


def split_quotas(sizes: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """Rows of each group by role, from its size ``n``.

    Floors of the shares; in groups with a row for each role none is empty;
    then rows are added by the largest fraction, or taken back by the
    smallest. Fractions are those of the first floors; ties go in the order
    of ROLES, among equal fractions both ways.
    """
    share = {r: ratios.get(r, 0.0) for r in ROLES}
    total = reduce(add, share.values()) or 1.0  # rounded at each step, as sum() no longer does
    positive = [r for r in ROLES if share[r] > 0]
    out = sizes
    for r in ROLES:
        exact = F.col("n") * F.lit(share[r]) / F.lit(total)
        out = out.withColumn(f"_e_{r}", exact).withColumn(f"_f_{r}", F.floor(exact))
    lifted = {r: F.when(F.lit(r in positive) & (F.col("n") >= len(positive)) & (F.col(f"_f_{r}") == 0), 1).otherwise(F.col(f"_f_{r}")) for r in ROLES}
    for r in ROLES:
        out = out.withColumn(f"_q_{r}", lifted[r])
    out = out.withColumn("_left", F.col("n") - sum(F.col(f"_q_{r}") for r in ROLES))
    frac = {r: F.col(f"_e_{r}") - F.col(f"_f_{r}") for r in ROLES}
    for i, r in enumerate(ROLES):
        above = sum((frac[s] > frac[r]).cast("int") if j > i else (frac[s] >= frac[r]).cast("int") for j, s in enumerate(ROLES) if j != i)
        # taking back goes by smallest fractions and passes empty roles over
        below = sum(
            ((F.col(f"_q_{s}") > 0) & ((frac[s] < frac[r]) if j > i else (frac[s] <= frac[r]))).cast("int") for j, s in enumerate(ROLES) if j != i
        )
        q = F.col(f"_q_{r}")
        out = out.withColumn(
            f"n_{r}",
            F.when((F.col("_left") > 0) & (above < F.col("_left")), q + 1)
            .when((F.col("_left") < 0) & (q > 0) & (below < -F.col("_left")), q - 1)
            .otherwise(q)
            .cast("long"),
        )
    return out.select(*[c for c in sizes.columns], *[f"n_{r}" for r in ROLES])


def stratified_split(rows: DataFrame, keys: list[str], order: str, ratios: dict[str, float]) -> DataFrame:
    """``split`` of every row: each group's first rows train, the next are cotest, and so on. Rows beyond all quotas go.

    Rows with a null key belong to no group and go. ``rows`` are computed and
    written once, ranks and sizes come of that: give only the columns that
    are needed.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    own, sizes = ranked(rows.where(known), keys, order)
    out, role, upto = own.join(split_quotas(sizes, ratios), keys), F.lit(None).cast("string"), F.lit(0)
    bounds = []
    for r in ROLES:
        upto = upto + F.col(f"n_{r}")
        bounds.append((r, upto))
    for r, b in reversed(bounds):
        role = F.when(F.col("_place") <= b, r).otherwise(role)
    return out.withColumn("split", role).where(F.col("split").isNotNull()).drop("_place", "n", *[f"n_{r}" for r in ROLES])


def validation_size(n: int) -> int:
    """Rows to take from training for validation: a twentieth, 8 to 64, none if fewer than 30 would stay."""
    size = min(64, max(8, int(0.05 * n)))
    return size if n - size >= 30 else 0


def validation_carve(train: DataFrame, order: str) -> DataFrame:
    """``split`` lf_val for the first rows, train for the others."""
    size = validation_size(train.count())
    first = train.orderBy(order).limit(size).select(order, F.lit("lf_val").alias("split"))
    return train.drop("split").join(first, order, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def frozen_holdout(rows: DataFrame, row_id: str, size: int, seed: str = "frozen") -> DataFrame:
    """A stable sample of ``size`` rows; none unless there are more."""
    if rows.limit(size + 1).count() <= size:
        return rows.limit(0)
    return rows.orderBy(hash_order(seed, F.col(row_id))).limit(size)
