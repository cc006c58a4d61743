"""Joins that exclude, restrict or look up rows by identity or content."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions import text as T
from .batches import small_batches

GRAM = 13
#: Benchmark grams that are sent to the executors at most.
MOST_GRAMS = 2_000_000
# Statuses that keep a row out of training, and out of tests.
TRAIN_BLOCKING = ("active_holdout", "probe_holdout", "external_probe")
TEST_BLOCKING = ("active_holdout", "probe_holdout", "external_probe", "retired_holdout", "train_seen")


def fuzzy_key(text: Column) -> Column:
    """A digest of the fuzzy text, by which exact overlap is told; null counts as empty."""
    return F.sha2(T.fuzzy(F.coalesce(text, F.lit(""))), 256)


def exact_split(rows: DataFrame, bench: DataFrame, text: str = "text", bench_text: str = "text", hits: bool = False) -> DataFrame:
    """Rows whose fuzzy text no benchmark item has; with ``hits``, the others."""
    return exact_split_keyed(rows.withColumn("_fuzzy", fuzzy_key(F.col(text))), bench, "_fuzzy", bench_text, hits).drop("_fuzzy")


def exact_split_keyed(rows: DataFrame, bench: DataFrame, key: str, bench_text: str = "text", hits: bool = False) -> DataFrame:
    """The same for rows that have their :func:`fuzzy_key`."""
    known = bench.where(F.coalesce(F.col(bench_text), F.lit("")) != "").select(fuzzy_key(F.col(bench_text)).alias(key)).distinct()
    return rows.join(known, key, "left_semi" if hits else "left_anti")


def gram_overlap(
    rows: DataFrame, bench: DataFrame, row_id: str, item_id: str, text: str = "text", width: int = GRAM, most: int = MOST_GRAMS
) -> DataFrame:
    """Per row: its number of distinct character grams, and the largest share of them that one item has.

    Rows shorter than a gram, and rows that share none, have share 0. While
    the benchmark has at most ``most`` grams, rows keep only grams that it
    has before they are joined.
    """
    small_batches(rows.sparkSession)
    n = F.lit(width)
    items = bench.where(F.coalesce(F.col(text), F.lit("")) != "").select(
        F.col(item_id).alias("_item"), F.explode(T.char_grams(T.fuzzy(F.col(text)), n)).alias("gram")
    )
    few = items.select("gram").distinct().limit(most + 1).toArrow().column("gram").to_numpy()
    body = T.fuzzy(F.coalesce(F.col(text), F.lit("")))
    if len(few) <= most:
        known = rows.sparkSession.sparkContext.broadcast(np.sort(few))
        kind = StructType([StructField("n", LongType()), StructField("g", ArrayType(LongType()))])

        @F.pandas_udf(kind)
        def found(texts: pd.Series) -> pd.DataFrame:
            grams = [T.gram_hashes(t, width) for t in texts]
            hits = [np.intersect1d(g, known.value, assume_unique=True) for g in grams]
            return pd.DataFrame({"n": [len(g) for g in grams], "g": hits})

        own = rows.select(row_id, found(body).alias("f")).select(row_id, F.col("f.n").alias("n_grams"), F.col("f.g").alias("g"))
    else:
        own = rows.select(row_id, T.char_grams(body, n).alias("g")).select(row_id, F.size("g").cast("long").alias("n_grams"), "g")
    flat = own.select(row_id, "n_grams", F.explode_outer("g").alias("gram"))
    shared = flat.join(items, "gram", "left").groupBy(row_id, "n_grams", "_item").agg(F.count("_item").alias("k"))
    most_shared = shared.groupBy(row_id, "n_grams").agg(F.max("k").alias("n_shared"))
    share = F.when(F.col("n_grams") > 0, F.col("n_shared") / F.col("n_grams")).otherwise(0.0)
    return most_shared.select(row_id, "n_grams", "n_shared", share.alias("share"))


def without_overlap(rows: DataFrame, bench: DataFrame, row_id: str, item_id: str, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """Rows of which no item has ``threshold`` or more of the grams."""
    bad = gram_overlap(rows, bench, row_id, item_id, text).where(F.col("share") >= threshold).select(row_id)
    return rows.join(bad, row_id, "left_anti")


def min_signature(text: Column, width: int = GRAM) -> Column:
    """The least MD5 of the fuzzy text's grams; null for texts shorter than one, which never match."""
    body = T.fuzzy(text)
    grams = F.transform(F.sequence(F.lit(1), F.length(body) - (width - 1)), lambda i: F.md5(F.substring(body, i, F.lit(width))))
    return F.when(F.length(body) >= width, F.array_min(grams))


def signature_split(rows: DataFrame, bench: DataFrame, text: str = "text", width: int = GRAM, hits: bool = False) -> DataFrame:
    """Rows whose least gram hash no item has; with ``hits``, the others. A worker returns one hash of a text."""
    small_batches(rows.sparkSession)
    least = T.least_gram(T.fuzzy(F.coalesce(F.col(text), F.lit(""))), F.lit(width))
    known = bench.select(least.alias("_least")).where(F.col("_least").isNotNull()).distinct()
    return rows.withColumn("_least", least).join(known, "_least", "left_semi" if hits else "left_anti").drop("_least")


def without_keys(rows: DataFrame, reserved: DataFrame, key: str) -> DataFrame:
    """Rows whose single key is not reserved."""
    return rows.join(reserved.select(key).distinct(), key, "left_anti")


def only_keys(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    return rows.join(allowed.select(key).distinct(), key, "left_semi")


def without_overlapping_keys(rows: DataFrame, reserved: DataFrame, keys: str, row_id: str) -> DataFrame:
    """Rows none of whose keys (an array) is a key of a reserved row."""
    taken = reserved.select(F.explode(keys).alias("_key")).distinct()
    bad = rows.select(row_id, F.explode(keys).alias("_key")).join(taken, "_key", "left_semi").select(row_id).distinct()
    return rows.join(bad, row_id, "left_anti")


def registry_block(questions: DataFrame, registry: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Questions that no registry entry of these statuses blocks.

    An entry blocks by source row, by question id, or by text hash where
    neither side has a source row. ``questions`` needs dataset, row_id,
    question_id and text_hash; ``registry`` its own columns.
    """
    tag = lambda kind, *c: F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(x.cast("string"), F.lit("")) for x in c])
    filled = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""

    def tags(dataset: Column, row: Column, question: Column, text_hash: Column) -> Column:
        placed = filled(dataset) & filled(row)
        return F.array_compact(
            F.array(
                F.when(placed, tag("row", dataset, row)),
                F.when(filled(question), tag("qid", question)),
                F.when(~placed & filled(text_hash), tag("txt", text_hash)),
            )
        )

    entries = registry.where(F.col("status").isin(*statuses))
    taken = entries.select(
        F.explode(tags(F.col("source_dataset_id"), F.col("source_dataset_row_id"), F.col("question_id"), F.col("text_hash"))).alias("_key")
    ).distinct()
    keyed = questions.select("question_id", F.explode(tags(F.col("dataset"), F.col("row_id"), F.col("question_id"), F.col("text_hash"))).alias("_key"))
    bad = keyed.join(taken, "_key", "left_semi").select("question_id").distinct()
    return questions.join(bad, "question_id", "left_anti")


def unused_only(questions: DataFrame, items: DataFrame, rolled_out: bool = False) -> DataFrame:
    """Questions still unused; those of datasets that ``items`` does not know pass.

    ``rolled_out``: with at least one rollout, and only known ones.
    """
    if rolled_out:
        good = items.where((F.col("state") == "unused") & (F.col("rollout_count") > 0))
        return questions.join(good.select("dataset", "question_id"), ["dataset", "question_id"], "left_semi")
    spent = items.where(F.col("state") != "unused").select("dataset", "question_id")
    return questions.join(spent, ["dataset", "question_id"], "left_anti")


def cache_lookup(questions: DataFrame, cache: DataFrame, model: str, config: str, judge: str) -> DataFrame:
    """Questions with ``cached``: an unused, rolled-out entry whose three keys are each empty or equal."""
    fits = F.lit(True)
    for name, value in (("model_key", model), ("config_hash", config), ("judge_version", judge)):
        own = F.coalesce(F.col(name), F.lit(""))
        fits = fits & ((own == "") | (own == value))
    hits = cache.where((F.col("state") == "unused") & (F.col("rollout_count") > 0) & fits)
    hits = hits.select("dataset", "question_id", F.lit(True).alias("cached")).distinct()
    out = questions.join(hits, ["dataset", "question_id"], "left")
    return out.withColumn("cached", F.coalesce("cached", F.lit(False)))


def overwrite_merge(known: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``more``, and the rows of ``known`` whose keys it lacks."""
    return known.join(more.select(*keys).distinct(), keys, "left_anti").unionByName(more, allowMissingColumns=True)


def with_overrides(defaults: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Defaults whose columns take the override's value where it is not null."""
    others = [c for c in defaults.columns if c != key]
    over = overrides.select(key, *[F.col(c).alias(f"_{c}") for c in others if c in overrides.columns])
    joined = defaults.join(over, key, "left")
    return joined.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in overrides.columns else F.col(c) for c in others])
