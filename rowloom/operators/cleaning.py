"""Rows cleaned by registered Python callables, and models behind callables.

A cleaner takes a row as a dict and a context, and returns a dict with
question_text and gold_answer, or None to drop the row. Code is never
generated or evaluated; callables are registered by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from .batches import small_batches

Cleaner = Callable[[dict, dict], dict | None]
CLEANERS: dict[str, Cleaner] = {}
_FIELDS = ("question_text", "gold_answer", "train_output")
SCHEMA = "position long, question_text string, gold_answer string, train_output string, error string"


def register(name: str) -> Callable[[Cleaner], Cleaner]:
    def keep(f: Cleaner) -> Cleaner:
        CLEANERS[name] = f
        return f

    return keep


@register("identity")
def _identity(record: dict, context: dict) -> dict:
    return {k: record.get(k) for k in _FIELDS}


def clean(rows: DataFrame, name: str, context: dict | None = None, position: str = "seq") -> DataFrame:
    """SCHEMA for every row that the cleaner keeps or fails on; ``error`` tells failures apart. Rows come in small batches."""
    small_batches(rows.sparkSession)
    cleaner, own = CLEANERS[name], dict(context or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for record in f.to_dict("records"):
                at = record[position]
                try:
                    got = cleaner(record, own)
                except Exception as e:  # the row is reported, not the job failed
                    out.append((at, None, None, None, f"{type(e).__name__}: {e}"[:200]))
                    continue
                if got is not None:
                    out.append((at, *[None if got.get(k) is None else str(got[k]) for k in _FIELDS], None))
            yield pd.DataFrame(out, columns=["position", *_FIELDS, "error"])

    return rows.mapInPandas(run, SCHEMA)


def accepted(cleaned: DataFrame) -> DataFrame:
    """Rows with a valid question and an answer; outputs default to the answer."""
    answer = T.strip(F.coalesce("gold_answer", F.lit("")))
    good = F.col("error").isNull() & T.is_valid_question(F.col("question_text")) & (answer != "")
    output = F.coalesce(F.nullif(T.strip(F.col("train_output")), F.lit("")), answer)
    return cleaned.where(good).select("position", T.strip(F.col("question_text")).alias("question_text"), answer.alias("gold_answer"), output.alias("train_output"))


def readiness(cleaned: DataFrame) -> DataFrame:
    """One row: cleaned, failed, and whether the cleaner is ready: some row is cleaned and none failed."""
    one = cleaned.agg(F.count_if(F.col("error").isNull()).alias("cleaned"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return one.withColumn("ready", (F.col("cleaned") > 0) & (F.col("failed") == 0))


def predict(rows: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], out: str = "prediction") -> DataFrame:
    """``rows`` with a model's texts; the callable gets a batch of prompts."""
    small_batches(rows.sparkSession)

    @F.pandas_udf(StringType())
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(model(["" if p is None else p for p in prompts]), dtype=object)

    return rows.withColumn(out, run(F.col(prompt)))


def classify(rows: DataFrame, text: str, label: Column | None = None) -> DataFrame:
    """``module`` and ``confidence``: the given label, else the existing module, else by keywords."""
    own = T.module_of(F.col(text))
    given = F.nullif(label, F.lit("")) if label is not None else F.lit(None).cast("string")
    have = F.nullif(F.col("module"), F.lit("unknown")) if "module" in rows.columns else F.lit(None).cast("string")
    sure = F.when(given.isNotNull() | have.isNotNull(), 1.0).when(own == "unknown", 0.3).otherwise(0.7)
    return rows.withColumns({"confidence": sure, "module": F.coalesce(given, have, own)})
