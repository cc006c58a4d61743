"""The corpus pipeline: language, near copies, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of ``docs``. Rows need ``doc_id``, ``text`` and
``lang``; other columns are carried along, whatever their names. Null and
empty texts hold no letter and go in the first stage; so do they, unchanged,
through the others if these are called alone. Repeated rows and equal texts
are near copies, of which one stays: that of the smallest doc_id, and of equal
ones the first in the table. Ties of languages go to the first by name. Very
long texts are read whole in every stage. Empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import bpe, decontaminate, lang_id, near_dedup, secrets
from rowloom.llm._shared import stored

#: Bits a byte under the best language; beyond, a text is in none of them.
STRANGE = 6.5
TOKENIZER = "word_bpe_49k.json"


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those that no learned language describes."""
    model = lang_id.fit(docs)
    row = _free(docs, "whole_row")
    found = lang_id.identify(docs.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), model, id_col=row)
    strange = F.coalesce(F.col("bits_per_byte") > STRANGE, F.lit(False))  # nothing to judge by is not strange
    kept = found.where((F.col("lang_pred") != "und") & ~strange)
    return kept.select(*[F.col("doc_id")[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    number = _free(docs, "row_number")
    base = stored(docs.withColumn(number, F.monotonically_increasing_id()), "pipeline-rows")
    keyed = base.select(F.struct(F.col("doc_id").alias("a"), F.col(number).alias("b")).alias("key"), "text")
    found = near_dedup.near_duplicates(keyed, id_col="key")
    kept = found.where("kept").select(F.col("doc_id.b").alias(number))
    return base.join(kept, number, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    _, ledger = secrets.scan_versions(docs, path_col="doc_id")
    blob, spans = _free(docs, "blob"), _free(docs, "spans")
    found = ledger.where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    rows = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256)).join(found, blob, "left")
    hit = F.col(spans).isNotNull()
    text = F.when(hit, secrets.redact(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*[f"`{c}`" for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_copies),
    ("decontaminate", leaks),
    ("secrets", secret_spans),
    ("bpe", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage but the last is written out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
