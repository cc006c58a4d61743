"""Row identity: by source row, by question id, or by text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def _filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def text_hash(text: Column) -> Column:
    """SHA-256 of the stripped text; null counts as empty."""
    return F.sha2(strip(F.coalesce(text, F.lit(""))), 256)


def row_key(dataset: Column, row: Column, subset: Column | None = None, split: Column | None = None) -> Column:
    """Tagged key of the source row, null unless dataset and row are both known."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
    key = F.concat_ws("\x1f", F.lit("row"), part(dataset), part(subset), part(split), part(row))
    return F.when(_filled(dataset) & _filled(row), key)


def single_key(dataset: Column, row: Column, text: Column, question: Column, subset: Column | None = None, split: Column | None = None) -> Column:
    """The row's key, else the text's hash, else the question's id."""
    by_text = F.when(strip(F.coalesce(text, F.lit(""))) != "", F.concat(F.lit("txt\x1f"), text_hash(text)))
    by_id = F.concat(F.lit("qid\x1f"), F.coalesce(question.cast("string"), F.lit("")))
    return F.coalesce(row_key(dataset, row, subset, split), by_text, by_id)


def key_set(dataset: Column, row: Column, text: Column, question: Column, subset: Column | None = None, split: Column | None = None) -> Column:
    """All keys by which two rows can be the same: row and id if there is a row key, else the single key."""
    key = row_key(dataset, row, subset, split)
    by_id = F.when(_filled(question), F.concat(F.lit("qid\x1f"), question.cast("string")))
    return F.when(key.isNotNull(), F.array_compact(F.array(key, by_id))).otherwise(
        F.array(single_key(dataset, row, text, question, subset, split))
    )


def hash_order(seed: str, key: Column) -> Column:
    """A shuffled order that every engine reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
