"""Joins by keys that very many rows may share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def looked_up(rows: DataFrame, table: DataFrame, key: str, spread: Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``table``, one row a key, by ``key``.

    Rows are dealt by key and a salt of ``spread``. A key is asked for once a
    salt, so the join with the table has at most ``salts`` rows of it, and the
    answers meet a ``salts``-th of the key's rows each.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    asked = salted.select(key, "_salt").where(F.col(key).isNotNull()).distinct()
    return salted.join(asked.join(table, key), [key, "_salt"], how).drop("_salt")
