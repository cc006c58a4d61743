"""Profiles of columns, and the roles that they can play."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType, StringType

# Column names by role, exact matches first, then parts of names.
ROLES = {
    "question": ("question", "problem", "prompt", "instruction", "input", "query"),
    "answer": ("answer", "final_answer", "gold_answer", "solution", "output", "response", "completion", "target"),
    "conversation": ("messages", "conversations", "conversation", "dialogue", "turns"),
}


def kind_of(data_type) -> str:
    """Booleans and numbers count as number, as in profiles of untyped rows."""
    if isinstance(data_type, StringType):
        return "string"
    if isinstance(data_type, (NumericType, BooleanType)):
        return "number"
    if isinstance(data_type, (ArrayType, MapType)):
        return "collection"
    return "other"


def column_profile(rows: DataFrame) -> DataFrame:
    """Per column: kind, mean length of its values that are not null (one decimal), share of nulls (three)."""
    aggregates = [F.count("*").alias("_n")]
    for i, f in enumerate(rows.schema.fields):
        c, kind = F.col(f"`{f.name}`"), kind_of(f.dataType)
        size = F.length(c) if kind == "string" else F.size(c) if kind == "collection" else F.lit(None).cast("int")
        aggregates += [F.avg(F.when(c.isNotNull(), size)).alias(f"_l{i}"), F.count_if(c.isNull()).alias(f"_e{i}")]
    one = rows.agg(*aggregates)
    parts = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(kind_of(f.dataType)).alias("kind"),
            F.round(f"_l{i}", 1).alias("avg_length"),
            F.round(F.try_divide(f"_e{i}", "_n"), 3).alias("null_share"),
        )
        for i, f in enumerate(rows.schema.fields)
    ]
    return one.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def column_roles(rows: DataFrame) -> dict[str, str | None]:
    """Role to column: the first exact name, else the first column that holds a name. No data is read."""
    names = {c.strip().lower(): c for c in reversed(rows.columns)}
    out: dict[str, str | None] = {}
    for role, words in ROLES.items():
        exact = next((names[w] for w in words if w in names), None)
        out[role] = exact or next((names[n] for w in words for n in sorted(names) if w in n), None)
    return out


def null_counts(rows: DataFrame) -> DataFrame:
    """Long form of the number of nulls by column."""
    one = rows.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in rows.columns])
    return reduce(DataFrame.unionByName, [one.select(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("nulls")) for c in rows.columns])
