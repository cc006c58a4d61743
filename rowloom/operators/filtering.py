"""Rule filters with an audited reason for every dropped row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .spread import looked_up
from .written import written


@dataclass(frozen=True)
class Rules:
    """Limits of 0 are off. ``dedup``: question, question_answer, row or empty."""

    min_question: int = 0
    max_question: int = 0
    min_answer: int = 0
    max_answer: int = 0
    languages: tuple[str, ...] = ()
    dedup: str = ""
    required: tuple[str, ...] = ()


def first_field(*names: Column) -> Column:
    """The first that is not null, even if empty, as text; empty if all are null."""
    return F.coalesce(*[n.cast("string") for n in names], F.lit(""))


def _failing(rules: Rules, question: Column, answer: Column) -> Column:
    """Name of the first rule that a row fails, null if none; duplicates aside."""
    q, a = F.length(question), F.length(answer)
    checks: list[tuple[str, Column]] = [
        ("empty_" + c, T.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "") for c in rules.required
    ]
    if rules.min_question > 0:
        checks.append(("question_short", q < rules.min_question))
    if rules.max_question > 0:
        checks.append(("question_long", q > rules.max_question))
    if rules.min_answer > 0:
        checks.append(("answer_short", a < rules.min_answer))
    if rules.max_answer > 0:
        checks.append(("answer_long", a > rules.max_answer))
    if rules.languages:
        checks.append(("language", ~T.language(question).isin(*rules.languages)))
    out = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        out = F.when(bad, name).otherwise(out)
    return out


def _key(rows: DataFrame, rules: Rules, question: Column, answer: Column, order: str) -> Column:
    return {
        "question": F.md5(question),
        "question_answer": F.md5(F.concat(question, F.lit("\n"), answer)),
        "row": T.row_hash(*[F.col(c) for c in sorted(rows.columns) if c != order]),
    }[rules.dedup]


def _marked(rows: DataFrame, firsts: DataFrame, order: str) -> DataFrame:
    """``rows`` with (order, reason, _key) marked as duplicates unless they are the first of their key.

    Rows without an order come after all others: they are duplicates of
    ordered rows, but not of each other.
    """
    ordered = rows.where(F.col(order).isNotNull())
    ordered = ordered.join(firsts.select(F.col("_first").alias(order), F.lit(True).alias("_is_first")), order, "left").select(*rows.columns, "_is_first")
    bare = looked_up(rows.where(F.col(order).isNull()), firsts.select("_key", F.lit(False).alias("_is_first")), "_key", F.col("_key"))
    bare = bare.select(*rows.columns, F.coalesce("_is_first", F.lit(True)).alias("_is_first"))
    again = F.col("reason").isNull() & ~F.coalesce("_is_first", F.lit(False))
    return ordered.unionByName(bare).withColumn("reason", F.when(again, "duplicate").otherwise(F.col("reason"))).drop("_key", "_is_first")


def _firsts(keyed: DataFrame, order: str) -> DataFrame:
    """The least order of each key among rows that pass, found by partial aggregation, so no task sees all rows of a key."""
    return keyed.where(F.col("reason").isNull() & F.col(order).isNotNull()).groupBy("_key").agg(F.min(order).alias("_first"))


def screened(rows: DataFrame, rules: Rules, question: Column, answer: Column, order: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """``order``, ``reason`` and the ``carry`` columns of every row, without its texts; see :func:`judge`.

    Rules are computed once, hashes and carried columns for rows that pass
    them alone (null for others), and all is written.
    """
    passed = F.col("_reason").isNull()
    own = {k: F.when(passed, v) for k, v in (carry or {}).items() if k != order}
    if rules.dedup:
        own["_key"] = F.when(passed, _key(rows, rules, question, answer, order))
    out = rows.withColumn("_reason", _failing(rules, question, answer))
    out = out.select(order, F.col("_reason").alias("reason"), *[v.alias(k) for k, v in own.items()])
    if not rules.dedup:
        return out
    keyed = written(out, "screened")
    return _marked(keyed, _firsts(keyed, order), order)


def judge(rows: DataFrame, rules: Rules, question: Column, answer: Column, order: str) -> DataFrame:
    """``rows`` with ``reason``: the first rule that fails, ``duplicate``, or null for kept rows.

    Only rows that pass all other rules count as seen, in the order of
    ``order``, which no two rows share. Where texts are not needed again,
    :func:`screened` is cheaper.
    """
    out = rows.withColumn("reason", _failing(rules, question, answer))
    if not rules.dedup:
        return out
    keyed = out.withColumn("_key", _key(rows, rules, question, answer, order))
    firsts = written(_firsts(keyed, order), "firsts")
    return _marked(keyed, firsts, order)


def kept(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNull()).drop("reason")


def reasons(judged: DataFrame) -> DataFrame:
    """Rows by reason; ``kept`` for those without."""
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
