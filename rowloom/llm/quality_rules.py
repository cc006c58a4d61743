"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once per text. The ledger keeps the measurements and
one bit per failed rule, so a policy is a mask of bits, a new policy needs no
second look at the texts, and ablations are counts over bit patterns, of
which there are at most ``2 ** len(RULES)``.

A word is ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and fail
``few_words``. Rows are judged one by one: repeated rows get equal results,
an empty table gives an empty ledger, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "[^#*$%&|<>]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters")


def _measured(docs: DataFrame, keys: list[Column], text: str) -> DataFrame:
    """The measurements of MEASURES; texts stay where they are."""
    has_word = lambda line: line.rlike("[^\\x20\\x09-\\x0D]")
    body = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(
        *keys,
        F.array_remove(F.split(body, _SPACE), "").alias("_w"),
        F.filter(F.split(body, "\n"), has_word).alias("_lines"),
        F.length(F.regexp_replace(body, _SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(body, "[^\\p{L}]+", "")).cast("long").alias("n_letters"),
    )
    names = [c for c in first.columns if c[0] != "_"]
    # One hash for each run of three words; the last two entries lack words.
    second = first.select(
        *names,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))).alias("_h"),
    )
    names = [c for c in second.columns if c[0] != "_"]
    third = second.select(*names, F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))).alias("_h"))
    # Texts without a repeated run, the most, are done here.
    fourth = third.select(
        *names,
        F.when(
            F.size("_h") > F.size(F.array_distinct("_h")),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ).alias("_s"),
    )
    again = F.transform(
        "_s",
        lambda x, i: F.when((x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"]), x["p"]),
    )
    fifth = fourth.select(*names, F.array_compact(again).alias("_p"))
    covered = F.flatten(F.transform("_p", lambda p: F.array(p, p + 1, p + 2)))
    return fifth.select(
        *names, F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long").alias("n_repeat_words")
    ).withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0)).cast("long"))


def _rules() -> dict[str, Column]:
    """Rule name to the condition under which a text fails; the order gives the bits."""
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_runs": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "many_symbols": 100 * c("n_symbols") > 7 * c("word_chars"),
        "repeated_lines": (100 * c("n_dup_lines") > 30 * c("n_lines")) & (100 * c("n_repeat_words") > 30 * c("n_words")),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 20 * c("n_words"),
        "few_letters": 100 * c("n_letters") < 60 * c("word_chars"),
    }


RULES = ("few_words", "repeated_runs", "many_symbols", "repeated_lines", "short_words", "long_words", "few_letters")
#: Policy version to the rules that a text must not fail.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_runs"),
    "v1": ("few_words", "repeated_runs", "many_symbols", "repeated_lines"),
    "v2": RULES,
}


def mask(rules: tuple[str, ...]) -> int:
    """The bits of some rules."""
    return sum(1 << RULES.index(r) for r in rules)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier, MEASURES and ``failed`` (long, one bit per rule) of every row."""
    rows = _measured(docs, [F.col(id_col).alias("doc_id")], text_col)
    bits = [F.when(cond, F.lit(1 << RULES.index(name))).otherwise(F.lit(0)) for name, cond in _rules().items()]
    return rows.select("doc_id", *MEASURES, reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long").alias("failed"))


def apply_policy(entries: DataFrame, version: str = "v2") -> DataFrame:
    """``kept`` for each ledger row under a policy; texts are not read again."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(entries: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it drops."""
    rules = POLICIES[version]
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask(rules))).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).alias("bit")) for r in rules]))
    return (
        patterns.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        )
    )
