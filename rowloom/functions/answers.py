"""Final answers of worked solutions, and their comparison."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import strip

_NUMBER = r"-?\d+\.?\d*"
# Phrases that announce an answer, in order.
_PHRASES = (r"(?i)答案[：:]\s*([^\n]+)", r"(?i)the answer is\s*([^\n]+)", r"(?i)final answer[:\s]+([^\n]+)")


@F.pandas_udf(StringType())
def last_boxed(texts: pd.Series) -> pd.Series:
    r"""Inside of the last ``\boxed{...}`` whose braces balance; empty if there is none. An Arrow UDF."""

    def inside(text: str | None) -> str:
        text, mark = text or "", "\\boxed{"
        at = text.rfind(mark)
        while at >= 0:
            depth, start = 1, at + len(mark)
            for i in range(start, len(text)):
                depth += {"{": 1, "}": -1}.get(text[i], 0)
                if depth == 0:
                    return text[start:i].strip()
            at = text.rfind(mark, 0, at)
        return ""

    return texts.map(inside)


def numbers(text: Column) -> Column:
    """All numbers of a text as written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_NUMBER})"))


def last_number(text: Column) -> Column:
    """The last number as written, null if there is none."""
    return F.try_element_at(numbers(text), F.lit(-1))


def marked_answer(text: Column, marker: str = "####") -> Column:
    """What follows the last marker, null without one."""
    return F.when(F.contains(text, F.lit(marker)), strip(F.element_at(F.split(text, F.lit("\\Q" + marker + "\\E")), -1)))


def announced_answer(text: Column) -> Column:
    """The rest of the line after the first phrase that announces an answer."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in _PHRASES]
    return strip(F.coalesce(*found))


def _shown(x: Column) -> Column:
    """A double in the shortest usual form: fixed below 1e16, else with an exponent like e+16."""
    whole = F.concat(x.cast("decimal(20,0)").cast("string"), F.lit(".0"))
    fixed = F.regexp_replace(x.cast("decimal(38,16)").cast("string"), "0+$", "")
    exponent = F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), "E", "e+")
    size = F.abs(x)
    return F.when(size >= 1e16, exponent).when(size < 1e7, x.cast("string")).when(x == F.floor(x), whole).otherwise(fixed)


def final_answer(text: Column, boxed: Column | None = None) -> Column:
    """Boxed, else marked, else announced, else the last number as a decimal, else empty.

    ``boxed``: :func:`last_boxed` of the text where it may hold one; without
    it, texts are taken to have none and no Python is run.
    """
    parts = [F.nullif(boxed, F.lit(""))] if boxed is not None else []
    number = _shown(F.try_element_at(numbers(text), F.lit(-1)).cast("double"))
    return F.coalesce(*parts, marked_answer(text), announced_answer(text), number, F.lit(""))


def numeric_match(prediction: Column, gold: Column) -> Column:
    """The last numbers are equal, or as many numbers and all of them."""
    a = F.transform(numbers(prediction), lambda x: x.cast("double"))
    b = F.transform(numbers(gold), lambda x: x.cast("double"))
    near = lambda x, y: F.abs(x - y) < 1e-6
    all_near = F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(near(x, y), F.lit(False))), lambda x: x)
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, near(F.element_at(a, -1), F.element_at(b, -1)) | ((F.size(a) == F.size(b)) & all_near)).otherwise(False)


def math_text(text: Column) -> Column:
    """Lower case without white space and without full stops at the end."""
    bare = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), "[.。]+\\z", "")
    return F.lower(F.regexp_replace(bare, r"(?U)\s+", ""))


def is_plain_number(text: Column) -> Column:
    """One decimal or integer, thousands separators aside."""
    return F.regexp_replace(strip(F.coalesce(text, F.lit(""))), ",", "").rlike(r"^[-+]?(?:\d+(?:\.\d*)?|\.\d+)\z")


# Marks of answers that are more than a number.
_STRUCTURE = (
    "\\frac", "\\sqrt", "\\cup", "\\cap", "\\infty", "\\text", "\\begin", "\\le", "\\ge", "\\neq", "\\pi", "∞", "∪", "∩", "≤", "≥", "!=",
)


def is_structured(text: Column, boxed: Column | None = None) -> Column:
    """Intervals, equations, several parts and the like, whose last number says nothing.

    ``boxed``: :func:`last_boxed` of the text where it may hold one.
    """
    body = strip(F.coalesce(text, F.lit("")))
    marked = reduce(lambda a, b: a | b, [F.contains(body, F.lit(m)) for m in (*_STRUCTURE, "=")])
    if boxed is not None:
        marked = marked | (F.contains(body, F.lit("\\boxed{")) & ~is_plain_number(boxed))
    parts = body.rlike(r"[,\[\](){}]") & (F.size(numbers(body)) > 1)
    return (body != "") & ~is_plain_number(body) & (marked | parts)


def structured_answer(text: Column, boxed: Column | None = None) -> Column:
    """Boxed, else marked, else announced, else the whole text; never the last number."""
    parts = [F.nullif(boxed, F.lit(""))] if boxed is not None else []
    return F.coalesce(*parts, marked_answer(text), announced_answer(text), strip(F.coalesce(text, F.lit(""))))


def same_answer(prediction: Column, gold: Column, boxed: tuple[Column, Column] | None = None) -> Column:
    """Whether a prediction gives the gold answer.

    Equal texts do, whatever their case. A structured gold answer must be met
    as mathematical text; else final answers must be equal, or numbers match
    where the gold one is a plain number. Null and empty answers meet nothing.
    ``boxed``: :func:`last_boxed` of both, where they may hold one.
    """
    p, g = (strip(F.coalesce(x, F.lit(""))) for x in (prediction, gold))
    in_p, in_g = boxed or (None, None)
    one, two = math_text(structured_answer(p, in_p)), math_text(structured_answer(g, in_g))
    final, due = final_answer(p, in_p), F.coalesce(F.nullif(final_answer(g, in_g), F.lit("")), g)
    alike = (F.lower(final) == F.lower(due)) | (is_plain_number(due) & numeric_match(final, due))
    unlike = F.when(is_structured(g, in_g), (one != "") & (one == two)).otherwise((final != "") & alike)
    return (prediction != "") & (gold != "") & prediction.isNotNull() & gold.isNotNull() & ((F.lower(p) == F.lower(g)) | unlike)


def without_marked_answer(text: Column, marker: str = "####") -> Column:
    """The text before its last marker, stripped."""
    body = strip(text)
    parts = F.split(body, F.lit("\\Q" + marker + "\\E"))
    head = F.array_join(F.slice(parts, 1, F.size(parts) - 1), marker)
    return F.when(F.contains(body, F.lit(marker)), F.regexp_replace(head, r"(?U)\s+\z", "")).otherwise(body)


def boxed(answer: Column) -> Column:
    r"""``\boxed{answer}``; empty and boxed answers stay."""
    body = strip(answer)
    done = F.startswith(body, F.lit("\\boxed{")) & F.endswith(body, F.lit("}"))
    return F.when((body == "") | done, body).otherwise(F.concat(F.lit("\\boxed{"), body, F.lit("}")))


def training_output(reasoning: Column, answer: Column) -> Column:
    """Reasoning, and the boxed answer below it unless one contains the other."""
    body, final = strip(F.coalesce(reasoning, F.lit(""))), strip(F.coalesce(answer, F.lit("")))
    inside = (final == "") | F.contains(body, final) | F.contains(final, body)
    return F.when(body == "", boxed(final)).when(inside, body).otherwise(F.concat(body, F.lit("\n\n"), boxed(final)))
