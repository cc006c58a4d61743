"""Conversations to question and answer rows, and training records."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Names of the two sides.
USER = ("user", "human", "prompter", "question")
ASSISTANT = ("assistant", "gpt", "bot", "model", "answer")
# Names of the two sides in transcripts.
SPOKEN = {
    "user": ("user", "human", "prompt", "instruction"),
    "assistant": ("assistant", "gpt", "bot", "model", "completion", "response"),
}
TURNS = "array<struct<role:string,content:string>>"
# Columns that hold conversations, in order; where a turn's speaker and text stand; lists inside an object.
FIELDS = ("messages", "conversations", "conversation", "dialogue", "dialog", "chat", "turns", "chosen")
ROLE_KEYS, CONTENT_KEYS = ("role", "from", "speaker"), ("content", "value", "text")
NESTED = ("messages", "conversations", "conversation", "turns")


def pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """First user and last assistant text of each conversation.

    Without roles of both kinds, the first and last of at least two texts.
    Conversations that give no pair of non-blank texts are left out.
    """
    body = T.strip(F.coalesce(F.col(text), F.lit("")))
    rows = turns.select(F.col(conv), F.col(turn), F.lower(F.col(role)).alias("r"), body.alias("b")).where("b <> ''")
    pick = lambda best, roles: best(F.when(F.col("r").isin(*roles), F.col("b")), F.when(F.col("r").isin(*roles), F.col(turn)))
    known = F.col("r").isin(*USER, *ASSISTANT)
    grouped = rows.groupBy(conv).agg(
        pick(F.min_by, USER).alias("q"),
        pick(F.max_by, ASSISTANT).alias("a"),
        F.min_by("b", turn).alias("first"),
        F.max_by("b", turn).alias("last"),
        F.count("*").alias("n"),
        F.max(known).alias("known"),
    )
    loose = ~F.col("known") & (F.col("n") >= 2)
    out = grouped.select(conv, F.when(loose, F.col("first")).otherwise(F.col("q")).alias("question"), F.when(loose, F.col("last")).otherwise(F.col("a")).alias("answer"))
    return out.where(F.col("question").isNotNull() & F.col("answer").isNotNull())


def array_pairs(turns: Column) -> tuple[Column, Column]:
    """First user and last assistant text of an array of (role, content)."""
    of = lambda roles: F.filter(turns, lambda t: F.lower(t["role"]).isin(*roles) & (T.strip(t["content"]) != ""))
    return F.get(of(USER), 0)["content"], F.try_element_at(of(ASSISTANT), F.lit(-1))["content"]


def transcript_turns(text: Column) -> Column:
    """Turns of a text in which lines begin with a role and a colon, as user or assistant.

    Lines of other roles belong to the turn before them; what precedes the first turn goes.
    """
    roles = "|".join(r for names in SPOKEN.values() for r in names)
    marked = F.regexp_replace(text, rf"(?im)^\s*({roles})\s*:\s*", "\x1e$1\x1f")
    parts = F.filter(F.split(marked, "\x1e"), lambda p: F.contains(p, F.lit("\x1f")))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.when(F.lower(F.substring_index(p, "\x1f", 1)).isin(*SPOKEN["user"]), "user").otherwise("assistant").alias("role"), T.strip(F.substring_index(p, "\x1f", -1)).alias("content")
        ),
    )


def _literal(text: str | None) -> str | None:
    """JSON of a Python literal, null if it is none."""
    try:
        return json.dumps(ast.literal_eval(text)) if text else None
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


def literal_turns(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``turns`` from JSON, or else from a Python literal, in ``column``."""
    from pyspark.sql.types import StringType

    parsed = F.from_json(F.col(column), TURNS)
    other = F.pandas_udf(lambda s: pd.Series([_literal(x) for x in s]), StringType())
    return rows.withColumn("turns", F.coalesce(parsed, F.from_json(other(F.when(parsed.isNull(), F.col(column))), TURNS)))


_MAP = "map<string,string>"


def _listed(text: Column) -> Column:
    """Turns of JSON as texts: the items of a list, or of the first list that an object has under a known name."""
    held = lambda inner: F.coalesce(*[F.from_json(F.try_element_at(inner, F.lit(k)), "array<string>") for k in NESTED])
    return F.coalesce(F.from_json(text, "array<string>"), T.once(F.from_json(text, _MAP), held))


def said(items: Column) -> Column:
    """(role, content) of turns as texts: objects by their speaker and text, others without a role."""

    def turn(item: Column, keys: Column) -> Column:
        get = lambda k: F.try_element_at(keys, F.lit(k))
        role = F.lower(T.strip(F.coalesce(*[get(k) for k in ROLE_KEYS], F.lit(""))))
        body = F.coalesce(*[F.nullif(T.strip(get(k)), F.lit("")) for k in CONTENT_KEYS], F.lit(""))
        loose = keys.isNull() & ~F.startswith(F.ltrim(item), F.lit("["))
        return F.struct(F.when(keys.isNull(), "").otherwise(role).alias("role"), F.when(loose, T.strip(item)).when(keys.isNull(), "").otherwise(body).alias("content"))

    return F.transform(F.filter(items, lambda x: x.isNotNull()), lambda item: T.once(F.from_json(item, _MAP), lambda keys: turn(item, keys)))


def chosen_pair(turns: Column) -> Column:
    """(question, answer): first user and last assistant text of turns (role, content), null without.

    Without both sides, the first and last of at least two texts that have no
    known speaker. Blank texts do not count.
    """
    of = lambda ts, test: F.transform(F.filter(ts, lambda t: test(t["role"]) & (t["content"] != "")), lambda t: t["content"])
    sides = lambda ts: F.struct(
        of(ts, lambda r: r.isin(*SPOKEN["user"])).alias("user"), of(ts, lambda r: r.isin(*SPOKEN["assistant"])).alias("model"),
        of(ts, lambda r: ~r.isin(*SPOKEN["user"], *SPOKEN["assistant"])).alias("other"),
    )
    pair = lambda a, b: F.struct(F.get(a, 0).alias("question"), F.try_element_at(b, F.lit(-1)).alias("answer"))
    pick = lambda s: F.when((F.size(s["user"]) > 0) & (F.size(s["model"]) > 0), pair(s["user"], s["model"])).when(F.size(s["other"]) >= 2, pair(s["other"], s["other"]))
    return T.once(turns, lambda ts: T.once(sides(ts), pick))


_SPEAKER = rf"(?im)^\s*({'|'.join(r for names in SPOKEN.values() for r in names)})\s*:"


def transcript_pair(text: Column) -> Column:
    """The pair of a text in which lines begin with both sides' names, null for others; those are told by one search."""
    return F.when(text.rlike(_SPEAKER), chosen_pair(transcript_turns(T.strip(text))))  # its turns all have a side


def conversation_pair(rows: DataFrame, column: str, literals: bool = True) -> Column:
    """The pair of a column that holds a transcript, JSON, a Python literal, or a list or object of turns.

    Only texts that open like a literal and are no JSON go to Python.
    """
    from pyspark.sql.types import StringType

    if not isinstance(rows.schema[column].dataType, StringType):
        return chosen_pair(said(_listed(F.to_json(column)))) if rows.schema[column].dataType.typeName() in ("array", "struct", "map") else F.lit(None).cast("struct<question:string,answer:string>")
    text = T.strip(F.col(column))
    own = _listed(text)
    if literals:
        other = F.pandas_udf(lambda s: pd.Series([_literal(x) for x in s]), StringType())
        own = F.coalesce(own, _listed(other(F.when(own.isNull() & text.rlike(r"^[\[({]"), text))))
    return F.coalesce(transcript_pair(text), chosen_pair(said(own)))


def sft_samples(rows: DataFrame, questions: list[str], answers: list[str], template: str = "", keep: list[str] | None = None) -> DataFrame:
    """instruction and output from columns joined by line feeds; rows with a blank side go.

    ``template`` may name columns in braces; if it names an unknown one it is used as it stands.
    """
    join = lambda cols: T.strip(F.concat_ws("\n", *[F.col(c).cast("string") for c in cols]))
    prompt = join(questions)
    if template:
        import string

        wanted = [name for _, name, _, _ in string.Formatter().parse(template) if name]
        if set(wanted) <= set(rows.columns):
            pieces = []
            for literal, name, _, _ in string.Formatter().parse(template):
                pieces += [F.lit(literal)] if literal else []
                pieces += [F.coalesce(F.col(name).cast("string"), F.lit(""))] if name else []
            prompt = F.concat(*pieces)
        else:
            prompt = F.lit(template)
    out = rows.withColumns({"_q": join(questions), "_a": join(answers), "_p": prompt}).where("_q <> '' and _a <> ''")
    return out.select(*(keep or []), F.col("_p").alias("instruction"), F.lit("").alias("input"), F.col("_a").alias("output"))


def to_alpaca(samples: DataFrame) -> DataFrame:
    """With the empty system text and history that trainers expect."""
    return samples.withColumns({"system": F.lit(""), "history": F.array().cast("array<array<string>>")})


def to_sharegpt(samples: DataFrame) -> DataFrame:
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    others = [c for c in samples.columns if c not in ("instruction", "input", "output")]
    return samples.select(*others, F.array(turn("human", "instruction"), turn("gpt", "output")).alias("conversations"))


def to_raw(samples: DataFrame) -> DataFrame:
    others = [c for c in samples.columns if c not in ("instruction", "input", "output")]
    return samples.select(*others, F.concat_ws("\n", "instruction", "output").alias("text"))
