"""Raw rows of any schema to question rows, and question rows to training records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import identity as I
from ..functions import text as T
from . import conversations

# Column names that hold no text of a question or answer.
METADATA_NAMES = (
    "id", "uid", "uuid", "idx", "index", "conversation_id", "unique_id", "source", "src", "data_source", "dataset", "dataset_id", "domain",
    "category", "system", "split", "subset", "tag", "label_name", "language", "lang", "metadata", "tok_len", "token_count", "length",
)
# Schemas that were guessed, whose rows are not used.
FALLBACK_REASONS = ("fallback schema", "fallback flat schema", "fallback conversation schema")
# Marks of transcripts, of generated openings, and of generated reference templates.
TRANSCRIPT_MARKS = ("### human", "### user", "### assistant", "### assistance", "assistant:**", "assistant: **", "human:", "user:")
OPENING_MARKS = ("novel creative puzzle", "ai companion", "fictional example", "based on the question and answer you provided")
TEMPLATE_MARKS = (
    "decode the problem", "information retrieval and association", "information analysis and integration", "response development",
    "response and answer formulation", "post-response reflection", "knowledge graph",
)


@dataclass(frozen=True)
class Fields:
    """Which columns play which part; empty names are unknown.

    ``kind``: flat (no conversations are looked for), conversation (in every
    column) or empty (in every column if one of the named ones is a usual
    place of conversations). ``conversation`` names their column.
    """

    question: str
    answer: str = ""
    rollout: str = ""
    train: str = ""
    dedup: str = ""
    row_id: str = ""
    style: str = ""
    method: str = "gold"
    conversation: str = ""
    kind: str = ""


def _has(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def is_polluted_reference(text: Column) -> Column:
    """A transcript or generated solution written in place of a problem."""
    low = F.lower(T.strip(F.coalesce(text, F.lit(""))))
    templates = reduce(lambda a, b: a + b, [F.contains(low, F.lit(m)).cast("int") for m in TEMPLATE_MARKS])
    marked = (_has(low, TRANSCRIPT_MARKS) | _has(low, OPENING_MARKS)) & (templates >= 2)
    return marked | ((templates >= 4) & _has(low, ("solution:", "final response")))


def without_fallback_schemas(questions: DataFrame, reason: str, usable: str) -> DataFrame:
    """Rows whose schema was neither guessed nor marked unusable."""
    bad = F.lower(T.strip(F.coalesce(F.col(reason), F.lit("")))).isin(*FALLBACK_REASONS) | F.coalesce(~F.col(usable), F.lit(False))
    return questions.where(~bad)


def _metadata(name: str) -> bool:
    return name.strip().lower() in METADATA_NAMES


def said_pair(rows: DataFrame, fields: Fields, skip: tuple[str, ...] = ()) -> Column:
    """(question, answer) of a conversation inside a row, null if there is none.

    First that of the conversation column; without one, of the first column
    that holds a conversation, usual places first, if the schema points at
    conversations. Then, unless the schema is flat, that of the first column
    with a transcript. A pair needs a valid question and an answer.
    """
    none = F.lit(None).cast("struct<question:string,answer:string>")
    names = [c for c in rows.columns if c not in skip]
    low = {c: c.strip().lower() for c in names}
    good = lambda pair: T.once(pair, lambda p: F.when(T.is_valid_question(p["question"]) & (p["answer"] != ""), p))
    named = {n.strip().lower() for n in (fields.question, fields.answer, fields.rollout, fields.train) if n}
    if fields.conversation:
        spoken = good(conversations.conversation_pair(rows, fields.conversation)) if fields.conversation in names and not _metadata(fields.conversation) else none
    elif fields.kind == "conversation" or (fields.kind != "flat" and named & set(conversations.FIELDS)):
        usual = [c for f in conversations.FIELDS for c in names if low[c] == f]
        usual = usual or [c for c in names if not _metadata(c) and not low[c].endswith("_id") and any(f in low[c] for f in conversations.FIELDS)]
        order = [*usual[:1], *[c for c in names if c not in usual[:1]]]
        first = F.coalesce(*[conversations.conversation_pair(rows, c).alias("p") for c in order], none)
        spoken = good(first)
    else:
        spoken = none
    if fields.kind == "flat":
        return spoken
    usual = [c for f in ("text", "prompt", "conversation", "messages") for c in names if low[c] == f][:1]
    texts = [c for c in [*usual, *[c for c in names if c not in usual]] if not _metadata(c) and not low[c].endswith("_id") and dict(rows.dtypes)[c] == "string"]
    return F.coalesce(spoken, good(F.coalesce(*[conversations.transcript_pair(F.col(c)) for c in texts], none)))


def canonical(rows: DataFrame, fields: Fields, dataset: str, index: str, subset: str = "", split: str = "") -> DataFrame:
    """Question rows: one projection and one filter.

    A conversation inside a row becomes a worked pair, see :func:`said_pair`.
    Other rows go if the question is not valid, if a gold answer is due and
    there is none or a serialized chat, or if a judged row has no output. A
    formal proof as the gold answer makes a judged row of one with an output.
    """
    names = {fields.answer, fields.rollout or fields.answer, fields.train or fields.answer}
    flat = bool(fields.question) and fields.question not in names and not _metadata(fields.question)
    text = lambda c: T.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c else F.lit("")
    answer_is_data = not _metadata(fields.answer)
    row_id = F.coalesce(F.nullif(text(fields.row_id), F.lit("")), F.col(index).cast("string"))
    q, a = text(fields.question), text(fields.answer)
    rollout, train = text(fields.rollout or fields.answer), text(fields.train or fields.answer)
    pair = said_pair(rows, fields, skip=(index,))
    base = rows.select(q.alias("q"), a.alias("a"), rollout.alias("r"), train.alias("t"), text(fields.dedup or fields.question).alias("k"), text(fields.dedup).alias("pk"), row_id.alias("id"), pair.alias("p"))
    said = F.col("p").isNotNull()
    proof = ~said & (T.is_proof_code(F.col("a")) | T.is_proof_code(F.col("r"))) & (F.col("t") != "") & F.lit("proof" in (fields.answer + fields.rollout).lower())
    base = base.withColumns({"a": F.when(proof, "").otherwise(F.col("a")), "r": F.when(proof, "").otherwise(F.col("r")), "judged": proof})
    gold = F.coalesce(F.nullif("a", F.lit("")), F.col("r"))
    judged = (gold == "") & (F.col("judged") | F.lit(fields.method == "llm_judge") | (F.col("t") != ""))
    good = F.lit(flat) & T.is_valid_question(F.col("q")) & F.when(judged, F.col("t") != "").otherwise((gold != "") & ~T.is_serialized_chat(gold) & F.lit(answer_is_data))
    base = base.where(said | good).withColumns(
        {
            "judged": ~said & judged,
            "k": F.when(said, F.col("pk")).otherwise(F.col("k")),
            "q": F.when(said, F.col("p.question")).otherwise(F.col("q")),
            **{c: F.when(said, F.col("p.answer")).otherwise(F.col(c)) for c in ("a", "r", "t")},
        }
    )
    other = F.coalesce(F.nullif("r", F.lit("")), F.col("a"))
    style = F.when(said, "cot").otherwise(T.target_style(F.col("t"), other, F.lit(fields.style or None).cast("string")))
    return base.select(
        T.question_id(*[F.lit(p) for p in (dataset, subset, split) if p], F.col("id")).alias("question_id"),
        F.col("q").alias("question_text"), gold.alias("gold_answer"), other.alias("rollout_gold_answer"),
        F.coalesce(F.nullif("t", F.lit("")), other).alias("train_output"), style.alias("target_style"),
        F.when(F.col("judged"), "llm_judge").otherwise("gold").alias("evaluation_method"), F.col("judged").alias("needs_judge"),
        F.coalesce(F.nullif("k", F.lit("")), F.col("q")).alias("dedup_key"), F.lit(dataset).alias("source_dataset_id"),
        F.lit(subset).alias("source_dataset_subset"), F.lit(split).alias("source_dataset_split"), F.col("id").alias("source_dataset_row_id"),
        I.text_hash(F.col("q")).alias("text_hash"),
    )


def output_for_split(split: Column, marker: str = "####") -> Column:
    """The output text of a record: worked solutions with a boxed answer for training, else the answer."""
    gold = F.coalesce(F.nullif("rollout_gold_answer", F.lit("")), F.col("gold_answer"), F.lit(""))
    train = F.coalesce("train_output", F.lit(""))
    short = A.final_answer(gold)
    final = F.coalesce(F.nullif(short, F.lit("")), gold)
    reasoning = A.without_marked_answer(F.coalesce(F.nullif(train, F.lit("")), gold), marker)
    done = F.contains(reasoning, F.lit("\\boxed{")) | (final == "")
    worked = F.when(reasoning == "", A.boxed(final)).when(done, reasoning).otherwise(F.concat(reasoning, F.lit("\n\n"), A.boxed(final)))
    judged = (F.col("evaluation_method") == "llm_judge") & (gold == "")
    return F.when((split == "train") & judged, train).when((split == "train") & (F.col("target_style") == "cot"), worked).otherwise(gold)


def records(questions: DataFrame, template: str = "{question_text}") -> DataFrame:
    """Training records with the questions' other columns as metadata."""
    parts = template.split("{question_text}")
    prompt = F.concat(*[x for i, p in enumerate(parts) for x in ((F.col("question_text"), F.lit(p)) if i else (F.lit(p),))])
    others = [c for c in questions.columns if c not in ("instruction", "input", "output", "system", "history")]
    return questions.select(
        prompt.alias("instruction"), F.lit("").alias("input"), output_for_split(F.col("split")).alias("output"), F.lit("").alias("system"),
        F.array().cast("array<array<string>>").alias("history"), *others,
    )


def processed_fields(questions: DataFrame) -> DataFrame:
    """Answer, outputs and style filled from each other."""
    gold = F.coalesce(F.nullif(T.strip(F.col("rollout_gold_answer")), F.lit("")), T.strip(F.coalesce("gold_answer", F.lit(""))))
    train = F.coalesce(F.nullif(T.strip(F.col("train_output")), F.lit("")), gold)
    return questions.withColumns({"rollout_gold_answer": gold, "train_output": train, "target_style": T.target_style(train, gold, F.col("target_style"))})


def ranked_splits(available: list[str], wanted: str | None, usual: tuple[str, ...] = ("train", "test", "validation"), most: int = 6) -> list[str]:
    """Splits to try: the wanted one first if it exists; without metadata, it and the usual ones."""
    names = list(dict.fromkeys(s.strip() for s in available if s and s.strip()))
    if not names:
        return list(dict.fromkeys(s for s in (wanted, *usual) if s))[:most]
    return sorted(names, key=lambda s: s != wanted)[:most]


def exploded(rows: DataFrame, column: str) -> DataFrame:
    """Items of a map of lists as rows (group, item)."""
    return rows.select(F.explode(column).alias("group", "items")).select("group", F.explode("items").alias("item"))
