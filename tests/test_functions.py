"""Text, answers and identity against plain Python on hand-made rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rowloom.functions import answers as A
from rowloom.functions import identity as I
from rowloom.functions import text as T


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **inputs):
        df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs)) if inputs else spark.range(1)
        return df.select(column.alias("x")).first()[0]

    return value


TEXTS = ["", "  Hello,  WORLD! ", "é Ünï-code_x", "a\t\nb", "...", "日本 text", None]


@pytest.mark.parametrize("text", TEXTS)
def test_fuzzy(one, text):
    want = None if text is None else re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", text.lower().strip()))
    assert one(T.fuzzy(F.col("t")), t=text) == want


def test_punctuation_goes_after_blanks_collapse(one):
    assert one(T.fuzzy(F.col("t")), t="a - b") == "a  b"


def test_language_needs_more_than_fifteen_percent(one):
    assert one(T.language(F.col("t")), t="解" * 3 + "a" * 17) == "en"
    assert one(T.language(F.col("t")), t="解" * 4 + "a" * 16) == "zh"
    assert one(T.language(F.col("t")), t="") == one(T.language(F.col("t")), t=None) == "unknown"


def test_module_counts_keywords_and_prefers_the_first(one):
    assert one(T.module_of(F.col("t")), t="The person") == "ratio_rate"  # per
    assert one(T.module_of(F.col("t")), t="area and price") == "money_cost"
    assert one(T.module_of(F.col("t")), t="7 xx") == "arithmetic_misc"
    assert one(T.module_of(F.col("t")), t=None) == "unknown"


def test_grams_are_distinct_characters(one):
    grams = T.char_grams(F.col("t"), F.lit(3))
    assert len(one(grams, t="ababab")) == 2
    assert one(grams, t="ab") == [] == one(grams, t=None)


def test_serialized_chat(one):
    assert one(T.is_serialized_chat(F.col("t")), t='[{"role": "user", "content": "x"}]')
    assert one(T.is_serialized_chat(F.col("t")), t="[user: a assistant: b]")
    assert not one(T.is_serialized_chat(F.col("t")), t="the role of content")


def test_target_style(one):
    style = T.target_style(F.col("o"), F.col("g"), F.col("e"))
    assert one(style, o="5", g="5", e=None) == "answer"
    assert one(style, o="x" * 600, g="x" * 600, e=None) == "cot"
    assert one(style, o="long way", g="5", e=None) == "cot"
    assert one(style, o="long way", g="5", e="answer") == "answer"
    assert one(style, o=None, g="5", e="cot") == "answer"


def test_content_words(one):
    assert one(T.content_words(F.col("q")), q="HuggingFace math dataset search for algebra, geometry proofs now") == ["math", "algebra", "geometry", "proofs"]
    assert one(T.content_words(F.col("q")), q="easy difficulty") == []


def test_first_json_object(one):
    assert one(T.first_json_object(F.col("t")), t='so {bad} then {"a": {"b": "}"}} end') == '{"a": {"b": "}"}}'
    assert one(T.first_json_object(F.col("t")), t="none") is None


def test_boxed_nests_and_takes_the_last(one):
    assert one(A.last_boxed(F.col("t")), t=r"\boxed{1} and \boxed{\frac{1}{2}}") == r"\frac{1}{2}"
    assert one(A.last_boxed(F.col("t")), t=r"\boxed{1} and \boxed{2") == "1"
    assert one(A.last_boxed(F.col("t")), t=None) == ""


def test_final_answer_order(one):
    answer = A.final_answer(F.col("t"), A.last_boxed(F.col("t")))
    assert one(answer, t=r"#### 3 \boxed{4}") == "4"
    assert one(answer, t="x #### 1 #### 72 ") == "72"
    assert one(answer, t="The answer is  5 apples\nno") == "5 apples"
    assert one(answer, t="3 then 4.5") == "4.5"
    assert one(answer, t="none") == ""
    assert one(answer, t="12345678") == "12345678.0"


def test_numeric_match(one):
    match = A.numeric_match(F.col("a"), F.col("b"))
    assert one(match, a="1 then 2", b="= 2.0")
    assert not one(match, a="1 2", b="1 3")
    assert one(match, a="none", b="3") is False
    assert one(match, a=None, b="3") is False


def test_training_output(one):
    out = A.training_output(F.col("r"), F.col("a"))
    assert one(out, r="", a="5") == r"\boxed{5}"
    assert one(out, r="so 5", a="5") == "so 5"
    assert one(out, r="hence", a="5") == "hence\n\n\\boxed{5}"


def test_marker_tail(one):
    assert one(A.without_marked_answer(F.col("t")), t=" a #### b #### c") == "a #### b"
    assert one(A.without_marked_answer(F.col("t")), t=" a ") == "a"


def test_identity_rules(one):
    c = {n: F.col(n) for n in ("d", "r", "t", "q")}
    single, many = I.single_key(c["d"], c["r"], c["t"], c["q"]), I.key_set(c["d"], c["r"], c["t"], c["q"])
    assert one(single, d="x", r="1", t="a", q="q1").startswith("row")
    assert one(single, d="x", r="", t="a", q="q1") == "txt\x1f" + hashlib.sha256(b"a").hexdigest()
    assert one(single, d="", r="", t=" ", q="q1") == "qid\x1fq1"
    assert len(one(many, d="x", r="1", t="a", q="q1")) == 2
    assert len(one(many, d=None, r=None, t="a", q="q1")) == 1
    assert one(I.text_hash(F.col("t")), t=" a ") == hashlib.sha256(b"a").hexdigest()
