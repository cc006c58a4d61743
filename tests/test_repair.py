"""Conversations inside rows of any schema become question and answer rows."""

import json

import pytest
from pyspark.sql import functions as F

from rowloom.operators import conversations, normalize

CHAT = [{"role": "system", "content": "be brief"}, {"role": "USER ", "content": " what is it? "}, {"role": "assistant", "content": "first"}, {"role": "user", "content": "and?"}, {"role": "gpt", "content": "last"}]
PAIR = ("what is it?", "last")

CASES = [
    (json.dumps(CHAT), PAIR),
    (json.dumps({"id": 7, "messages": [{"from": "human", "value": "q"}, {"from": "bot", "value": "a"}]}), ("q", "a")),
    (json.dumps({"conversations": "no list", "turns": [{"speaker": "prompt", "text": "q"}, {"speaker": "model", "text": "a"}]}), ("q", "a")),
    (str(CHAT), PAIR),
    ("[{'from': 'human', 'value': \"it's q\"}, {'from': 'gpt', 'value': 'a'}]", ("it's q", "a")),
    (json.dumps(["first text", "", "mid", "last text"]), ("first text", "last text")),
    (json.dumps(["only one"]), None),
    (json.dumps([{"content": "x"}, {"role": "narrator", "content": "y"}, {"role": "user", "content": "u"}]), ("x", "y")),
    (json.dumps([{"role": "user", "content": "u"}, {"role": "user", "content": "v"}]), None),
    (json.dumps([{"role": "user", "content": None, "value": "", "text": "u"}, {"role": "assistant", "content": {"k": 1}}]), ("u", '{"k":1}')),
    (json.dumps({"other": [1, 2]}), None),
    ("Preface\nUser: q one\nmore\nAssistant: a\nNote: stays\nuser: again\nResponse : end", ("q one\nmore", "end")),
    ("User: q\nUser: r", None),
    ("user says: hello", None),
    ("plain text", None), ("", None), ("   ", None), (None, None), ("[broken", None), ("[1, 2]", ("1", "2")), ("{'a': 1}", None), ("null", None), ("3", None),
]


def test_pairs_of_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: (r.p.question, r.p.answer) if r.p else None for r in df.select("i", conversations.conversation_pair(df, "t").alias("p")).collect()}
    assert got == {i: p for i, (_, p) in enumerate(CASES)}


def test_pairs_of_lists(spark):
    df = spark.createDataFrame([(CHAT,), (None,), ([],)], "t array<map<string,string>>")
    got = df.select(conversations.conversation_pair(df, "t").alias("p"), F.lit(1).alias("x")).collect()
    assert [(r.p.question, r.p.answer) if r.p else None for r in got] == [PAIR, None, None]
    flat = spark.createDataFrame([(["a", "b"], 5)], "t array<string>, n int")
    assert tuple(flat.select(conversations.conversation_pair(flat, "t").alias("p")).first().p) == ("a", "b")
    assert flat.select(conversations.conversation_pair(flat, "n").alias("p")).first().p is None


def _rows(df, fields):
    return {r.source_dataset_row_id: (r.question_text, r.gold_answer, r.target_style, r.dedup_key) for r in normalize.canonical(df, fields, "d", "n").collect()}


def test_rows_with_chats_in_the_answer(spark):
    rows = [
        (1, "k1", "what?", json.dumps(CHAT), None),
        (2, "k2", "what?", "42", None),
        (3, "k3", "what?", "x", "Human: q\nBot: a"),
        (4, "k4", "12345", "x", None),
        (5, "k5", "what?", json.dumps([{"role": "user", "content": "u"}, {"role": "user", "content": "u"}]), None),
        (6, "", "what?", json.dumps([{"role": "user", "content": "99"}, {"role": "assistant", "content": "no valid question"}]), None),
    ]
    df = spark.createDataFrame(rows, "n int, key string, ask string, messages string, note string")
    got = _rows(df, normalize.Fields(question="ask", answer="messages", dedup="key"))
    assert got == {"1": (*PAIR, "cot", "k1"), "2": ("what?", "42", "answer", "k2"), "3": ("q", "a", "cot", "k3")}
    # a flat schema looks for none; a schema that names no conversation still finds transcripts
    flat = _rows(df, normalize.Fields(question="ask", answer="messages", dedup="key", kind="flat"))
    assert set(flat) == {"2", "3"} and flat["3"][:2] == ("what?", "x")
    other = _rows(df.withColumnRenamed("messages", "reply"), normalize.Fields(question="ask", answer="reply"))
    assert set(other) == {"2", "3"} and other["3"][:2] == ("q", "a")


def test_a_conversation_column_needs_no_question(spark):
    df = spark.createDataFrame([(1, json.dumps(CHAT), "x"), (2, "nothing", "x")], "n int, story string, id string")
    assert _rows(df, normalize.Fields(question="", conversation="story")) == {"1": (*PAIR, "cot", PAIR[0])}
    assert _rows(df, normalize.Fields(question="", kind="conversation")) == {"1": (*PAIR, "cot", PAIR[0])}
    assert _rows(df, normalize.Fields(question="story", answer="story")) == {}


@pytest.mark.parametrize("n", [0, 1])
def test_only_literals_go_to_python(spark, n):
    df = spark.createDataFrame([("{}" if n else "[]",)], "t string")
    assert df.select(conversations.conversation_pair(df, "t", literals=False).alias("p")).first().p is None
    plan = df.select(conversations.conversation_pair(df, "t", literals=False).alias("p"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
