"""Numbers of nested values and of summary files; objects inside texts."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from rowloom.functions import text as T
from rowloom.sources import files, metrics


def _nested(rnd, depth):
    kind = rnd.randrange(8 if depth else 6)
    if kind < 6:
        return [1, 2.5, True, None, "7", -3e-3][kind]
    if kind == 6:
        return {f"k{i}": _nested(rnd, depth - 1) for i in range(rnd.randrange(4))}
    return [_nested(rnd, depth - 1) for _ in range(rnd.randrange(4))]


def test_flattened_equals_recursion(spark):
    rnd = random.Random(3)
    values = [{"a": _nested(rnd, 4), "b": [_nested(rnd, 3), _nested(rnd, 3)]} for _ in range(150)] + [5, [], {}, "x"]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, ""), (902, "{"), (903, '{"a": 1} rest')]
    got = metrics.flattened(spark.createDataFrame(rows, "i int, t string"), F.col("t"), "i").collect()
    want = {(i, path, x) for i, v in enumerate(values) for path, x in (files.flatten_metrics(v) if isinstance(v, (dict, list)) else [("", 5.0)] if v == 5 else [])} | {(903, "a", 1.0)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_summaries_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.json").write_text('{\n"acc": 61.5,\n"sub": [{"score": 1}]\n}')
    (tmp_path / "bad.json").write_text('{"acc": ')
    (tmp_path / "in" / "b.jsonl").write_text('{"acc": 1}\n\nno json\n{"acc": 2, "n": {"x": 3}}\n')
    (tmp_path / "in" / "c.csv").write_text("dataset,version,metric,model\nmath,1,accuracy,40.5\n\"a, b\",2,,x\n")
    (tmp_path / "d.csv").write_text("name,Metric,score,other\nm,acc,0.5,9\n")
    got = {}
    for r in metrics.read_summaries(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], {})[r.path] = r.value
    assert got == {
        "a.json": {"acc": 61.5, "sub.0.score": 1.0}, "b.jsonl": {"acc": 2.0, "n.x": 3.0},
        "c.csv": {"math.accuracy.model": 40.5, "math.accuracy": 40.5, "math.version": 1.0, "math.model": 40.5, "a, b.version": 2.0},
        "d.csv": {"m.acc": 0.5, "m.score": 0.5, "m.other": 9.0},
    }


def test_chosen_names(spark):
    rows = [(1, "x.accuracy", 40.0), (1, "x.SCORE", 0.5), (2, "a.math.acc.v", -1.0), (2, "math.bacc", 3.0), (3, "z", 1.0), (4, "b.acc", 1.0), (4, "a.acc", 0.25)]
    got = metrics.chosen(spark.createDataFrame(rows, "i int, path string, value double"), ["Math.acc", "score", "accuracy", "acc"], "i")
    assert {tuple(r) for r in got.collect()} == {(1, "x.SCORE", 0.5), (2, "a.math.acc.v", 0.0), (4, "a.acc", 0.25)}


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('{"a": 1} </think> {"b": 2}', '{"b": 2}'), ('{"a": 1} </think> none', '{"a": 1}'), ('{x {"a": 1}} {"b": 2}', '{"b": 2}'),
        (r'{"a": "\"}{"} }', r'{"a": "\"}{"}'), ('{"a": "open', None), ('{"a": "\\', None), ("}{", None), ('[{"a": 1}]', '{"a": 1}'), (None, None), ("", None),
    ],
)
def test_first_object(spark, text, found):
    assert spark.createDataFrame([(text,)], "t string").select(T.first_json_object("t")).first()[0] == found


def test_open_objects_take_one_pass(spark):
    began = time.time()
    assert list(T._objects('{"a":' * 300_000)) == [] and list(T._objects("{" * 1_000_000)) == []
    assert time.time() - began < 20
