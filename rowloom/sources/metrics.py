"""Numbers of nested JSON and of summary files, flattened where the rows are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.written import forget, written

# Columns of a summary that name its rows, hold their score, or are no model's score.
_NAMES, _METRIC, _SCORES = ("dataset", "name", "abbr"), ("metric", "Metric"), ("score", "Score", "value", "Value")
_ASIDE = {*_NAMES, *_METRIC, "version", "mode"}


def flattened(rows: DataFrame, json: Column, *keys: str) -> DataFrame:
    """(keys, path, value): every number in the nested objects and lists of ``json``, by dotted path.

    Places in lists count from 0; texts, booleans and nulls are no numbers. A
    bare number has the empty path. Null, empty and malformed JSON, and objects
    with a name twice, give no rows; what follows a whole value is not read. One step a level of nesting: objects and
    lists are exploded by the executors, and each level is written.
    """
    level = rows.select(*keys, F.lit("").alias("path"), F.try_parse_json(json).alias("_v"))
    found, last = [], None
    while True:
        level = written(level.withColumn("_kind", F.regexp_extract(F.schema_of_variant("_v"), "^[A-Z]+", 0)), "level")
        numbers = level.where(F.col("_kind").isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"))
        found.append(written(numbers.select(*keys, "path", F.try_variant_get("_v", "$", "double").alias("value")), "numbers"))
        nested = level.where(F.col("_kind").isin("OBJECT", "ARRAY"))
        if last is not None:
            forget(last)
        if nested.isEmpty():
            forget(level)
            break
        inner = nested.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        name = F.coalesce("key", F.col("pos").cast("string"))
        path = F.when(F.col("path") == "", name).otherwise(F.concat("path", F.lit("."), name))
        last, level = level, inner.select(*keys, path.alias("path"), F.col("value").alias("_v"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _number(text: str | None) -> float | None:
    try:
        return float(str(text).strip())
    except ValueError:
        return None


def _of_row(row: dict, place: int) -> dict[str, float]:
    """A summary row's numbers: its metric's score, else the models' scores; then each column's."""
    title = next((row[c] for c in _NAMES if row.get(c)), str(place))
    metric = next((row[c] for c in _METRIC if row.get(c)), "").strip()
    numbers = {c: x for c, v in row.items() if c is not None and (x := _number(v)) is not None}
    out = {}
    if metric:
        score = next((numbers[c] for c in _SCORES if c in numbers), None)
        if score is None:
            models = {c: x for c, x in numbers.items() if c not in _ASIDE}
            out = {f"{title}.{metric}.{c}": x for c, x in models.items()}
            score = next(iter(models.values())) if len(models) == 1 else None
        if score is not None:
            out[f"{title}.{metric}"] = score
    return out | {f"{title}.{c}": x for c, x in numbers.items()}


def _csv(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import csv
    import io

    for batch in batches:
        rows = []
        for file, text in zip(batch["file"], batch["value"], strict=True):
            numbers: dict[str, float] = {}
            for place, row in enumerate(csv.DictReader(io.StringIO(text, newline=""))):
                numbers |= _of_row(row, place)
            rows += [(file, path, x) for path, x in numbers.items()]
        yield pd.DataFrame(rows, columns=["file", "path", "value"])


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """(file, path, value): the numbers of all ``.json``, ``.jsonl`` and ``.csv`` files below a folder.

    Lines of one file may repeat a path: the last counts. A malformed file, or
    line, gives nothing. Summary files of JSON and CSV are read whole, each by
    one task; those of JSON lines may be split.
    """

    def text(ending: str, whole: bool) -> DataFrame:
        read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{ending}")
        return read.text(folder, wholetext=whole).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    whole = flattened(text("json", True), F.col("value"), "file")
    lines = flattened(text("jsonl", False).withColumn("at", F.monotonically_increasing_id()), F.col("value"), "file", "block", "at")
    lines = lines.groupBy("file", "path").agg(F.max_by("value", F.struct("block", "at")).alias("value"))
    tables = text("csv", True).select("file", "value").mapInPandas(_csv, "file string, path string, value double")
    return whole.unionByName(lines).unionByName(tables)


def chosen(metrics: DataFrame, preferred: list[str], *keys: str) -> DataFrame:
    """Per ``keys``, (path, score) of the first preferred name that a path holds; the lesser path on ties.

    A plain name must be the last part of a path, a dotted one some of its
    parts in a row; case is ignored. Percents become shares within 0 and 1.
    """
    dotted = F.concat(F.lit("."), F.lower("path"), F.lit("."))
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(preferred))):
        part = F.lit(f".{name.lower()}.")
        rank = F.when(F.contains(dotted, part) if "." in name else F.endswith(dotted, part), i).otherwise(rank)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_rank", "path"))
    best = metrics.withColumn("_rank", rank).where(F.col("_rank").isNotNull()).withColumn("_place", place).where(F.col("_place") == 1)
    share = F.when(F.col("value") > 1, F.col("value") / 100).otherwise(F.col("value"))
    return best.select(*keys, "path", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).alias("score"))
