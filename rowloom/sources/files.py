"""Readers and writers for samples, windows, metrics and logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import non_blank


def read_samples(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON array or JSON lines; lines that do not parse are left out.

    Files whose first character is ``[`` are arrays.
    """
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(head) and head[0][0].lstrip().startswith("[")
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema is not None else reader).json(path, multiLine=array)


def window(rows: DataFrame, index: str, offset: int, limit: int, accept=None) -> DataFrame:
    """The first ``limit`` accepted rows from raw row ``offset`` on."""
    own = rows.where(F.col(index) >= offset)
    return (own if accept is None else own.where(accept)).orderBy(index).limit(limit)


def window_facts(dataset: str, split: str, offset: int, limit: int, loaded: int) -> dict:
    """Identity of a window, and whether its dataset ended in it."""
    return {"window_id": f"{dataset}:{split}:{offset}:{limit}", "offset": offset, "limit": limit, "exhausted": loaded < limit}


def shards(sizes: DataFrame, size: int, key: str = "dataset", rows: str = "n") -> DataFrame:
    """References to the shards of ``size`` rows that tables (key, rows) are cut into, with falling scores."""
    n = F.ceil(F.col(rows) / size)
    i = F.col("shard_id")
    cut = sizes.where(F.col(rows) > 0).select(key, rows, n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("shard_id"))
    return cut.select(key, "shard_id", (i * size).alias("first"), F.least((i + 1) * size, F.col(rows)).alias("end"), (1 - i / F.col("_n") * 0.01).alias("score"))


def search_catalog(catalog: DataFrame, queries: list[str], limit: int, name: str = "name", order: str = "position") -> DataFrame:
    """Entries whose name holds all words of a query: the first query's first, each entry once."""
    found = None
    for rank, q in enumerate(queries):
        hits = catalog
        for word in q.lower().split():
            hits = hits.where(F.contains(F.lower(F.col(name)), F.lit(word)))
        hits = hits.withColumn("_rank", F.lit(rank))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return catalog.limit(0)
    best = found.groupBy(name).agg(F.min(F.struct("_rank", order)).alias("_b"))
    return catalog.join(best, name).orderBy("_b._rank", f"_b.{order}").limit(limit).drop("_b")


def prompts(rows: DataFrame, prompt_fields: list[str], gold_fields: list[str]) -> DataFrame:
    """prompt and gold: the first field of each that is not blank; rows without a prompt go."""
    have = lambda fs: [F.col(f).cast("string") for f in fs if f in rows.columns] or [F.lit(None).cast("string")]
    out = rows.withColumns({"prompt": non_blank(*have(prompt_fields)), "gold": F.coalesce(non_blank(*have(gold_fields)), F.lit(""))})
    return out.where(F.col("prompt").isNotNull())


def bank(questions: DataFrame, index: str, holdout_from: int) -> DataFrame:
    """Questions with their role: from an index on they are held out. Blank ones go."""
    kept = questions.where(F.trim(F.coalesce("question_text", F.lit(""))) != "")
    return kept.withColumn("role", F.when(F.col(index) >= holdout_from, "probe_holdout").otherwise("train_pool"))


def flatten_metrics(values: Mapping, prefix: str = "") -> list[tuple[str, float]]:
    """Numbers of nested mappings and lists by dotted path."""
    out: list[tuple[str, float]] = []
    items = values.items() if isinstance(values, Mapping) else enumerate(values) if isinstance(values, list) else ()
    for key, v in items:
        path = f"{prefix}.{key}" if prefix else str(key)
        if isinstance(v, bool):
            continue
        if isinstance(v, (int, float)):
            out.append((path, float(v)))
        else:
            out += flatten_metrics(v, path)
    return out


def choose_metric(metrics: DataFrame, preferred: list[str]) -> DataFrame:
    """The value of the first preferred name that ends a path; percents become shares within 0 and 1."""
    last = F.lower(F.element_at(F.split("path", r"\."), -1))
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(preferred))):
        rank = F.when(last == name.lower(), i).otherwise(rank)
    ranked = metrics.withColumn("_rank", rank).where(F.col("_rank").isNotNull()).orderBy("_rank", "path").limit(1)
    share = F.when(F.col("value") > 1, F.col("value") / 100).otherwise(F.col("value"))
    return ranked.select("path", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).alias("score"))


def read_train_log(spark: SparkSession, path: str) -> DataFrame:
    """Numeric columns of a trainer's JSON lines."""
    schema = "current_steps long, step long, loss double, eval_loss double, lr double, learning_rate double, epoch double, throughput double"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.select(
        F.coalesce("step", "current_steps").alias("step"), "loss", "eval_loss", F.coalesce("learning_rate", "lr").alias("learning_rate"), "epoch", "throughput"
    )


def write_splits(rows: DataFrame, path: str) -> DataFrame:
    """JSON lines by split; returns the counts."""
    rows.write.mode("overwrite").partitionBy("split").json(path)
    return rows.groupBy("split").agg(F.count("*").alias("n"))


def write_pack(rows: DataFrame, path: str, name: str) -> dict:
    """Training records as JSON and the entry that registers them with a trainer."""
    rows.write.mode("overwrite").json(f"{path}/{name}")
    chat = "conversations" in rows.columns
    entry: dict = {"file_name": name, "formatting": "sharegpt" if chat else "alpaca"}
    if not chat:
        entry["columns"] = {"prompt": "instruction", "query": "input", "response": "output", "system": "system", "history": "history"}
    return {name: entry}


def append_trace(rows: DataFrame, path: str) -> None:
    """Trace rows below their round and stage."""
    rows.write.mode("append").partitionBy("round_id", "stage").parquet(path)
