"""Search in a catalog by all words of a query, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Words that a query's variants leave out.
STOP_WORDS = ("a", "an", "the", "and", "or", "of", "in", "to", "for", "with", "is", "on", "at", "by")


def expanded(queries: DataFrame) -> DataFrame:
    """(query_id, variant, query): each query, then its keywords, its first two and its last two; equal ones once."""
    tokens = F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda t: t != "")
    keys = F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS) & (F.length(t) > 1))
    own, n = F.array("query"), F.size(keys)
    two = F.when(n >= 2, F.array(F.array_join(keys, " "))).otherwise(F.array().cast("array<string>"))
    ends = F.when(n >= 3, F.array(F.array_join(F.slice(keys, 1, 2), " "), F.array_join(F.slice(keys, -2, 2), " "))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(own, two, ends))
    return queries.where(F.col("query").isNotNull()).select("query_id", F.posexplode(every).alias("variant", "query"))


def _words(text):
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def search(catalog: DataFrame, queries: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """(query_id, name, variant, place): entries that hold all words of a query, at most ``limit`` each.

    ``catalog``: (name, position, text); ``queries``: (query_id, query). Where
    a query itself finds nothing its variants are asked, half the limit each,
    in order, until there are enough; an entry counts once, for the first
    variant that finds it. Entries of a variant go by position. A query meets
    entries by the rarest of its words alone, and the others are looked for
    in what it meets, so frequent words make no pairs.
    """
    entries = catalog.select("name", "position", _words(F.col(text)).alias("words"))
    index = entries.select("name", "position", "words", F.explode("words").alias("word"))
    asked = expanded(queries).select("query_id", "variant", _words(F.col("query")).alias("asked")).where(F.size("asked") > 0)
    spread = asked.select("query_id", "variant", "asked", F.explode("asked").alias("word"))
    seen = index.groupBy("word").agg(F.count("*").alias("entries"))
    known = spread.join(seen, "word").groupBy("query_id", "variant", "asked").agg(F.count("*").alias("n"), F.min(F.struct("entries", "word")).alias("least"))
    rare = known.where(F.col("n") == F.size("asked")).select("query_id", "variant", "asked", F.col("least.word").alias("word"))
    hits = rare.join(index, "word").where(F.size(F.array_except("asked", "words")) == 0).select("query_id", "variant", "name", "position")
    most = F.when(F.col("variant") == 0, limit).otherwise(max(1, limit // 2))
    place = F.row_number().over(Window.partitionBy("query_id", "variant").orderBy("position", "name"))
    hits = hits.withColumn("_place", place).where(F.col("_place") <= limit).where(F.col("_place") <= most)
    # at most the limit of a variant and four variants of a query from here on
    counts = hits.groupBy("query_id", "variant").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("query_id").orderBy("variant").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.min("variant").over(Window.partitionBy("query_id"))
    use = counts.withColumns({"_before": before, "_first": first}).where(((F.col("_first") > 0) | (F.col("variant") == 0)) & (F.col("_before") < limit))
    kept = hits.join(use.select("query_id", "variant"), ["query_id", "variant"])
    once = kept.groupBy("query_id", "name").agg(F.min(F.struct("variant", "position")).alias("b"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("b.variant", "b.position", "name"))
    return once.select("query_id", "name", F.col("b.variant").alias("variant"), order.alias("place")).where(F.col("place") <= limit)
