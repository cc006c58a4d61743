"""Near-duplicate documents from bottom-k sketches of word shingles.

One hash function orders all shingles; a document keeps its ``SKETCH``
smallest. Texts with equal sets form a class, and only classes are compared.

Candidates come from inverted lists of retained values. Two sets as alike as
the threshold share at least ``_shared(...)`` retained values (five standard
deviations below the mean for sets beyond the sketch, exactly for smaller
ones), so they share one among each one's rarest values, and only those are
listed. Classes are paired in three passes, each of which leaves out pairs
that the links before have connected, so that groups of copies make about as
many pairs as members and no link that would join two components is lost:

1. each class with the most central class of its lists, the one whose
   retained values are the most common;
2. classes of lists that are still not one component list the rarest of all
   their shingles, as many as must meet those of any partner; each is paired
   with the class of such a list that has the fewest shingles to itself;
3. all other classes that meet in such a list. Those before a common shingle
   in both lists' order bound what two classes can share, which rules out
   most pairs.

The union sketch of a pair estimates its Jaccard similarity and drops
hopeless pairs; full sets confirm the rest.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text with fewer words
than a shingle is one shingle; null and empty texts have none and are linked
with nothing. Repeated rows are each returned; equal texts fall together
whatever their identifiers. Null identifiers are allowed; a component's
identifier is the smallest that is not null. An empty table gives an empty
one, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._graph import components
from ._shared import small_batches, stored

SKETCH = 48
WIDTH = 5
PERCENT = 80
_ALL = 1 << 40  # a sketch of all values
_U = np.uint64


def _shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    for w in _text.words(column, _text.LOWER):
        runs = _text.rolling(w.hash, width)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            else:
                yield _text.rolling(w.hash[a:b], b - a) if b > a else np.empty(0, _U)


def _class(shingles: np.ndarray) -> int:
    """A number that equal sets share."""
    own = _text.mix(shingles ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) + _U(len(shingles))
    return int(_text.mix(np.array([own], _U)).astype(np.int64)[0])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own, low = [], [], []
            for s in _shingle_sets(batch.column(1), width):
                n.append(len(s))
                own.append(_class(s) if len(s) else None)
                low.append(s[:k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(own, pa.int64()), _lists(low)],
                names=["doc_id", "n_shingles", "class", "sketch"],
            )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, got, own = batch.column(0).to_pylist(), [], []
            for c, s in zip(asked, _shingle_sets(batch.column(1), width), strict=True):
                if len(s) and _class(s) == c:  # else another text of that identifier
                    own.append(c)
                    got.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), _lists(got)], names=["class", "shingles"])

    return run


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, ``class`` (null without words) and the bottom-k ``sketch`` of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_sketches(width, k), f"doc_id {kind}, n_shingles long, class long, sketch array<long>")


def _shared(k: int, percent: int) -> int:
    """Retained values that sets of that similarity share at least, if neither fits in its sketch."""
    p = percent / 100
    return max(1, math.floor(k * p - 5 * math.sqrt(k * p * (1 - p))))


def _listed(n: Column, k: int, percent: int) -> Column:
    """How many of its rarest values a set of ``n`` shingles must list."""
    complete = n * 100 <= F.lit(k * percent)  # then any partner's set fits in its sketch, too
    exact = n - F.ceil(n * percent / 100) + 1
    return F.when(complete, exact).otherwise(F.least(n, F.lit(k)) - _shared(k, percent) + 1)


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _inverted(sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (value, class, n, at, alone, weight): the listed values that at least two classes retain.

    ``at`` is the value's place among its class's values, the rarest first;
    ``alone`` counts those that no other class has; ``weight`` grows with the
    number of classes that share the class's values.
    """
    values = sets.select("class", "n", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("class")
    ranked = values.join(common, "value").withColumns(
        {
            "place": F.row_number().over(own.orderBy("df", "value")),
            "alone": F.least("n", F.lit(k)) - F.count("*").over(own),
            "weight": F.round(F.sum(F.log2("df")).over(own), 3),
        }
    )
    ranked = ranked.withColumn("at", F.col("place") + F.col("alone"))
    return ranked.where(F.col("at") <= _listed(F.col("n"), k, percent)).select("value", "class", "n", "at", "alone", "weight")


def _sets(classes: DataFrame, wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Rows (class, shingles) of the wanted classes."""
    asked = classes.join(wanted, "class", "left_semi").select("class", F.col("doc").alias("asked"))
    texts = asked.join(docs, F.col("asked").eqNullSafe(F.col("doc_id"))).select("class", "text")
    made = texts.mapInArrow(_full_sets(width), "class long, shingles array<long>")
    return stored(made.dropDuplicates(["class"]), "near-sets")


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike, after the estimate from union sketches."""
    one = classes.select(F.col("class").alias("a"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("class").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    inside = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    full = F.size(union) < k  # then the estimate is exact
    enough = F.when(full, inside * 100 >= F.size(union) * percent).otherwise(inside >= _shared(k, percent))
    hopeful = stored(both.where(enough).select("a", "b"), "near-pairs")
    left = hopeful.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), "a")
    whole = left.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return stored(whole.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b"), "near-links")


def _stars(lists: DataFrame, head: Column, apart: Column) -> DataFrame:
    """Each class with one head of its lists, the one that it meets most often."""
    heads = lists.groupBy("value").agg(F.max(head).alias("h"))
    met = lists.join(heads, "value").where((F.col("class") != F.col("h.class")) & apart)
    return (
        met.groupBy(F.col("class").alias("a"), F.col("h.class").alias("b"))
        .agg(F.count("*").alias("n"))
        .groupBy("a")
        .agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    )


def _open_lists(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Lists that hold several components, with each class's root."""
    roots = components(links).withColumnRenamed("node", "class")
    known = lists.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    several = known.groupBy("value").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("value")
    return stored(known.join(several, "value", "left_semi"), "near-open")


def _can_link(n: Column, at: Column, m: Column, place: Column, percent: int) -> Column:
    """Whether sets of n and m values whose first common one has these places can be alike."""
    most = F.least(n - at, m - place) + 1
    return most * 100 >= (n + m - most) * percent


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, k: int = SKETCH
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(sketches(docs, width=width, k=k), "near-sketches")
    classes = stored(
        rows.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")),
        "near-classes",
    )
    lists = stored(_inverted(classes, k, percent), "near-lists")

    near = _alike(F.col("n"), F.col("h.n"), percent)
    sets = _sets(classes, lists.select("class").distinct(), docs, width)
    links = _confirmed(_stars(lists, F.struct("weight", "class", "n"), near), classes, sets, k, percent)

    left = _open_lists(lists, links).select("class").distinct()
    whole = sets.join(left, "class", "left_semi").select("class", F.size("shingles").cast("long").alias("n"), F.col("shingles").alias("sketch"))
    lists = stored(_inverted(whole, _ALL, percent), "near-lists")
    left = _open_lists(lists, links)
    apart = (F.col("root") != F.col("h.root")) & _can_link(F.col("n"), F.col("at"), F.col("h.n"), F.col("h.at"), percent)
    central = F.struct((-F.col("alone") / F.col("n")).alias("share"), "class", "n", "at", "root")
    links = links.unionByName(_confirmed(_stars(left, central, apart), classes, sets, k, percent))

    left = _open_lists(lists, links)
    one = left.select("value", F.col("class").alias("a"), F.col("n").alias("na"), F.col("at").alias("ta"), F.col("root").alias("ra"))
    two = left.select("value", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("at").alias("tb"), F.col("root").alias("rb"))
    apart = (F.col("a") > F.col("b")) & (F.col("ra") != F.col("rb"))
    rest = one.join(two, "value").where(apart & _can_link(F.col("na"), F.col("ta"), F.col("nb"), F.col("tb"), percent))
    links = links.unionByName(_confirmed(rest.select("a", "b").distinct(), classes, sets, k, percent))
    roots = components(links).withColumnRenamed("node", "class")

    placed = classes.join(roots, "class", "left").select("class", "doc", F.coalesce("root", "class").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = placed.join(least, "root").select("class", "component_id")
    out = rows.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
