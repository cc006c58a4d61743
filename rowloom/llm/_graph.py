"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored


def _stars(both: DataFrame) -> DataFrame:
    """Each edge of ``u`` together with the least node around ``u``."""
    return both.join(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node of an edge; the root is the least node reachable.

    Each round makes two aggregations and joins over the edges, never a list
    of neighbours, and is written out. Rounds grow with the logarithm of the
    longest path. Self-loops and repeated edges do no harm.
    """
    e = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "components"
    )
    seen = None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        s = _stars(large).select("u", "v", "m")
        small = s.select("u", F.col("m").alias("v")).unionByName(s.select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = stored(small.where("u > v").distinct(), "components")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
