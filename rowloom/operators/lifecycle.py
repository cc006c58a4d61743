"""Item and dataset states as the fold of an event table.

Events are rows (seq, dataset, question_id, kind, ...). An item goes
unused -> reserved -> used or defeated; a transition whose guard fails is
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fold

KINDS = ("register", "rate", "reserve", "unreserve", "use", "defeat", "mark_used", "revive")
_CODE = {"unused": 0, "reserved": 1, "used": 2, "defeated": 3}


#: Next state by kind of event, for no item yet, then for the states of _CODE in their order.
_STEPS = {
    "register": [1, 1, 2, 3, 4],
    "reserve": [0, 2, 2, 3, 4],
    "unreserve": [0, 1, 1, 3, 4],
    "use": [0, 1, 3, 3, 4],
    "defeat": [0, 1, 4, 3, 4],
    "mark_used": [0, 3, 3, 3, 3],
    "revive": [0, 1, 2, 3, 1],
}


def item_states(events: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each item: state, last rate, rollouts, defeats.

    Items count from their first register event; earlier events are ignored.
    Events of an item are folded in ranges, see :mod:`.fold`, so no task holds
    all events of an item.
    """
    keys = ["dataset", "question_id"]
    rated = lambda c: F.max_by(F.when(F.col("kind") == "rate", F.col(c)), F.when(F.col("kind") == "rate", F.col(order)))
    facts = events.groupBy(*keys).agg(
        rated("pass_rate").alias("pass_rate"), rated("rollout_count").alias("rollout_count"), F.count_if(F.col("kind") == "defeat").alias("defeats")
    )
    states = fold.final_states(events, keys, order, "kind", _STEPS).where(F.col("state") > 0)
    name = F.element_at(F.array(*[F.lit(s) for s in _CODE]), F.col("state"))
    same = [states[k].eqNullSafe(facts[k]) for k in keys]
    out = states.join(facts, same[0] & same[1])
    return out.select(*[states[k] for k in keys], name.alias("state"), "pass_rate", F.coalesce("rollout_count", F.lit(0)).alias("rollout_count"), "defeats")


def register(items: DataFrame, new: DataFrame) -> DataFrame:
    """Known items stay as they are; new ones are unused."""
    more = new.select("dataset", "question_id").distinct().join(items, ["dataset", "question_id"], "left_anti")
    return items.unionByName(more.withColumn("state", F.lit("unused")), allowMissingColumns=True)


def upsert(items: DataFrame, updates: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``columns`` of each updated item from its last update."""
    keys = ["dataset", "question_id"]
    last = updates.groupBy(*keys).agg(*[F.max_by(c, order).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = items.join(last, keys, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*items.columns)


def move(items: DataFrame, chosen: DataFrame, to: str, only_from: tuple[str, ...] = ()) -> DataFrame:
    """Chosen items to a state, if they are in one of ``only_from``."""
    keys = ["dataset", "question_id"]
    mark = chosen.select(*keys, F.lit(True).alias("_chosen")).distinct()
    guard = F.col("state").isin(*only_from) if only_from else F.lit(True)
    out = items.join(mark, keys, "left")
    return out.withColumn("state", F.when(F.col("_chosen") & guard, to).otherwise(F.col("state"))).select(*items.columns)


def finalized(items: DataFrame, reserved: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reserved items after the decision on the last round that reserved them.

    ``reserved``: (dataset, question_id, round_id); ``decisions``: (round_id,
    decision, probe_acc, reusable). A promotion, also a provisional one, uses
    items up; a rollback whose data can be tried again leaves them reserved;
    all else defeats them. A defeat adds to ``defeats`` and sets
    ``defeated_round`` and ``defeated_accuracy``. Items in other states, or
    without a decision, stay as they are.
    """
    keys = ["dataset", "question_id"]
    to = (
        F.when(F.col("decision").isin("promote", "provisional_promote"), "used")
        .when((F.col("decision") == "rollback") & F.col("reusable"), "reserved")
        .otherwise("defeated")
    )
    last = reserved.groupBy(*keys).agg(F.max("round_id").alias("_round"))
    met = last.join(decisions.select(F.col("round_id").alias("_round"), to.alias("_to"), F.col("probe_acc").alias("_acc")), "_round")
    hit = (F.col("state") == "reserved") & F.col("_to").isNotNull()
    lost = hit & (F.col("_to") == "defeated")
    return items.join(met, keys, "left").withColumns(
        {
            "state": F.when(hit, F.col("_to")).otherwise(F.col("state")),
            "defeats": F.coalesce("defeats", F.lit(0)) + F.when(lost, 1).otherwise(0),
            "defeated_round": F.when(lost, F.col("_round")).otherwise(F.col("defeated_round")),
            "defeated_accuracy": F.when(lost, F.col("_acc")).otherwise(F.col("defeated_accuracy")),
        }
    ).select(*items.columns)


def revived(items: DataFrame, accuracy: Column, gain: float = 0.05) -> DataFrame:
    """Defeated items are unused again once accuracy rose by ``gain`` since their defeat."""
    back = (F.col("state") == "defeated") & (accuracy - F.col("defeated_accuracy") >= gain)
    return items.withColumn("state", F.when(back, "unused").otherwise(F.col("state")))


def dataset_counts(items: DataFrame) -> DataFrame:
    """Items, and those by state, of each dataset."""
    own = [F.count_if(F.col("state") == s).alias(s) for s in _CODE]
    return items.groupBy("dataset").agg(F.count("*").alias("n"), *own)


def exhausted(items: DataFrame, least: int = 1) -> DataFrame:
    """Datasets with fewer unused items than ``least``."""
    return dataset_counts(items).where(F.col("unused") < max(1, least)).select("dataset", "unused")


def unused_by(items: DataFrame, column: str) -> DataFrame:
    return items.where("state = 'unused'").groupBy(column).agg(F.count("*").alias("n"))


def blocked_until(failures: DataFrame, wait: float, after: int = 1) -> DataFrame:
    """Failures (dataset, at) of each dataset, and when its pause ends; no pause before ``after`` failures."""
    out = failures.groupBy("dataset").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return out.withColumn("until", F.when(F.col("n") >= max(1, after), F.col("last") + F.lit(wait)))


def paused(failures: DataFrame, now: float, wait: float, after: int = 1, cleared: DataFrame | None = None) -> DataFrame:
    """Datasets whose pause lasts at ``now``, and what ``remaining`` of it; failures up to a dataset's last clearing (dataset, at) do not count."""
    if cleared is not None:
        last = cleared.groupBy("dataset").agg(F.max("at").alias("_cleared"))
        failures = failures.join(last, "dataset", "left").where(F.col("_cleared").isNull() | (F.col("at") > F.col("_cleared"))).drop("_cleared")
    return blocked_until(failures, wait, after).where(F.col("until") > F.lit(now)).withColumn("remaining", F.col("until") - F.lit(now))


def reset_labels(items: DataFrame) -> DataFrame:
    """Unused items lose their rates, to be rolled out anew."""
    stale = (F.col("state") == "unused") & (F.col("rollout_count") > 0)
    return items.withColumns({"pass_rate": F.when(stale, 0.0).otherwise(F.col("pass_rate")), "rollout_count": F.when(stale, 0).otherwise(F.col("rollout_count"))})


def window_offset(index: Column, size: int) -> Column:
    """The offset of a row number's window."""
    return F.floor(index / size) * size


def index_of(question: Column) -> Column:
    """The row number at the end of a question id, null without one."""
    return F.nullif(F.regexp_extract(question, r"_(\d+)$", 1), F.lit("")).cast("long")


def next_offsets(items: DataFrame, size: int) -> DataFrame:
    """Per dataset: rows seen, and the first window offset that none of them is in."""
    seen = items.select("dataset", (window_offset(F.col("idx"), size) / size).cast("long").alias("w"), "idx")
    per = seen.groupBy("dataset", "w").agg(F.max("idx").alias("idx"))
    place = F.row_number().over(Window.partitionBy("dataset").orderBy("w")) - 1
    gap = per.withColumn("p", place)
    return gap.groupBy("dataset").agg(
        (F.max("idx") + 1).alias("next_row"), (F.count_if(F.col("w") == F.col("p")) * size).alias("next_offset")
    )


def reuse_score(items: DataFrame, needs: dict[str, int], size: int) -> DataFrame:
    """Windows by how well their rows serve the needs by difficulty, the best first."""
    need = F.lit(0)
    for key, n in needs.items():
        need = F.when(F.col("difficulty") == key, n).otherwise(need)
    counts = items.groupBy("dataset", window_offset(F.col("idx"), size).alias("offset"), "difficulty").agg(F.count("*").alias("n"))
    scored = counts.groupBy("dataset", "offset").agg(F.sum(F.least("n", need) * need).alias("score"), F.sum("n").alias("total"))
    return scored.orderBy(F.col("score").desc(), F.col("total").desc(), F.col("offset"))
