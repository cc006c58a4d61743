"""The graph of experiments: nodes, edges, choices among actions."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spread import looked_up
from .written import forget, written

# Exploration weights for nodes and for actions.
EXPLORE_NODE, EXPLORE_ACTION = 0.1, 0.15


def action_statistics(edges: DataFrame, action: str = "action_key", reward: str = "reward") -> DataFrame:
    good = edges.where((F.coalesce(action, F.lit("")) != "") & F.col(reward).isNotNull())
    return good.groupBy(action).agg(F.count("*").alias("visits"), F.sum(reward).alias("reward_sum"))


def rank_actions(actions: DataFrame, edges: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Actions (action_key, position) with visits, mean and upper bound; ``rank`` 1 is chosen.

    Untried actions come first, the earlier on ties.
    """
    out = actions.join(action_statistics(edges), "action_key", "left").fillna(0, ["visits"]).fillna(0.0, ["reward_sum"])
    if evidence is not None:
        out = out.join(evidence.select("action_key", "evidence"), "action_key", "left").fillna(0.0, ["evidence"])
    else:
        out = out.withColumn("evidence", F.lit(0.0))
    total = F.sum("visits").over(Window.partitionBy()) + 1
    mean = F.col("reward_sum") / F.greatest(F.col("visits"), F.lit(1))
    bound = mean + EXPLORE_ACTION * F.sqrt(F.ln(total + 1) / F.greatest(F.col("visits"), F.lit(1))) + F.col("evidence")
    out = out.withColumns({"mean_reward": mean, "score": F.when(F.col("visits") == 0, F.lit(float("inf"))).otherwise(bound)})
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "position")))


def next_parent(nodes: DataFrame, candidates: DataFrame | None = None, fallback: str | None = None) -> DataFrame:
    """``node_id`` to branch from: any untried node, else the most valuable; the first listed (``position``) on ties.

    Only nodes of ``candidates`` (node_id) are choices, unless none of them is
    known. Without nodes, or for a node without an id, it is ``fallback``.
    """
    untried = F.coalesce(F.col("visit_count"), F.lit(0)) <= 0
    value = F.when(untried, 0.0).otherwise(-F.coalesce("value_estimate", F.lit(0.0)))
    order = [F.when(untried, 0).otherwise(1), value, F.col("position")]
    if candidates is not None:
        mark = candidates.select("node_id", F.lit(0).alias("_allowed")).distinct()
        nodes = nodes.join(mark, "node_id", "left")
        order = [F.coalesce("_allowed", F.lit(1)), *order]
    best = nodes.orderBy(*order).limit(1)
    # an aggregate has its row without nodes, too
    return best.agg(F.coalesce(F.max(F.nullif(F.col("node_id").cast("string"), F.lit(""))), F.lit(fallback)).alias("node_id"))


def expansions(nodes: DataFrame, edges: DataFrame, *metrics: str) -> DataFrame:
    """Edges with the change of each metric from parent to child."""
    old = nodes.select(F.col("node_id").alias("from_node_id"), *[F.col(m).alias(f"_p_{m}") for m in metrics])
    new = nodes.select(F.col("node_id").alias("to_node_id"), *[F.col(m).alias(f"_c_{m}") for m in metrics])
    out = edges.join(old, "from_node_id").join(new, "to_node_id")
    return out.withColumns({f"delta_{m}": F.col(f"_c_{m}") - F.col(f"_p_{m}") for m in metrics}).drop(*[f"_{s}_{m}" for s in "pc" for m in metrics])


def best_edges(edges: DataFrame, k: int, *order: Column) -> DataFrame:
    return edges.orderBy(*order).limit(k)


def recent_edges(edges: DataFrame, n: int = 3, round_id: str = "round_id", order: str = "seq") -> DataFrame:
    """The last ``n`` edges by round, later ones first; an edge without a round is the oldest."""
    return edges.orderBy(F.coalesce(round_id, F.lit(-1)).desc(), F.col(order).desc()).limit(n)


def edge_summary(edges: DataFrame, action: str = "action_key", forgetting: str = "forgetting", above: float = 0.5) -> DataFrame:
    """Per action: edges, mean and best reward, the last round, and edges that forgot more than ``above``."""
    return edges.where(F.coalesce(F.col(action), F.lit("")) != "").groupBy(action).agg(
        F.count("*").alias("edges"), F.avg("reward").alias("mean_reward"), F.max("reward").alias("best_reward"), F.max("round_id").alias("last_round"),
        F.count_if(F.col(forgetting) > above).alias("forgot"),
    )


def top_cards(nodes: DataFrame, edges: DataFrame, n_nodes: int, n_edges: int) -> DataFrame:
    """The best edges of the best nodes, both by value."""
    top = nodes.orderBy(F.col("value_estimate").desc(), "node_id").limit(n_nodes).select(F.col("node_id").alias("from_node_id"), "value_estimate")
    place = F.row_number().over(Window.partitionBy("from_node_id").orderBy(F.col("reward").desc(), "seq"))
    return edges.join(top, "from_node_id").withColumn("place", place).where(F.col("place") <= n_edges)


#: Similarities 1/d at which queries are tried, before those without enough nodes meet all that share a tag.
_LEVELS = (2, 5, None)


def _by_rarity(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """``tags`` with ``rare``: the same, rarest first."""
    ranked = looked_up(sets.select("tags", F.explode("tags").alias("tag")), counts, "tag", F.col("tag"))
    one = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tag")
    return ranked.groupBy("tags").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["tag"]).alias("rare"))


def _alike(asked: DataFrame, sets: DataFrame, d: int | None) -> DataFrame:
    """Pairs (asked_tags, tags) that may have a Jaccard similarity of 1/d; of any similarity for None.

    Sets that are so alike share one of their first tags by rarity, as many as
    may be missing and one more; and neither has d times as many tags as the other.
    """

    def first(name):
        size = F.size("rare")
        most = size if d is None else size - F.expr(f"(size(rare) + {d - 1}) div {d}").cast("int") + 1
        return F.explode(F.slice("rare", 1, most)).alias(name)

    left = asked.select(F.col("tags").alias("asked_tags"), first("tag"))
    pairs = left.join(sets.select("tags", first("tag")), "tag")
    if d is not None:
        a, b = F.size("asked_tags"), F.size("tags")
        pairs = pairs.where((a <= d * b) & (b <= d * a))
    return pairs.select("asked_tags", "tags").distinct()


def tag_similarity(queries: DataFrame, nodes: DataFrame, k: int, tags: str = "tags") -> DataFrame:
    """The ``k`` nodes most alike each query by Jaccard of their tags, the lesser id on ties; none without a shared tag.

    Equal sets of tags meet once, by their rarest tags at falling
    similarities, so that a tag that most nodes have pairs few of them: only
    queries without ``k`` nodes at one level go on to the next. Null tags are
    none.
    """
    own = F.array_sort(F.array_distinct(F.filter(tags, lambda x: x.isNotNull())))
    asked = queries.select("query_id", own.alias("asked_tags")).where(F.size("asked_tags") > 0)
    named = nodes.select("node_id", own.alias("tags")).where(F.size("tags") > 0)
    sizes = written(named.groupBy("tags").agg(F.count("*").alias("n_nodes")), "tag-sets")
    counts = sizes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    sets = written(_by_rarity(sizes.select("tags"), counts), "tags-by-rarity")
    left = written(_by_rarity(asked.select(F.col("asked_tags").alias("tags")).distinct(), counts), "asked-by-rarity")
    done = []
    for d in _LEVELS:
        both = F.size(F.array_intersect("asked_tags", "tags"))
        either = F.size("asked_tags") + F.size("tags") - both
        close = both * d >= either if d is not None else both > 0
        hits = _alike(left, sets, d).where(close).withColumn("similarity", both / either)
        hits = written(hits.join(sizes, "tags"), "alike")
        enough = hits.groupBy("asked_tags").agg(F.sum("n_nodes").alias("n")).where(F.col("n") >= k if d is not None else F.lit(True))
        done.append(hits.join(enough.select("asked_tags"), "asked_tags", "left_semi"))
        left = written(left.join(enough, left["tags"] == enough["asked_tags"], "left_anti"), "asked-still")
    found = done[0].unionByName(done[1]).unionByName(done[2])
    least = F.row_number().over(Window.partitionBy("tags").orderBy("node_id"))  # no set gives more than k of its nodes
    members = named.withColumn("_least", least).where(F.col("_least") <= k).select("tags", "node_id")
    place = F.row_number().over(Window.partitionBy("asked_tags").orderBy(F.col("similarity").desc(), "node_id"))
    best = found.join(members, "tags").withColumn("place", place).where(F.col("place") <= k)
    return asked.join(best, "asked_tags").select("query_id", "node_id", "similarity", "place")


def parents(edges: DataFrame) -> DataFrame:
    """(node_id, up): each child's parent by its last edge."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in ("from_node_id", "to_node_id")]
    return edges.where(named[0] & named[1]).groupBy(F.col("to_node_id").alias("node_id")).agg(F.max_by("from_node_id", "seq").alias("up"))


def ancestors(edges: DataFrame, start: str, most: int = 100) -> DataFrame:
    """(node_id, depth) from a node up to the root, each child following its last edge; cycles end the walk."""
    name = f"rowloom_parents_{uuid4().hex}"
    parents(edges).select(F.col("node_id").alias("to_node_id"), F.col("up").alias("parent")).createOrReplaceTempView(name)
    spark = edges.sparkSession
    walk = spark.sql(
        f"""with recursive up(node_id, depth, seen) as (
              select :start, 0, array(:start)
              union all
              select p.parent, depth + 1, array_append(seen, p.parent)
              from up join {name} p on p.to_node_id = up.node_id
              where depth < {most} and not array_contains(seen, p.parent))
            select node_id, depth from up""",
        args={"start": start},
    )
    return walk


#: Nodes with more pointers to them are sent to the tasks; there is at most one for so many pointers.
_MANY = 100_000


def _jumped(step: DataFrame, many: int) -> DataFrame:
    """``step`` (node_id, up, s, c) over twice the way.

    ``up`` is the ancestor so many levels above; ``s`` and ``c`` are sums over
    the nodes that are fewer levels below. Pointers to a node that very many
    have above them meet it where they are; the others are joined.
    """
    moving = step.where("up is not null")
    below = moving.groupBy(F.col("up").alias("node_id")).agg(F.sum("s").alias("_s"), F.sum("c").alias("_c"), F.count("*").alias("_n"))
    own = step.select(F.col("node_id").alias("up"), F.col("up").alias("_up"))
    often = below.where(F.col("_n") > many).select(F.col("node_id").alias("up"))
    hubs = written(own.join(F.broadcast(often), "up", "left_semi"), "hubs")
    there = F.broadcast(hubs)
    names = ["node_id", F.col("_up").alias("up"), "s", "c"]
    far = moving.join(there, "up").select(*names).unionByName(moving.join(there, "up", "left_anti").join(own, "up", "left").select(*names))
    out = far.unionByName(step.where("up is null")).join(below, "node_id", "left")
    return out.select("node_id", "up", (F.col("s") + F.coalesce("_s", F.lit(0.0))).alias("s"), (F.col("c") + F.coalesce("_c", F.lit(0))).alias("c"))


def _subtree_sums(step: DataFrame, most: int, many: int) -> tuple[DataFrame, bool]:
    """:func:`_jumped` until no node has anything above, or ``most`` times; whether some still have."""
    step = written(step, "step")
    for _ in range(most):
        if step.where("up is not null").isEmpty():
            return step, False
        further = written(_jumped(step, many), "step")
        forget(step)
        step = further
    return step, not step.where("up is not null").isEmpty()


def _rings(on: DataFrame) -> DataFrame:
    """(node_id, ring): the least node of each node's cycle; ``on`` (node_id, up) has nodes of cycles alone."""
    step = written(on.select("node_id", "up", F.col("node_id").alias("ring")), "rings")
    for _ in range(max(1, step.count()).bit_length()):
        above = step.select(F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("ring").alias("_ring"))
        further = written(step.join(above, "up").select("node_id", F.col("_up").alias("up"), F.least("ring", "_ring").alias("ring")), "rings")
        forget(step)
        step = further
    return step.select("node_id", "ring")


def backpropagated(nodes: DataFrame, edges: DataFrame, rewards: DataFrame, many: int = _MANY) -> DataFrame:
    """``nodes`` after all ``rewards`` (node_id, reward) have gone up: visit counts and running means.

    A reward counts for its node and everything above, each node once, up to
    the first one that ``nodes`` does not have; a child follows its last edge.
    Sums over subtrees come by pointer doubling: in round k a node takes what
    its descendants 2**k levels below have gathered, and its pointer jumps as
    far, so the rounds are the logarithm of the depth and no pairs of node and
    ancestor are made. Cycles are found by pointers that never end; they are
    cut, and each of their nodes gets the sum of all. Nodes with over ``many``
    pointers to them at a time are sent to the tasks.
    """
    own = rewards.where(F.col("reward").isNotNull()).groupBy("node_id").agg(F.sum(F.col("reward").cast("double")).alias("s"), F.count("*").alias("c"))
    known = nodes.select("node_id").distinct()
    up = parents(edges).join(known.withColumnRenamed("node_id", "up"), "up", "left_semi")
    start = known.join(up, "node_id", "left").join(own, "node_id", "left")
    start = written(start.select("node_id", "up", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("c", F.lit(0)).alias("c")), "tree")
    most = max(1, start.count()).bit_length() + 1
    sums, cyclic = _subtree_sums(start, most, many)
    if cyclic:
        # so far up, all that is left stands on a cycle
        ends = sums.where("up is not null").select(F.col("up").alias("node_id")).distinct()
        rings = _rings(start.join(ends, "node_id", "left_semi"))
        cut = start.join(rings, "node_id", "left").withColumn("up", F.when(F.col("ring").isNull(), F.col("up"))).drop("ring")
        sums, _ = _subtree_sums(cut, most, many)
        on_ring = sums.join(rings, "node_id")
        whole = on_ring.groupBy("ring").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
        whole = looked_up(rings, whole, "ring", F.col("node_id")).select("node_id", "s", "c")
        sums = sums.select("node_id", "s", "c").join(rings, "node_id", "left_anti").unionByName(whole)
    n, v = F.coalesce(F.col("visit_count"), F.lit(0)), F.coalesce(F.col("value_estimate"), F.lit(0.0))
    hit = F.coalesce("c", F.lit(0)) > 0
    out = nodes.join(sums.select("node_id", "s", "c"), "node_id", "left").withColumns(
        {"value_estimate": F.when(hit, (v * n + F.col("s")) / (n + F.col("c"))).otherwise(F.col("value_estimate")), "visit_count": F.when(hit, n + F.col("c")).otherwise(F.col("visit_count"))}
    )
    return out.select(*nodes.columns)


def backpropagate(nodes: DataFrame, path: DataFrame, reward: float) -> DataFrame:
    """Visit counts and running means along a path."""
    on = path.select("node_id", F.lit(True).alias("_on"))
    n, v = F.coalesce(F.col("visit_count"), F.lit(0)), F.coalesce(F.col("value_estimate"), F.lit(0.0))
    return nodes.join(on, "node_id", "left").withColumns(
        {
            "value_estimate": F.when(F.col("_on"), v + (F.lit(reward) - v) / (n + 1)).otherwise(F.col("value_estimate")),
            "visit_count": F.when(F.col("_on"), n + 1).otherwise(F.col("visit_count")),
        }
    ).drop("_on")


def retained(rounds: DataFrame, recent: int = 3) -> DataFrame:
    """Candidates to keep: the champion and the last rounds that were not promoted; the others are reported.

    ``rounds`` are written once with an id of each row. Every task sends on
    its own last rounds alone, so that no group meets in one task.
    """
    base = written(rounds.withColumn("_id", F.monotonically_increasing_id()), "rounds")
    champion = F.coalesce(F.col("decision") == "promote", F.lit(False))
    last = [base.where(c).orderBy(F.col("round_id").desc()).limit(n).select("_id") for c, n in ((champion, 1), (~champion, recent))]
    kept = last[0].unionByName(last[1]).withColumn("keep", F.lit(True))
    return base.join(F.broadcast(kept), "_id", "left").withColumn("keep", F.coalesce("keep", F.lit(False))).select(*rounds.columns, "keep")
