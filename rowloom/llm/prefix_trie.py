"""Prefix trie of conversations: mergeable partial tries, merged by hash and rolled up.

A node is a distinct sequence of turns (role, text), named by 128 bits that
are sums over its turns of hashes of (turn, depth); the sums along a
conversation are running ones, taken within blocks of turns and carried over
from block to block, so a conversation of any length is dealt over tasks.

Turns are sorted by ranges of (conversation, turn). Each range makes the table
of its own partial trie: nodes with members, least member, and the list of
members that end there. Tables of ranges next to each other are merged by
node, a few at a time, until one is left: members are added, least members
compared. Lists of ends stay in the order of ranges, which is that of
conversation ids, so a list is never longer in one place than the
conversations of one range; where a node has several, they are hashed one
after the other as a stream.

The trie is rolled up from the ends of conversations. Every node is on the
path of its least member, so what lies below a node is on the paths of those
members that are the least of some node: sums from the end of each such path
to its root, put together by node through the same merges, are the sums over
subtrees, and a path carries each node of its own once. No step walks the trie
level by level.

Null roles and texts are empty. Turns go by number, null first, then by role
and the digest of role and text; equal rows are turns of their own. Rows
without a conversation id belong to no conversation and are left out; an empty
table has an empty trie. Very long texts are read once, to be hashed. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

#: Tables that are merged into one at a time.
FAN = 16
#: Turns of a conversation that one running sum goes over.
BLOCK = 1024
#: Conversations before this number of turns are shared, see :func:`rebuilt`.
SPREAD, TURNS = 100, 6
_SALTS = 64
_LANES = ["s0", "s1", "s2", "s3"]


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns without their texts: conv_id, range, place, digest, chars; places are in the order of turns.

    Ranges are in the order of conversation ids; one conversation may have
    several.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256).alias("digest"), F.length(text).cast("long").alias("chars"),
    ).where(F.col("conv_id").isNotNull())
    rows = stored(rows, "turns")  # ranges are sampled first: texts are hashed once
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    return stored(dealt.select("conv_id", F.shiftright("place", 33).alias("range"), "place", "digest", "chars"), "turn-ranges")


def numbered(rows: DataFrame) -> DataFrame:
    """One row per conversation and range of :func:`ordered`: first place, turns before it, turns of the conversation."""
    parts = rows.groupBy("conv_id", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    by = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(by.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(parts.select("conv_id", "range", "first", before.alias("before"), F.sum("n").over(by).alias("turns")), "turn-counts")


def paths(rows: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, range, turns, depth, digest, chars) of the conversations as they are, and conversations (conv_id, range, turns)."""
    at = rows.join(parts, ["conv_id", "range"])
    depth = F.col("before") + F.col("place") - F.col("first") + 1
    return at.select("conv_id", "range", "turns", depth.alias("depth"), "digest", "chars"), parts.groupBy("conv_id").agg(F.min("range").alias("range"), F.max("turns").alias("turns"))


def rebuilt(rows: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same with openings shared: the first h turns come from conversation ``c - c % SPREAD``.

    h is crc32 of the id in decimal, modulo ``TURNS``; its own turns follow
    from number h on. A giver has no more than ``SPREAD`` takers, each of which
    takes fewer than ``TURNS`` turns.
    """
    giver = F.col("conv_id") - F.col("conv_id") % SPREAD
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TURNS
    own = parts.withColumn("giver", giver).withColumn("h", h)
    given = parts.where(F.col("conv_id") % SPREAD == 0).groupBy(F.col("conv_id").alias("giver")).agg(F.max("turns").alias("given"))
    own = own.join(given, "giver", "left").withColumn("k", F.least("h", F.coalesce("given", F.lit(0))))
    own = stored(own.withColumn("turns", F.col("k") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))), "openings")
    at = rows.join(own, ["conv_id", "range"]).withColumn("at", F.col("before") + F.col("place") - F.col("first"))
    tails = at.where(F.col("at") >= F.col("h")).select("conv_id", "range", "turns", (F.col("at") - F.col("h") + F.col("k") + 1).alias("depth"), "digest", "chars")
    openings = rows.join(parts, ["conv_id", "range"]).where(F.col("conv_id") % SPREAD == 0)
    openings = openings.select(F.col("conv_id").alias("giver"), (F.col("before") + F.col("place") - F.col("first") + 1).alias("depth"), "digest", "chars").where(F.col("depth") < TURNS)
    convs = own.groupBy("conv_id").agg(F.min("range").alias("range"), F.first("giver").alias("giver"), F.first("k").alias("k"), F.first("turns").alias("turns"))
    heads = convs.where("k > 0").join(openings, "giver").where(F.col("depth") <= F.col("k")).select("conv_id", "range", "turns", "depth", "digest", "chars")
    return heads.unionByName(tails), convs.select("conv_id", "range", "turns")


def _name(lanes: list[Column]) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in lanes]))


def members(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Turns with their node and the node before: conv_id, range, turns, depth, node, parent, chars."""
    halves = [x for i in range(2) for h in [F.xxhash64("digest", "depth", F.lit(i))] for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    rows = turns.withColumn("block", F.expr(f"(depth - 1) div {block}")).withColumns({f"x{i}": x for i, x in enumerate(halves)})
    run = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = stored(rows.withColumns({s: F.sum(f"x{i}").over(run) for i, s in enumerate(_LANES)}), "turn-sums")
    # what comes before a block: of conversations over a block alone
    last = rows.where(F.col("depth") % block == 0).select("conv_id", "block", *_LANES)
    carry = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = last.select("conv_id", (F.col("block") + 1).alias("block"), *[F.sum(s).over(carry).alias(f"c{s}") for s in _LANES])
    later = rows.where("block > 0").join(ahead, ["conv_id", "block"])
    later = later.withColumns({s: F.col(s) + F.col(f"c{s}") for s in _LANES}).select(*rows.columns)
    all_ = rows.where("block = 0").unionByName(later)
    before = [F.col(s) - F.col(f"x{i}") for i, s in enumerate(_LANES)]
    return all_.select("conv_id", "range", "turns", "depth", _name([F.col(s) for s in _LANES]).alias("node"), _name(before).alias("parent"), "chars")


#: The node of no turns: sums of nothing.
ROOT = bytes(32)


def merged(tables: DataFrame, ranges: int, sums: list[str], least: list[str] = (), fan: int = FAN) -> DataFrame:
    """Node tables of ranges merged by node, ``fan`` neighbours at a time, into one.

    ``sums`` are added, of ``least`` the smallest stays. Tasks combine what
    they read before it is dealt, so the root is as light as any other node.
    """
    while True:
        tables = tables.groupBy("range", "node").agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least])
        if ranges == 1:
            return tables.drop("range")
        tables = tables.withColumn("range", F.expr(f"range div {fan}"))
        ranges = -(-ranges // fan)


def _hashed(lists: DataFrame) -> DataFrame:
    """sha256 of the lists of each node, one after the other, without ever holding more than a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            done = []
            for name, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = name, sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.string()))], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    rows = lists.repartition("node").sortWithinPartitions("node", "range").select("node", "ids")
    return rows.mapInArrow(run, "node binary, ends_sha256 string")


def ends(convs: DataFrame) -> DataFrame:
    """node and sha256 of the ids of the conversations (conv_id, range, node) that end there, ascending, joined by commas."""
    lists = convs.groupBy("node", "range").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    lists = stored(lists.withColumn("lists", F.count("*").over(Window.partitionBy("node"))), "ends", batch=64)
    one = lists.where("lists = 1").select("node", F.sha2("ids", 256).alias("ends_sha256"))
    return one.unionByName(_hashed(lists.where("lists > 1")))


def _looked_up(rows: DataFrame, table: DataFrame, key: str, salts: int = _SALTS) -> DataFrame:
    """``rows`` with the columns of ``table`` by a key that very many rows may share.

    Asked for once per key and salt: neither the questions of a key nor the
    rows of a question are more than the salts allow.
    """
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)))
    asked = rows.groupBy(key, "salt").agg(F.count("*").alias("askers")).drop("askers")
    return rows.join(asked.join(table, key), [key, "salt"], "left").drop("salt")


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node.

    ``turns`` has (conv_id, range, turns, depth from 1, digest, chars), ``convs``
    every conversation once with its range and number of turns.
    """
    ranges = (convs.agg(F.max("range")).first()[0] or 0) + 1
    root = convs.select("conv_id", "range", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"), "turns")
    rows = stored(root.unionByName(members(turns, block)), "trie-members")
    one = [F.lit(1).cast("long").alias("n_convs"), F.when(F.col("depth") == F.col("turns"), 1).otherwise(0).alias("n_ends")]
    nodes = merged(rows.select("range", "node", *one, "conv_id", "depth", "parent", "chars"), ranges, ["n_convs", "n_ends"], ["conv_id", "depth", "parent", "chars"], fan)
    nodes = stored(nodes, "trie-nodes")

    # weights of nodes, put on the path of their least member, summed from its end
    own = nodes.select(
        "conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0).alias("leaf"),
    )
    on_path = rows.join(own, ["conv_id", "depth"], "left")
    on_path = on_path.select("conv_id", "range", "turns", "node", "depth", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    below = merged(_from_end(on_path, block), ranges, ["saved_tokens", "n_leaves"], fan=fan)

    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = _looked_up(nodes, parents, "parent").join(below, "node").join(children, "node", "left")
    out = out.join(ends(rows.where("depth = turns").select("conv_id", "range", "node")), "node", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"), "node",
    )


def _from_end(rows: DataFrame, block: int) -> DataFrame:
    """range, node, and sums of saved and leaf from each turn to the end of its conversation."""
    rows = rows.withColumn("block", F.expr(f"depth div {block}"))
    up = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = stored(rows.withColumns({"saved_tokens": F.sum("saved").over(up), "n_leaves": F.sum("leaf").over(up)}), "trie-paths")
    # what comes after a block: of conversations over a block alone
    first = rows.where((F.col("depth") % block == 0) & (F.col("block") > 0))
    back = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = first.select("conv_id", (F.col("block") - 1).alias("block"), F.sum("saved_tokens").over(back).alias("more_saved"), F.sum("n_leaves").over(back).alias("more_leaves"))
    long = rows.where(F.col("turns") >= block).join(after, ["conv_id", "block"], "left")
    out = rows.where(F.col("turns") < block).select("*", F.lit(0).alias("more_saved"), F.lit(0).alias("more_leaves")).unionByName(long)
    return out.select("range", "node", (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"), (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"))


def prefix_trie(conversations: DataFrame, share: bool = False, **columns: str) -> DataFrame:
    """:func:`trie` of a table of turns, as they are or with :func:`rebuilt` openings."""
    rows = ordered(conversations, **columns)
    parts = numbered(rows)
    return trie(*(rebuilt if share else paths)(rows, parts))
