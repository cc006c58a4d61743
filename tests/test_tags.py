"""Nodes by the likeness of their tags."""

import random

from rowloom.operators import search_graph


def _tables(spark, seed, n_nodes, n_queries):
    rnd = random.Random(seed)
    tags = [f"t{i}" for i in range(30)]

    def some():
        return None if rnd.random() < 0.05 else ["hot"] * (rnd.random() < 0.9) + rnd.choices(tags, k=rnd.randrange(7)) + [None] * (rnd.random() < 0.1)

    nodes, queries = [(i, some()) for i in range(n_nodes)], [(i, some()) for i in range(n_queries)]
    queries += [(n_queries, ["hot"]), (n_queries + 1, ["no such"]), (n_queries + 2, [])]
    return nodes, queries


def _want(nodes, queries, k):
    out = set()
    for q, a in queries:
        a = {x for x in a or [] if x is not None}
        scored = []
        for n, b in nodes:
            b = {x for x in b or [] if x is not None}
            if a & b:
                scored.append((-(len(a & b) / len(a | b)), n))
        out |= {(q, n, -s, p) for p, (s, n) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_nearest_by_tags_equal_brute_force(spark):
    for seed, n, k in ((1, 300, 5), (2, 40, 7), (3, 3, 5)):
        nodes, queries = _tables(spark, seed, n, 60)
        got = search_graph.tag_similarity(
            spark.createDataFrame(queries, "query_id long, tags array<string>"), spark.createDataFrame(nodes, "node_id long, tags array<string>"), k
        )
        assert {tuple(r) for r in got.collect()} == _want(nodes, queries, k)


def test_empty_tables_have_no_nearest(spark):
    nodes, queries = (spark.createDataFrame([], f"{x}_id long, tags array<string>") for x in ("node", "query"))
    assert search_graph.tag_similarity(queries, nodes, 3).count() == 0


def test_a_hot_tag_pairs_few(spark):
    sets = spark.createDataFrame([(sorted(["hot", f"a{i}", f"b{i}"]), [f"a{i}", f"b{i}", "hot"]) for i in range(400)], "tags array<string>, rare array<string>")
    assert search_graph._alike(sets, sets, 2).count() == 400
    assert search_graph._alike(sets, sets, None).count() == 400 * 400
