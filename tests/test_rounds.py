"""Dedup in rounds, folds in ranges, rewards through a tree, samples by tier: against plain Python."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowloom.operators import bundles, dedup, filtering, fold, lifecycle, quotas, ranks, sampling, search_graph, splits, spread, surrogate, written
from rowloom.streaming.items import step


def _greedy(rows):
    seen, kept = set(), []
    for o, keys in sorted(rows):
        keys = set(keys or ()) - {None}
        if not keys & seen:
            kept.append(o)
            seen |= keys
    return kept


def _by_any_key(spark, rows):
    df = spark.createDataFrame(rows, "seq int, keys array<string>").repartition(3)
    return sorted(r.seq for r in dedup.first_by_any_key(df, "keys", "seq").collect())


def test_a_dropped_row_does_not_close_its_keys(spark):
    assert _by_any_key(spark, [(1, ["a", "b"]), (2, ["b", "c"]), (3, ["c"])]) == [1, 3]


def test_key_sets_equal_the_greedy_pass(spark):
    rng = random.Random(4)
    rows = [(i, [f"k{rng.randint(0, 40)}" for _ in range(rng.randint(0, 3))] if rng.random() > 0.05 else None) for i in range(120)]
    rows += [(500 + i, [f"c{i}", f"c{i + 1}", None]) for i in range(7)] + [(1000 + i, ["hot", f"z{i % 3}"]) for i in range(300)]
    rng.shuffle(rows)
    assert _by_any_key(spark, rows) == _greedy(rows)
    assert _by_any_key(spark, [(1, None), (2, [])]) == [1, 2]


# --- folds


@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 2), min_size=3, max_size=3)), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_maps_compose_in_order(events):
    events.sort(key=lambda e: e[0])
    keys, maps = np.array([k for k, _ in events]), np.array([m for _, m in events], np.int8)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    want = []
    for k in np.unique(keys):
        state = [0, 1, 2]
        for m in maps[keys == k]:
            state = [int(m[s]) for s in state]
        want.append(state)
    assert fold.composed(maps, starts).tolist() == want


def test_items_of_one_hot_key_are_folded_in_ranges(spark):
    rng = random.Random(7)
    events = []
    for i in range(4000):
        name = "hot" if rng.random() < 0.4 else f"q{rng.randint(0, 99)}"
        events.append((i, rng.choice(["a", "b", None]), name if rng.random() > 0.02 else None, rng.choice([*lifecycle.KINDS, "odd", None]), rng.random(), i))
    want = {}
    for _, d, q, kind, *_ in events:
        want[d, q] = step(want.get((d, q)), kind)
    df = spark.createDataFrame(rng.sample(events, len(events)), "seq long, dataset string, question_id string, kind string, pass_rate double, rollout_count long")
    out = lifecycle.item_states(df.repartition(5))
    got = {(r.dataset, r.question_id): r for r in out.collect()}
    assert {k: r.state for k, r in got.items()} == {k: s for k, s in want.items() if s}
    last = max(e[5] for e in events if e[1:4] == ("a", "hot", "rate"))
    assert got["a", "hot"].rollout_count == last
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert lifecycle.item_states(df.limit(0)).count() == 0


# --- rewards


def _walked(nodes, edges, rewards):
    up = {t: f for f, t, _ in sorted(edges, key=lambda e: e[2]) if f and t}
    out = {n: [v or 0, x or 0.0] for n, v, x in nodes}
    for node, reward in rewards:
        seen = set()
        while reward is not None and node and node not in seen and node in out:
            seen.add(node)
            v, x = out[node]
            out[node] = [v + 1, x + (reward - x) / (v + 1)]
            node = up.get(node)
    return out


@pytest.mark.parametrize("shape", ["tree", "chain", "any", "star"])
def test_rewards_of_all_rounds(spark, shape):
    rng, n = random.Random(shape), 90
    above = {"tree": lambda i: rng.randint(0, i - 1), "chain": lambda i: i - 1, "any": lambda i: rng.randint(0, n - 1), "star": lambda i: 0}[shape]
    edges = [(f"n{above(i)}", f"n{i}", i) for i in range(1, n)] + [(None, "n3", 900), ("", "n4", 901), ("n1", "n2", 902)]
    nodes = [(f"n{i}", rng.choice([None, 0, 2]), rng.choice([None, 0.5])) for i in range(n) if i != 77]
    rewards = [(f"n{rng.randint(0, n)}", rng.choice([None, 0.2, 0.7, 1.0])) for _ in range(200)]
    got = search_graph.backpropagated(
        spark.createDataFrame(nodes, "node_id string, visit_count long, value_estimate double"),
        spark.createDataFrame(edges, "from_node_id string, to_node_id string, seq long"),
        spark.createDataFrame(rewards, "node_id string, reward double"),
    )
    want = _walked(nodes, edges, rewards)
    rows = {r.node_id: (r.visit_count or 0, r.value_estimate or 0.0) for r in got.collect()}
    assert set(rows) == set(want)
    assert all(rows[k][0] == v and rows[k][1] == pytest.approx(x) for k, (v, x) in want.items())


@pytest.mark.parametrize("shape", ["tree", "any", "star"])
def test_rewards_past_nodes_that_are_sent(spark, shape):
    rng, n = random.Random(shape), 60
    above = {"tree": lambda i: i // 4, "any": lambda i: rng.randint(0, 9), "star": lambda i: 0}[shape]
    edges = [(f"n{above(i)}", f"n{i}", i) for i in range(1, n)] + [("n5", "n0", 0)] * (shape == "star")
    nodes, rewards = [(f"n{i}", 1, 0.5) for i in range(n)], [(f"n{rng.randint(0, n)}", 0.5 * rng.randint(0, 2)) for _ in range(90)]
    got = search_graph.backpropagated(
        spark.createDataFrame(nodes, "node_id string, visit_count long, value_estimate double"),
        spark.createDataFrame(edges, "from_node_id string, to_node_id string, seq long"), spark.createDataFrame(rewards, "node_id string, reward double"), many=3,
    )
    want, rows = _walked(nodes, edges, rewards), {r.node_id: (r.visit_count, r.value_estimate) for r in got.collect()}
    assert set(rows) == set(want) and all(rows[k] == (v, pytest.approx(x)) for k, (v, x) in want.items())


def test_parents_to_branch_from(spark):
    nodes = spark.createDataFrame([("a", 1, 0.3, 0), ("b", 2, 0.9, 1), ("c", 0, None, 2), ("d", None, 0.1, 3)], "node_id string, visit_count int, value_estimate double, position int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "node_id string")
    pick = lambda *a: search_graph.next_parent(*a).first().node_id
    assert pick(nodes) == "c"
    assert pick(nodes, ids("a", "b")) == "b"
    assert pick(nodes, ids("zz")) == "c"
    assert pick(nodes.limit(0), None, "root") == "root"
    assert pick(nodes.where("node_id = 'a'").withColumn("node_id", F.lit("")), None, "root") == "root"


# --- quotas and samples


def test_quota_tables_equal_going_round(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(60):
        total, keys = rng.randint(0, 80), "abcdef"[: rng.randint(1, 6)]
        weight = {k: float(rng.choice([0, 0.1, 0.25, 0.5, 1, rng.random()])) for k in keys}
        supply = {k: rng.choice([0, 1, 3, rng.randint(0, 60)]) for k in keys}
        want[g] = quotas.capped(weight, total, supply)
        rows += [(g, k, weight[k], supply[k], total) for k in keys]
    got = {g: {} for g in want}
    for r in quotas.capped_table(spark.createDataFrame(rows, "g int, key string, weight double, available long, total long"), "total", "key", ["g"]).collect():
        if r.quota:
            got[r.g][r.key] = r.quota
    assert got == want


def test_shares_are_of_keys_with_supply():
    assert quotas.capped({"a": 0.1, "b": 0.4, "c": 0.5}, 10, {"a": 9, "b": 9}) == {"a": 2, "b": 8}


def test_fills_conserve_and_carry(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["easy", "medium", "hard"]), rng.choice([0, 0, 1, 2])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, bucket string, tier int")
    for wanted in ({"easy": 20, "medium": 190, "hard": 30}, {"medium": 10_000}, {"easy": 0, "hard": 5}):
        table = spark.createDataFrame(list(wanted.items()), "bucket string, quota long")
        got = sampling.filled(df, table, "bucket", "tier", "id").collect()
        assert len({r.id for r in got}) == len(got)
        lacking = 0
        for b, q in wanted.items():
            own = [r for r in got if r.bucket == b and r.taken_as == "quota"]
            supply = {t: sum(x[1:] == (b, t) for x in rows) for t in range(3)}
            left = q
            for t in range(3):  # what a tier lacks is carried to the next
                assert sum(r.tier == t for r in own) == min(left, supply[t])
                left -= min(left, supply[t])
            lacking += left
        taken = {b: sum(r.bucket == b and r.tier == 0 and r.taken_as == "quota" for r in got) for b in ("easy", "hard")}
        spare = {b: sum(x[1:] == (b, 0) for x in rows) - taken[b] for b in taken}
        easy = min(spare["easy"], lacking * 2 // 3)
        back = {b: sum(r.bucket == b and r.taken_as == "backfill" for r in got) for b in ("easy", "medium", "hard")}
        assert back == {"easy": easy, "medium": 0, "hard": min(spare["hard"], lacking - easy)}


def test_rounds_by_plan_focus_or_chance(spark):
    rows = [(f"q{i}", i, f"t{i % 90}", ["easy", "medium", "hard", None][i % 4], ["m0", "m1", "m2"][i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "question_id string, seq int, dedup_key string, difficulty string, module string")
    weights = spark.createDataFrame([("easy", 0.5), ("hard", 0.5)], "difficulty string, weight double")
    modules = spark.createDataFrame([("m1", 1.0)], "module string, weight double")
    known = spark.createDataFrame([("q0",), ("q1",)], "question_id string")
    got = sampling.round_sample(df, 30, weights, modules, known).collect()
    assert len(got) == 30 and not {"q0", "q1"} & {r.question_id for r in got}
    assert sum(r.difficulty == "easy" for r in got) == sum(r.difficulty == "hard" for r in got) == 15
    assert all((r.module == "m1") == (r.tier == 0) for r in got) and {r.tier for r in got} == {0, 1}
    every = sampling.round_sample(df, 1000, weights, modules, known)
    assert every.count() == 88 and every.where("tier = 2 and difficulty in ('medium', 'unknown')").count() == every.where("difficulty in ('medium', 'unknown')").count()
    focus = spark.createDataFrame([("m2",), ("m2",), ("unknown",)], "module string")
    assert all(r.module == "m2" for r in sampling.round_sample(df, 30, focus=focus).collect())
    assert sampling.round_sample(df, 50).count() == 50 and sampling.round_sample(df.limit(0), 5, weights).count() == 0


def test_buckets_are_oversampled(spark):
    df = spark.createDataFrame([(i, "x" if i < 10 else "y") for i in range(100)], "id int, b string")
    for total, x in ((10, 7), (50, 10), (200, 10)):
        got = sampling.oversampled(df, "b", "x", total, "id").collect()
        assert sum(r.b == "x" for r in got) == x and len(got) == min(total, x + 90)


# --- candidates


def test_a_cold_start_takes_the_default(spark):
    templates = spark.createDataFrame([("a", 0, 1e-6, 0.1, 1.0), ("b", 1, 5e-6, 0.3, 3.0), ("bad", 2, -1.0, 0.3, 3.0)], "action_key string, position int, learning_rate double, replay_sample_ratio double, num_train_epochs double")
    samples = spark.createDataFrame([], "seq int, action_key string, learning_rate double, replay_sample_ratio double, num_train_epochs double, reward double")
    got = surrogate.chosen(templates, samples, "b").collect()
    assert [(r.action_key, r.generation) for r in got if r.selected] == [("b", "template_anchor")]
    assert surrogate.candidates(templates, samples, "b").count() == 2 + surrogate.SPREAD
    one = spark.createDataFrame([(1, "a", 4e-6, 0.2, 2.0, 0.9), (2, "a", None, 0.2, 2.0, 5.0)], samples.schema)
    best = surrogate.chosen(templates, one, "b").orderBy("place").collect()
    assert [r.selected for r in best] == [True] + [False] * 4 and all(r.expected == pytest.approx(0.9) for r in best)
    changed = surrogate.candidates(templates, one, "b").where("generation like 'history%'").collect()
    assert len(changed) == 7 and {r.action_key for r in changed} <= {"a", "b"}
    assert {round(r.learning_rate, 12) for r in changed} == {3.6e-6, 4e-6, 4.4e-6}


def test_equal_candidates_stay_once(spark):
    templates = spark.createDataFrame([("a", 0, 1e-6, 0.1, 1.0), ("a", 1, 1e-6, 0.1, 1.0)], "action_key string, position int, learning_rate double, replay_sample_ratio double, num_train_epochs double")
    samples = spark.createDataFrame([(1, "a", 1e-6, 0.1, 1.0, 0.9)], "seq int, action_key string, learning_rate double, replay_sample_ratio double, num_train_epochs double, reward double")
    got = surrogate.candidates(templates, samples, "a", spread=1)
    assert got.where("generation = 'history_exact'").count() == 0 and got.where("generation = 'template_anchor'").count() == 1
    with pytest.raises(ValueError):
        surrogate.candidates(templates.limit(0), samples, "a")


# --- ranks, filters, tables


def test_places_of_any_order_type(spark):
    rows = [(i, None if i % 50 == 49 else f"doc-{i * 7919 % 1000:06d}", None if i % 5 == 4 else i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, s string, k int").withColumn("d", F.expr("date_add(date'2020-01-01', 1000 - i)")).repartition(6)
    for order, key in (("s", lambda r: (r.s is not None, r.s or "")), ("d", lambda r: r.d), ("i", lambda r: r.i)):
        placed, sizes = ranks.ranked(df, ["k"], order)
        got = placed.collect()
        for k in (0, 1, 2, None):
            own = sorted((r for r in got if r.k == k), key=lambda r: r._place)
            assert [r._place for r in own] == list(range(1, len(own) + 1))
            assert [key(r) for r in own] == sorted(key(r) for r in own)
        assert {r.k: r.n for r in sizes.collect()} == {k: sum(r[2] == k for r in rows) for k in (0, 1, 2, None)}


def test_rows_without_an_order_are_not_lost(spark):
    rows = [(None, "only one", "a"), (None, "twice", "a"), (3, "twice", "a"), (2, "twice", "b"), (None, "", "a"), (None, "only one", "a")]
    df = spark.createDataFrame(rows, "seq int, q string, a string")
    rules = filtering.Rules(min_question=1, dedup="question")
    want = [(None, None), (None, None), (None, "duplicate"), (None, "question_short"), (2, None), (3, "duplicate")]
    key = lambda x: (x[0] or 0, x[1] or "")
    for out in (filtering.judge(df, rules, F.col("q"), F.col("a"), "seq"), filtering.screened(df, rules, F.col("q"), F.col("a"), "seq", {"a": F.col("a")})):
        assert sorted(((r.seq, r.reason) for r in out.collect()), key=key) == sorted(want, key=key)


def test_rules_read_the_rows_once(spark, sf_dir, monkeypatch):
    from rowloom.plans import queries

    plans = []
    done = written.written
    monkeypatch.setattr(filtering, "written", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), done(df, name))[1])
    out = queries.flagship_curriculum(spark, sf_dir)
    rest = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(plans) == 1 and plans[0].count("Relation") == 1
    assert "documents" not in rest and "text" not in rest


def test_hot_keys_are_looked_up_through_salts(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, "hot").when(F.col("id") < 1990, F.concat(F.lit("k"), "id")).alias("key"), "id")
    table = spark.createDataFrame([("hot", 1), ("k1600", 2)], "key string, v int")
    got = spread.looked_up(rows, table, "key", F.col("id"))
    assert got.count() == 2000 and got.where("v = 1").count() == 1500 and got.where("v = 2").count() == 1
    assert spread.looked_up(rows, table, "key", F.col("id"), "inner").count() == 1501


def test_a_local_disk_is_refused_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return default if name == "spark.checkpoint.dir" else "file:/tmp/warehouse"

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        written.shared_folder(Session)
    Session.sparkContext.master = "local[4]"
    assert written.shared_folder(Session) == "file:/tmp/warehouse/_steps"


def test_splits_of_null_keys_and_dates(spark):
    df = spark.range(40).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("at"), F.when(F.col("id") < 30, "g").alias("k"))
    got = splits.stratified_split(df, ["k"], "at", {"train": 0.8, "test": 0.2}).collect()
    assert len(got) == 30 and sum(r.split == "test" for r in got) == 6
    assert bundles.pressure(spark.createDataFrame([("hard", "train")], "difficulty string, split string")).first().train_short
