"""Operators on hand-made rows for the cases that matter."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowloom.operators import (
    conversations, dedup, evaluation, filtering, lifecycle, overlap, quotas, rollouts, sampling, search_graph, splits, surrogate, train_log,
)
from rowloom.sources import files
from rowloom.streaming import items


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_rows_dropped_for_other_reasons_do_not_count_as_seen(spark):
    df = spark.createDataFrame([(1, "aa", "x"), (2, "aa", "long enough"), (3, "aa", "long enough")], "seq long, q string, a string")
    rules = filtering.Rules(min_answer=3, dedup="question")
    out = filtering.judge(df, rules, F.col("q"), F.col("a"), "seq")
    assert rows(out, "seq", "reason") == [(1, "answer_short"), (2, None), (3, "duplicate")]


def test_first_field_takes_an_empty_string(spark):
    df = spark.createDataFrame([("", "q"), (None, "q"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(filtering.first_field(F.col("a"), F.col("b"))).collect()] == ["", "q", ""]


def test_gram_overlap_takes_the_best_item_not_the_sum(spark):
    docs = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz"), (2, "short"), (3, None)], "doc_id int, text string")
    bench = spark.createDataFrame([(1, "abcdefghijklmnopqr"), (2, "ijklmnopqrstuvwxyz"), (3, "")], "item_id int, text string")
    got = {r.doc_id: r for r in overlap.gram_overlap(docs, bench, "doc_id", "item_id").collect()}
    assert (got[1].n_grams, got[1].n_shared) == (14, 6)
    assert got[2].share == got[3].share == 0.0
    whole = spark.createDataFrame([(9, "ABCDEFGHIJKLMNOP")], "doc_id int, text string")
    assert overlap.without_overlap(whole, bench, "doc_id", "item_id").count() == 0


def test_overlap_is_an_equi_join(spark):
    docs = spark.createDataFrame([(1, "a" * 20)], "doc_id int, text string")
    plan = overlap.gram_overlap(docs, docs.withColumnRenamed("doc_id", "item_id"), "doc_id", "item_id")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_benchmark_leaves_all(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "")], "doc_id int, text string")
    none = docs.limit(0)
    assert overlap.exact_split(docs, none).count() == 2


def test_registry_text_hash_needs_no_row_key(spark):
    reg = spark.createDataFrame(
        [(1, "d", "", "", "7", "other", "h1", "active_holdout"), (2, "", "", "", "", "other2", "h2", "active_holdout")],
        "seq long, source_dataset_id string, source_dataset_subset string, source_dataset_split string, source_dataset_row_id string, question_id string, text_hash string, status string",
    )
    qs = spark.createDataFrame(
        [("a", None, None, "h1"), ("b", None, None, "h2"), ("c", "d", "7", "x"), ("e", "d", "8", "h2"), ("other", "z", "1", "y")],
        "question_id string, dataset string, row_id string, text_hash string",
    )
    assert rows(overlap.registry_block(qs, reg, overlap.TRAIN_BLOCKING), "question_id") == [("a",), ("e",)]


def test_registry_prefers_rank_then_the_later(spark):
    key = "'d', '', '', '1', 'q', 'h'"
    ev = spark.sql(
        f"select * from values (1, {key}, 'probe_holdout', 'x'), (2, {key}, 'train_seen', 'y'), (3, {key}, 'probe_holdout', 'z') as t(seq, source_dataset_id, source_dataset_subset, source_dataset_split, source_dataset_row_id, question_id, text_hash, status, module)"
    )
    assert rows(dedup.registry_state(ev), "status", "module") == [("probe_holdout", "z")]


def test_first_by_any_key(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["c"]), (4, ["c", "a"])], "seq int, keys array<string>")
    assert rows(dedup.first_by_any_key(df, "keys", "seq"), "seq") == [(1,), (3,)]


def test_keep_last_keeps_blank_ids(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("", 3), ("", 4)], "id string, seq int")
    assert rows(dedup.last_wins(df, "id", "seq"), "seq") == [(2,), (3,), (4,)]


def test_histogram_rescales_half_even(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, 16), ("c", 5, 16)], "question_id string, pass_count long, rollout_count long")
    got = {r.bin: r.n for r in rollouts.pass_histogram(df).collect()}
    assert got["4/8"] == 1 and got["2/8"] == 2 and sum(got.values()) == 3 and len(got) == 9


def test_scores_take_the_first_sure_vote(spark):
    df = spark.createDataFrame([("a", 0, True, "unknown"), ("a", 1, False, "hard"), ("b", 0, True, None)], "question_id string, rollout_idx int, correct boolean, vote string")
    got = {r.question_id: r for r in rollouts.scores(df).collect()}
    assert (got["a"].vote, got["b"].vote, got["a"].correct_flags) == ("hard", "unknown", [True, False])


def test_mastery_with_one_try(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (5, 8), (6, 8), (3, 4), (2, 4)], "pass_count int, rollout_count int")
    assert rows(rollouts.mastered(df), "pass_count", "rollout_count") == [(1, 1), (3, 4), (6, 8)]


def test_shards_are_balanced(spark):
    got = rollouts.shard(spark.range(103), "id", 4).groupBy("shard").agg(F.count("*"), F.min("id"), F.max("id")).orderBy("shard").collect()
    assert [r[1] for r in got] == [26, 26, 26, 25] and [r[2] for r in got] == [0, 26, 52, 78]


def test_shards_of_more_rows_than_a_sample_of_ranges(spark):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    ids = spark.range(0, 60_000, 1, 3).select((F.col("id") * 7919 % 60_000).alias("id"), F.lit(1).alias("n"))
    spark.conf.set(setting, "false")  # ranges of few rows would be one
    try:
        got = rollouts.shard(ids, "id", 7)
        assert got.columns == ["id", "n", "shard"] and got.where(F.col("shard") != F.expr("id * 7 div 60000")).isEmpty() and got.count() == 60_000
    finally:
        spark.conf.unset(setting)
    few = spark.createDataFrame([(None,), (4,), (2,), (2,)], "id int")
    assert sorted(map(tuple, rollouts.shard(few, "id", 2).collect()), key=repr) == [(2, 0), (2, 0), (4, 1), (None, 1)]
    assert rollouts.shard(few.limit(0), "id", 2).count() == 0


@given(st.dictionaries(st.sampled_from("abcdef"), st.floats(-1, 9), max_size=6), st.integers(0, 60), st.lists(st.integers(0, 30), min_size=6, max_size=6))
@settings(max_examples=200, deadline=None)
def test_capped_quotas(weights, total, supply):
    available = dict(zip("abcdef", supply, strict=True))
    got = quotas.capped(weights, total, available)
    good = [k for k in quotas.normalized(weights) if available[k]]
    assert sum(got.values()) == min(total, sum(available[k] for k in good))
    assert all(0 < n <= available[k] for k, n in got.items())


def test_hard_is_held_near_its_weight():
    assert quotas.capped_hard({"easy": 0.4, "medium": 0.5, "hard": 0.1}, 100, {"easy": 5, "medium": 5, "hard": 500}) == {"easy": 5, "medium": 5, "hard": 15}
    assert quotas.capped_hard({"easy": 0.4, "hard": 0.6}, 100, {"easy": 5, "hard": 500})["hard"] == 95


@given(st.dictionaries(st.sampled_from(["easy", "medium", "hard"]), st.floats(0, 1), min_size=3))
@settings(max_examples=100, deadline=None)
def test_bounded_weights(weights):
    out = quotas.bounded(weights)
    assert abs(sum(out.values()) - 1) < 1e-9 and all(0.05 - 1e-9 <= w <= 0.8 + 1e-9 for w in out.values())


def _quota(n, ratios):
    """The split rule, step by step."""
    names = list(splits.ROLES)
    total = 0.0
    for r in names:
        total += ratios.get(r, 0)
    exact = {r: n * ratios.get(r, 0) / total for r in names}
    q = {r: int(exact[r]) for r in names}
    frac = {r: exact[r] - q[r] for r in names}
    pos = [r for r in names if ratios.get(r, 0) > 0]
    if n >= len(pos):
        for r in pos:
            q[r] = q[r] or 1
    left = n - sum(q.values())
    for r in sorted(names, key=lambda r: -frac[r]):
        if left > 0:
            q[r] += 1
            left -= 1
    for r in sorted(names, key=lambda r: frac[r]):
        if left < 0 and q[r] > 0:
            q[r] -= 1
            left += 1
    return [q[r] for r in names]


@pytest.mark.parametrize("ratios", [{"train": 0.7, "cotest": 0.1, "test": 0.1, "probe": 0.1}, {"train": 0.8, "test": 0.2}, {"train": 1, "cotest": 1, "test": 1, "probe": 1}])
def test_split_quotas(spark, ratios):
    got = splits.split_quotas(spark.range(1, 60).select(F.col("id").alias("n")), ratios).orderBy("n").collect()
    for r in got:
        assert [r[f"n_{x}"] for x in splits.ROLES] == _quota(r.n, ratios), r


def test_ratio_split_edges(spark):
    assert rows(splits.ratio_split(spark.range(1), "id", 0.9), "split") == [("train",)]
    many = splits.ratio_split(spark.range(30_000), "id", 0.25)
    assert many.where("split = 'train'").count() == 22_500


def test_split_without_test_labels_splits_all(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "Train") for i in range(10)], "id int, label string")
    out = splits.existing_split(df, "label", "id", 0.2)
    assert out.count() == 10 and out.where("split = 'train'").count() == 8


def test_single_rows_of_a_key_are_tests(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, k string")
    out = splits.holdout_by_key(df, "k", "id", 0.1)
    assert rows(out.where("k = 'a'"), "split") == [("test",)] and out.where("split = 'test'").count() == 2


def test_validation_size():
    assert [splits.validation_size(n) for n in (10, 37, 38, 200, 5000)] == [0, 0, 8, 10, 64]


def test_replay_tiers(spark):
    df = spark.createDataFrame([(1, "hard", []), (2, "easy", []), (3, "hard", [1]), (4, "easy", [0]), (5, "hard", [1, 2])], "id int, bucket string, used_in_rounds array<int>")
    got = [r.id for r in sampling.least_used(df, "bucket", 5, "id", "hard").collect()]
    assert got == [1, 2, 3, 5, 4]


def test_conversation_pairs(spark):
    df = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", " q "), (1, 2, "assistant", "a"), (1, 3, "assistant", "b"), (2, 0, "x", "first"), (2, 1, "y", "last"), (3, 0, "user", "only"), (4, 0, "user", None)],
        "conv_id int, turn int, role string, text string",
    )
    assert rows(conversations.pairs(df), "conv_id", "question", "answer") == [(1, "q", "b"), (2, "first", "last")]


def test_transcript_and_literal_turns(spark):
    df = spark.createDataFrame([("User: hi\nthere\nAssistant: yes",)], "t string")
    turns = df.select(conversations.transcript_turns(F.col("t")).alias("x")).first()[0]
    assert [(t.role, t.content) for t in turns] == [("user", "hi\nthere"), ("assistant", "yes")]
    raw = spark.createDataFrame([('[{"role": "user", "content": "a"}]',), ("[{'role': 'user', 'content': 'b'}]",), ("no",)], "c string")
    got = [r.turns and r.turns[0].content for r in conversations.literal_turns(raw, "c").collect()]
    assert got == ["a", "b", None]


def test_sft_template_with_unknown_name_is_literal(spark):
    df = spark.createDataFrame([("q", "a"), ("", "a")], "q string, a string")
    assert rows(conversations.sft_samples(df, ["q"], ["a"], "{nope}"), "instruction", "output") == [("{nope}", "a")]
    assert rows(conversations.sft_samples(df, ["q"], ["a"], "Q {q}!"), "instruction") == [("Q q!",)]


def test_item_states_fold_and_stream_agree(spark):
    import random

    rnd = random.Random(3)
    events = [(i, "d", rnd.randrange(9), rnd.choice(lifecycle.KINDS)) for i in range(300)]
    df = spark.createDataFrame(events, "seq int, dataset string, question_id int, kind string").withColumns({"pass_rate": F.lit(0.5), "rollout_count": F.lit(1)})
    want = {}
    for _, _, q, kind in events:
        want[q] = items.step(want.get(q), kind)
    assert dict(rows(lifecycle.item_states(df), "question_id", "state")) == {q: s for q, s in want.items() if s}


def test_streamed_states(spark, tmp_path):
    df = spark.createDataFrame([(1, "d", "q", "register"), (2, "d", "q", "reserve"), (3, "d", "r", "use")], "seq long, dataset string, question_id string, kind string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = items.item_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("states"), "question_id", "state") == [("q", "reserved")]


def test_gates_need_more_than_the_gain(spark):
    base = dict(probe_acc=0.8, champion_probe_acc=0.8, base_probe_acc=None, old_before=0.5, old_after=0.5, old_count=9, forgetting=0.0, new_before=0.5)
    df = spark.createDataFrame([{**base, "new_after": 0.6}, {**base, "new_after": 0.61}, {**base, "new_after": 0.9, "forgetting": 0.2}], "probe_acc double, champion_probe_acc double, base_probe_acc double, old_before double, old_after double, old_count int, forgetting double, new_before double, new_after double")
    got = {round(r.new_after, 2): r for r in evaluation.gates(df).collect()}
    assert not got[0.6].promote and got[0.61].promote and got[0.61].stop and not got[0.9].promote


def test_untried_actions_come_first(spark):
    actions = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "action_key string, position int")
    edges = spark.createDataFrame([("a", 0.9), ("a", None), ("", 1.0)], "action_key string, reward double")
    assert [r.action_key for r in search_graph.rank_actions(actions, edges).orderBy("rank").collect()] == ["b", "c", "a"]


def test_walk_stops_at_cycles_and_follows_last_edges(spark):
    edges = spark.createDataFrame([("x", "b", 1), ("a", "b", 2), ("b", "c", 3), ("c", "a", 4)], "from_node_id string, to_node_id string, seq int")
    path = search_graph.ancestors(edges, "c")
    assert [r.node_id for r in path.orderBy("depth").collect()] == ["c", "b", "a"]
    nodes = spark.createDataFrame([("a", 1, 1.0), ("c", None, None), ("x", 0, 0.0)], "node_id string, visit_count int, value_estimate double")
    assert rows(search_graph.backpropagate(nodes, path, 0.5), "node_id", "visit_count", "value_estimate") == [("a", 2, 0.75), ("c", 1, 0.5), ("x", 0, 0.0)]


def test_halton():
    assert [surrogate.halton(i, 2) for i in (1, 2, 3)] == [0.5, 0.25, 0.75]


def test_log_summary_edges(spark):
    df = spark.createDataFrame([(1, 1, 10, 1.0), (1, 2, None, None), (1, 3, 30, 0.5), (2, 1, None, 3.0)], "run int, seq int, step int, loss double")
    got = {r.run: r for r in train_log.summary(df, "loss").collect()}
    assert (got[1].trend, got[1].slope, got[1]["count"]) == ("falling", -0.025, 2)
    assert (got[2].trend, got[2].slope) == ("flat", None)


def test_oom_before_timeout(spark):
    df = spark.createDataFrame([(1, 2, "job timed out"), (1, 1, "CUDA out of memory. Tried 12.5 MiB"), (2, 1, "batch size: 8")], "run int, line_no int, line string")
    assert rows(train_log.first_failure(df), "run", "kind", "line_no") == [(1, "cuda_oom", 1)]
    assert rows(train_log.log_events(df), "run", "oom_lines", "gpu_mb", "batch_size") == [(1, 1, 12.5, None), (2, 0, None, 8)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"q": "1"}, {"q": "2"}]')
    (tmp_path / "b.jsonl").write_text('{"q": "1"}\nbroken\n{"q": "3"}\n')
    assert rows(files.read_samples(spark, str(tmp_path / "a.json"), "q string"), "q") == [("1",), ("2",)]
    assert rows(files.read_samples(spark, str(tmp_path / "b.jsonl"), "q string"), "q") == [("1",), ("3",)]
    win = files.window(spark.range(20), "id", 5, 3, F.col("id") % 2 == 0)
    assert rows(win, "id") == [(6,), (8,), (10,)]
    metrics = spark.createDataFrame(files.flatten_metrics({"a": {"acc": 55.0, "ok": True}, "b": [{"score": 0.3}]}), "path string, value double")
    assert rows(files.choose_metric(metrics, ["accuracy", "acc", "score"]), "path", "score") == [("a.acc", 0.55)]
    rows_out = spark.createDataFrame([("q", "", "a", "train")], "instruction string, input string, output string, split string")
    assert files.write_splits(rows_out, str(tmp_path / "out")).collect()[0].n == 1
    assert files.write_pack(rows_out, str(tmp_path / "pack"), "train")["train"]["formatting"] == "alpaca"


def test_catalog_search(spark):
    cat = spark.createDataFrame([("math-hard", 0), ("Math-easy", 1), ("code", 2)], "name string, position int")
    assert [r.name for r in files.search_catalog(cat, ["math easy", "math", "code"], 2).collect()] == ["Math-easy", "math-hard"]


def test_cleaners_report_failures(spark):
    from rowloom.operators import cleaning

    @cleaning.register("picky")
    def picky(record, context):
        if record["q"] == "bad":
            raise ValueError("no")
        return None if record["q"] == "drop" else {"question_text": record["q"] + context["tail"], "gold_answer": record["a"]}

    df = spark.createDataFrame([(1, "why", "x"), (2, "bad", "x"), (3, "drop", "x"), (4, "12", " ")], "seq long, q string, a string")
    out = cleaning.clean(df, "picky", {"tail": "?"})
    assert rows(cleaning.accepted(out), "position", "question_text", "train_output") == [(1, "why?", "x")]
    assert rows(cleaning.readiness(out), "cleaned", "failed", "ready") == [(2, 1, False)]
    said = cleaning.predict(df, "q", lambda ps: [p.upper() for p in ps])
    assert rows(said, "prediction")[0] == ("12",)
    assert rows(cleaning.classify(df, "q"), "module", "confidence")[0] == ("arithmetic_misc", 0.7)


def test_decisions(spark):
    from rowloom.operators import decisions

    logs = spark.createDataFrame([(0, 8, 2, 500), (1, 8, 2, 500), (3, 1, 2, 150)], "oom_lines int, batch long, accumulation long, samples long")
    assert rows(decisions.resources(logs), "action", "new_batch", "new_accumulation", "new_samples") == [
        ("keep", 8, 2, 500), ("reduce_batch", 4, 4, 500), ("reduce_samples", 1, 4, 100),
    ]
    asked = spark.createDataFrame([("a", "promote", "0.5", "1"), ("z", "fly", "x", "2"), (None, None, None, None)], "action_key string, decision string, replay_ratio string, confidence string")
    assert sorted(r.errors for r in decisions.proposal_errors(asked, ["a"]).collect()) == [
        [], ["invalid_action_key", "invalid_decision", "replay_ratio_not_number", "confidence_out_of_range"], ["missing_action_key"],
    ]
    assert decisions.search_policy("math", 2, 0.9, False, {})["policy"] == "merge_or_replace"
    assert decisions.search_policy("math", 2, 0.1, False, {"easy": 0.9, "hard": 0.2})["target"] == "hard"
    branch = spark.createDataFrame([(1, "a", "promote", 0.5, 0.0, 0.0, 0.2, 0.1, 0.0)], "seq int, action_key string, decision string, reward double, forget_recovery double, forgetting_recovery double, probe double, new_skill double, cotest double")
    assert abs(decisions.rank_branches(branch, "low_probe", 1).first().score - (0.2 + 0.015 + 0.1 + 0.15)) < 1e-9
    assert abs(decisions.rank_branches(branch, "repeated_rollback", 1).first().score - (0.2 + 0.15 + 0.3)) < 1e-9


def test_pauses_after_failures(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("b", 5.0)], "dataset string, at double")
    assert rows(lifecycle.blocked_until(df, 60.0, 2), "dataset", "until") == [("a", 80.0), ("b", None)]


def test_canonical_rows(spark):
    from rowloom.operators import normalize as N

    df = spark.createDataFrame(
        [(0, "why?", "because #### 4", ""), (1, "12", "x", ""), (2, " ", "x", ""), (3, "how", "", ""), (4, "sure?", '[{"role": "user", "content": "x"}]', ""), (5, "q", "a", "d/7")],
        "i long, q string, a string, rid string",
    )
    out = N.canonical(df, N.Fields("q", "a", row_id="rid"), "org/set", "i", split="train")
    assert rows(out, "question_id", "target_style", "evaluation_method") == [("org_set_train_0", "answer", "gold"), ("org_set_train_d_7", "answer", "gold")]
    assert N.canonical(df, N.Fields("q", "q"), "d", "i").count() == 0
    judged = N.canonical(df.withColumn("t", F.lit("long way")), N.Fields("q", train="t", method="llm_judge"), "d", "i")
    assert {r.evaluation_method for r in judged.collect()} == {"llm_judge"}
    rec = N.records(out.withColumn("split", F.lit("train")).withColumn("target_style", F.lit("cot")), "Q: {question_text}")
    got = rec.where("source_dataset_row_id = '0'").first()
    assert (got.instruction, got.output) == ("Q: why?", "because\n\n\\boxed{4}")
    assert N.processed_fields(out).where("train_output = ''").count() == 0


def test_polluted_and_fallback_rows(spark):
    from rowloom.operators import normalize as N

    df = spark.createDataFrame([("### Human: decode the problem. knowledge graph", "ok", True), ("human: hi", "Fallback schema", True), ("x", None, False), ("y", None, None)], "t string, reason string, usable boolean")
    assert [r[0] for r in df.select(N.is_polluted_reference(F.col("t"))).collect()] == [True, False, False, False]
    assert rows(N.without_fallback_schemas(df, "reason", "usable"), "t") == [("### Human: decode the problem. knowledge graph",), ("y",)]
    assert N.ranked_splits(["train", "test"], "test") == ["test", "train"] and N.ranked_splits([], "dev")[0] == "dev"
    maps = spark.createDataFrame([({"a": ["x", "y"], "b": []},)], "m map<string, array<string>>")
    assert rows(N.exploded(maps, "m"), "group", "item") == [("a", "x"), ("a", "y")]


def test_signatures_share_the_least_gram(spark):
    from rowloom.functions.text import gram_hashes

    texts = ["abcdefghijklmnopqrstuvwxyz", "xx abcdefghijklmnopqrstuvwxyz", "short", None, "0123456789 0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = docs.where("doc_id = 0")
    least = lambda t: min(gram_hashes((t or "").lower().replace("!", ""), 13), default=None)
    want = sorted((i,) for i, t in enumerate(texts) if least(t) is None or least(t) != least(texts[0]))
    assert rows(overlap.signature_split(docs, bench), "doc_id") == want
    assert rows(overlap.signature_split(docs, bench, hits=True), "doc_id") == sorted((i,) for i in range(6) if (i,) not in want)


def test_large_benchmarks_are_joined_alike(spark):
    docs = spark.createDataFrame([(i, "lorem ipsum dolor sit amet " * (i % 3) + str(i) * 9) for i in range(12)] + [(99, None)], "doc_id int, text string")
    bench = spark.createDataFrame([(1, "ipsum dolor sit amet lorem"), (2, "777777777 consectetur")], "item_id int, text string")
    a = overlap.gram_overlap(docs, bench, "doc_id", "item_id")
    b = overlap.gram_overlap(docs, bench, "doc_id", "item_id", most=0)
    cols = ("doc_id", "n_grams", "n_shared", "share")
    assert rows(a, *cols) == rows(b, *cols) and a.where("share > 0").count() > 0


def test_bounded_weights_give_every_key_the_least_share():
    assert quotas.bounded({"a": 0.5, "b": 0.3, "c": 0.2}) == pytest.approx({"a": 0.475, "b": 0.305, "c": 0.22})
    assert quotas.bounded({"a": 1.0, "b": 0.0, "c": 0.0}) == pytest.approx({"a": 0.8, "b": 0.1, "c": 0.1})
    assert quotas.bounded({}) == {} and quotas.bounded({"a": 0}) == pytest.approx({"a": 1.0})
    assert quotas.deficits({}) == quotas.bounded(quotas.USUAL) == quotas.deficits({"easy": 1.0, "medium": 1.0, "hard": 1.0})
    assert quotas.deficits({"easy": 0.9, "hard": 0.2}) == pytest.approx(quotas.bounded({"easy": 0.1, "medium": 0.7, "hard": 0.8}))


def test_places_within_groups_need_no_task_for_a_group(spark):
    from rowloom.operators import ranks

    rows = [(i, f"{i * 7919 % 1000:04d}", None if i % 5 == 4 else i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, s string, k long")
    for order, at in (("i", 0), ("s", 1)):
        got = {r.i: r._place for r in ranks.placed(df, ["k"], order).collect()}
        for key in (0, 1, 2, None):
            own = sorted((r for r in rows if r[2] == key), key=lambda r: r[at])
            assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))
    assert ranks.placed(df.limit(0), ["k"], "i").count() == 0


def test_roles_of_transcripts(spark):
    df = spark.createDataFrame([("intro\nPrompt: what?\nQuestion: a part of it\nResponse: this\nsystem: too\nGPT: end",)], "t string")
    turns = df.select(conversations.transcript_turns(F.col("t")).alias("x")).first()[0]
    assert [(t.role, t.content) for t in turns] == [
        ("user", "what?\nQuestion: a part of it"), ("assistant", "this\nsystem: too"), ("assistant", "end"),
    ]


def test_structured_answers_are_not_judged_by_their_last_number(spark):
    from rowloom.functions import answers as A

    rows = [
        ("(0, 5)", "[2, 5]", False), ("so (0, 5)", "(0,5)", False), ("the answer is (0, 5).", "(0,5)", True), ("x=3", "X = 3.", True), ("1,234", "1234", False),
        ("it is 7", "7", True), ("it is 8", "7", False), (None, "7", False), ("7", None, False), ("", "", False), ("#### A", "a", True),
    ]
    df = spark.createDataFrame(rows, "p string, g string, want boolean")
    assert [r.got for r in df.select(A.same_answer(F.col("p"), F.col("g")).alias("got")).collect()] == [r[2] for r in rows]
    boxed = spark.createDataFrame([("so \\boxed{\\frac{1}{2}}", "\\boxed{\\frac{1}{2}}"), ("so \\boxed{3}", "\\boxed{4}")], "p string, g string")
    pairs = (A.last_boxed(F.col("p")), A.last_boxed(F.col("g")))
    assert [r[0] for r in boxed.select(A.same_answer(F.col("p"), F.col("g"), pairs)).collect()] == [True, False]
    kinds = spark.createDataFrame([("12",), ("-1,000.5",), ("\\frac{1}{2}",), ("a = b",), ("(1, 2)",), ("12 apples",), ("",)], "t string")
    got = kinds.select(A.is_plain_number(F.col("t")).alias("a"), A.is_structured(F.col("t")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(True, False), (True, False), (False, True), (False, True), (False, True), (False, False), (False, False)]


def test_falls_within_standard_errors(spark):
    rows = [(0.5, 0.5, 0, False), (0.5, 0.6, 10, True), (0.5, 0.4, 30, True), (0.5, 0.4, 3000, False), (1.0, 1.0, 5, True), (0.5, 0.4, 1, False)]
    df = spark.createDataFrame(rows, "a double, b double, n long, want boolean")
    got = df.select(evaluation.drop_is_small(F.col("a"), F.col("b"), F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == [r[3] for r in rows]


def test_repeated_questions_keep_the_least(spark):
    rows = [(i, "same question" if i != 3 else "other", "answer") for i in (5, 2, 3, 9)]
    df = spark.createDataFrame(rows, "seq long, q string, a string")
    out = filtering.judge(df, filtering.Rules(dedup="question"), F.col("q"), F.col("a"), "seq")
    assert {r.seq: r.reason for r in out.collect()} == {2: None, 3: None, 5: "duplicate", 9: "duplicate"}


def test_surrogate_in_blocks_is_the_same(spark):
    import math

    points = [(i, i / 5, (i * i % 7) / 7) for i in range(5)]
    seen = [(j / 9, (j * 3 % 11) / 11, j / 4 - 1) for j in range(9)]
    candidates = spark.createDataFrame(points, "candidate_id int, x double, y double")
    samples = spark.createDataFrame(seen, "x double, y double, reward double")
    for block in (1, 2, 5, 200):
        got = {r.candidate_id: r for r in surrogate.kernel_surrogate(candidates, samples, ["x", "y"], block=block).collect()}
        assert len(got) == len(points)
        for i, x, y in points:
            w = [math.exp(-((x - a) ** 2 + (y - b) ** 2) / (2 * 0.25**2)) for a, b, _ in seen]
            assert math.isclose(got[i].support, sum(w)) and math.isclose(got[i].expected, sum(v * r for v, (_, _, r) in zip(w, seen)) / sum(w))
    assert surrogate.kernel_surrogate(candidates.limit(0), samples, ["x", "y"]).count() == 0


def test_reservations_end_with_the_decision(spark):
    items = [(q, s, 1 if s == "defeated" else None, None, None) for q, s in zip("abcdefg", ["reserved"] * 5 + ["unused", "defeated"])]
    df = spark.createDataFrame([("d", *x) for x in items], "dataset string, question_id string, state string, defeats long, defeated_round long, defeated_accuracy double")
    rounds = [("a", 1), ("b", 2), ("c", 3), ("d", 3), ("d", 4), ("e", 9), ("f", 4), ("g", 4)]
    reserved = spark.createDataFrame([("d", q, r) for q, r in rounds], "dataset string, question_id string, round_id long")
    decisions = spark.createDataFrame(
        [(1, "promote", 0.5, None), (2, "provisional_promote", 0.5, False), (3, "rollback", 0.3, True), (4, "rollback", 0.4, None)],
        "round_id long, decision string, probe_acc double, reusable boolean",
    )
    got = {r.question_id: tuple(r)[2:] for r in lifecycle.finalized(df, reserved, decisions).collect()}
    assert got["a"] == got["b"] == ("used", 0, None, None)
    assert got["c"] == got["e"] == ("reserved", 0, None, None)  # tried again; no decision yet
    assert got["d"] == ("defeated", 1, 4, 0.4)
    assert got["f"] == ("unused", 0, None, None) and got["g"] == ("defeated", 1, None, None)


def test_pauses_end_and_are_cleared(spark):
    failures = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 4.0), ("c", 5.0), ("c", 6.0)], "dataset string, at double")
    names = lambda **k: {r.dataset: r.remaining for r in lifecycle.paused(failures, **k).collect()}
    assert names(now=7.0, wait=3.0) == {"a": 1.0, "c": 2.0}
    assert names(now=6.5, wait=3.0, after=2) == {"a": 1.5, "c": 2.5}
    cleared = spark.createDataFrame([("c", 5.5), ("a", 5.0)], "dataset string, at double")
    assert names(now=6.5, wait=3.0, cleared=cleared) == {"b": 0.5, "c": 2.5}
    assert names(now=6.5, wait=3.0, after=2, cleared=cleared) == {}


def test_signatures_come_from_one_hash_a_text_in_small_batches(spark, monkeypatch):
    from rowloom.functions import text as T
    from rowloom.operators import batches

    monkeypatch.setattr(T, "_SLICE", 10)  # slices of a text meet no gram twice and leave none out
    texts = ["", "x" * 12, "x" * 13, "the quick brown fox jumps over the lazy dog é漢字", "0123456789" * 5]
    assert [T.least_hash(t, 13) for t in [None, *texts]] == [min(T.gram_hashes(t, 13).tolist(), default=None) for t in [None, *texts]]
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(setting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = overlap.signature_split(docs, docs.where("doc_id = 3"))
    assert rows(out, "doc_id") == [(0,), (1,), (2,), (4,)] and int(spark.conf.get(setting)) <= batches.ROWS
    assert "char_grams" not in out._jdf.queryExecution().toString()


def test_python_gets_few_rows_at_once(spark):
    from rowloom.operators import batches, cleaning

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(setting)
    df = spark.range(0, 3_000, 1, 1).select("id", F.concat(F.lit("why "), "id").alias("question_text"), F.lit("x").alias("gold_answer"))
    assert cleaning.clean(df, "identity", position="id").where("error is null").count() == 3_000 and int(spark.conf.get(setting)) <= batches.ROWS
    spark.conf.unset(setting)
    sizes = cleaning.predict(df, "question_text", lambda prompts: [str(len(prompts))] * len(prompts)).select(F.col("prediction").cast("int"))
    assert sizes.agg(F.max("prediction"), F.count("*")).first() == (batches.ROWS, 3_000)


def test_no_task_sees_all_candidates(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(["promote", "hold", None, "promote", "hold", "reject", "hold"])] + [(6, "hold"), (None, "promote")], "round_id int, decision string")
    out = search_graph.retained(df, 3)
    assert out.columns == ["round_id", "decision", "keep"] and out.count() == 9
    kept = sorted(map(tuple, out.where("keep").select("round_id", "decision").collect()))
    assert kept == [(3, "promote"), (5, "reject"), (6, "hold"), (6, "hold")]
    assert "Window" not in out._jdf.queryExecution().toString()
    assert search_graph.retained(df.limit(0)).count() == 0


def test_bounded_weights_of_the_least_numbers():
    got = quotas.bounded({"easy": 0.0, "medium": 1.0, "hard": 5e-324})
    assert got == pytest.approx({"easy": 0.05, "medium": 0.8, "hard": 0.15})
