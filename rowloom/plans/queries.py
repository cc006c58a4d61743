"""Operators of this library over the synthetic tables, whole tables always.

Documents stand for questions, events for attempts, lineitem for training
series, orders for edges of the experiment graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import identity as I
from ..functions import text as T
from ..operators import (
    bundles, cleaning, conversations, decisions, dedup, evaluation, filtering, lifecycle, normalize, overlap, profile, quotas, rollouts, sampling, search_graph, splits, surrogate,
    train_log,
)
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RATIOS = {"train": 0.7, "cotest": 0.1, "test": 0.1, "probe": 0.1}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("doc_"), "doc_id").alias("question_id"),
        F.col("text").alias("question"),
        F.element_at(F.split("text", "\n"), -1).alias("answer"),
        F.col("source").alias("dataset"),
        "lang",
    )


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return _table(spark, sf, "events").select(
        F.col("user_id").alias("question_id"),
        place.alias("rollout_idx"),
        F.col("event_type").isin("purchase", "view").alias("correct"),
        "event_type",
        "event_id",
    )


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    easy, medium = rollouts.thresholds()
    own = F.bround(F.col("pass_count") * rollouts.TRIES / F.col("rollout_count"), 0)
    return rollouts.scores(_attempts(spark, sf)).withColumn("difficulty", rollouts.difficulty(own, F.col("rollout_count"), easy, medium))


_RULES = {"min_question": 100, "max_question": 20_000, "min_answer": 2, "max_answer": 2_000, "languages": ("en", "zh")}


def _screened(spark: SparkSession, sf: str, dedup_by: str, **carry) -> DataFrame:
    rules = filtering.Rules(**_RULES, dedup=dedup_by)
    return filtering.screened(_questions(spark, sf), rules, F.col("question"), F.col("answer"), "seq", carry)


@_query
def filter_reasons(spark, sf):
    return filtering.reasons(_screened(spark, sf, "question"))


@_query
def filter_kept(spark, sf):
    rules = filtering.Rules(**_RULES, dedup="question")
    return filtering.kept(filtering.judge(_questions(spark, sf), rules, F.col("question"), F.col("answer"), "seq")).select("seq", "dataset")


@_query
def filter_dedup_question_answer(spark, sf):
    return filtering.reasons(_screened(spark, sf, "question_answer"))


@_query
def filter_dedup_rows(spark, sf):
    rows = _questions(spark, sf).select("seq", "question", "lang")
    rules = filtering.Rules(min_question=100, dedup="row")
    return filtering.reasons(filtering.screened(rows, rules, F.col("question"), F.col("lang"), "seq"))


@_query
def flagship_curriculum(spark, sf):
    """Filter, exact decontamination, topic, stratified split, counted. Texts are read once and go no further than their hashes and topics."""
    question = F.col("question")
    kept = filtering.kept(_screened(spark, sf, "question", dataset=F.col("dataset"), fuzzy=overlap.fuzzy_key(question), module=T.module_of(question)))
    clean = overlap.exact_split_keyed(kept, _table(spark, sf, "benchmark"), "fuzzy")
    split = splits.stratified_split(clean.select("seq", "dataset", "module"), ["dataset", "module"], "seq", RATIOS)
    return split.groupBy("split", "module").agg(F.count("*").alias("n"))


@_query
def column_profile_documents(spark, sf):
    return profile.column_profile(_table(spark, sf, "documents")).select("column_name", "kind", "avg_length", "null_share")


@_query
def normalize_text_hash(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.md5(T.fuzzy(F.col("text"))).alias("fuzzy_md5"), I.text_hash(F.col("text")).alias("text_hash"))


@_query
def decontam_exact_clean(spark, sf):
    return overlap.exact_split(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")).select("doc_id")


@_query
def decontam_exact_hits(spark, sf):
    bench = _table(spark, sf, "documents").where("lang = 'es'")
    return overlap.exact_split(_table(spark, sf, "documents"), bench, hits=True).select("doc_id")


@_query
def decontam_ngram_overlap(spark, sf):
    rows = overlap.gram_overlap(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), "doc_id", "item_id")
    return rows.select("doc_id", "n_grams", "n_shared", (F.col("share") >= 0.8).alias("dropped"), (F.col("share") >= 0.1).alias("suspect"))


@_query
def decontam_min_signature(spark, sf):
    own = overlap.min_signature(F.col("text"))
    return _table(spark, sf, "benchmark").select("item_id", own.alias("signature"))


@_query
def decontam_signature_clean(spark, sf):
    return overlap.signature_split(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")).select("doc_id")


@_query
def module_histogram(spark, sf):
    rows = _table(spark, sf, "documents").withColumn("module", T.module_of(F.col("text")))
    return rows.groupBy("module").agg(F.count("*").alias("n"))


@_query
def conversation_pairs(spark, sf):
    return conversations.pairs(_table(spark, sf, "conversations")).select("conv_id", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


def _samples(spark, sf):
    rows = conversations.pairs(_table(spark, sf, "conversations"))
    return conversations.sft_samples(rows, ["question"], ["answer"], "Q: {question}", ["conv_id"])


@_query
def sft_alpaca(spark, sf):
    return conversations.to_alpaca(_samples(spark, sf)).select("conv_id", "instruction", "input", "output", "system")


@_query
def sft_sharegpt(spark, sf):
    rows = conversations.to_sharegpt(_samples(spark, sf)).select("conv_id", F.posexplode("conversations").alias("turn", "c"))
    return rows.select("conv_id", "turn", F.col("c.from").alias("who"), F.col("c.value").alias("value"))


@_query
def sft_raw(spark, sf):
    return conversations.to_raw(_samples(spark, sf)).select("conv_id", "text")


@_query
def solution_markers(spark, sf):
    t = F.col("text")
    return _table(spark, sf, "documents").select(
        "doc_id", T.is_worked_solution(t).alias("worked"), T.is_proof_code(t).alias("proof"), T.is_serialized_chat(t).alias("chat"),
        T.is_valid_question(t).alias("valid"),
    )


@_query
def target_style(spark, sf):
    own = T.target_style(F.col("question"), F.col("answer"), F.lit(None).cast("string"))
    return _questions(spark, sf).groupBy(own.alias("style")).agg(F.count("*").alias("n"))


@_query
def opaque_ids(spark, sf):
    return _table(spark, sf, "part").groupBy(T.is_opaque_id(F.col("p_name")).alias("opaque")).agg(F.count("*").alias("n"))


@_query
def last_number(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.coalesce(A.last_number(F.col("text")), F.lit("")).alias("last_number"))


@_query
def final_answer(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.md5(A.final_answer(F.col("text"))).alias("answer_md5"))


@_query
def boxed_answer(spark, sf):
    wrapped = F.concat(F.col("text"), F.lit(" \\boxed{"), F.substring("text", 1, 8), F.lit("}"))
    return _table(spark, sf, "documents").select("doc_id", A.last_boxed(wrapped).alias("boxed"))


@_query
def numeric_match(spark, sf):
    rows = _table(spark, sf, "events").select("event_id", A.numeric_match(F.col("props"), F.col("user_id").cast("string")).alias("same"))
    return rows.groupBy("same").agg(F.count("*").alias("n"))


@_query
def token_estimates(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@_query
def trace_features(spark, sf):
    t = F.col("text")
    words = F.size(F.array_remove(F.split(t, r"\s+"), ""))
    ended = F.regexp_replace(t, r"\s+\z", "").rlike(r"[.!?。！？}\]]\z")
    near = words >= 384
    return _table(spark, sf, "documents").select(
        "doc_id", F.length(t).cast("long").alias("chars"), words.cast("long").alias("words"), near.alias("near_budget"),
        (near & ~ended).alias("possible_truncation"), F.md5(T.clip(t, 200)).alias("clipped_md5"),
    )


@_query
def split_ratio(spark, sf):
    return splits.ratio_split(_table(spark, sf, "documents").select("doc_id"), "doc_id", 0.1)


@_query
def split_existing(spark, sf):
    rows = _table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "fr", "TEST").when(F.col("lang") == "en", "train").alias("label"))
    return splits.existing_split(rows, "label", "doc_id", 0.1).select("doc_id", "split")


@_query
def split_holdout_by_key(spark, sf):
    return splits.holdout_by_key(_table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 0.15)


def _stratified(spark, sf):
    rows = _questions(spark, sf).withColumn("module", T.module_of(F.col("question")))
    return splits.stratified_split(rows.select("seq", "lang", "module"), ["lang", "module"], "seq", RATIOS)


@_query
def stratified_split_counts(spark, sf):
    return _stratified(spark, sf).groupBy("lang", "module", "split").agg(F.count("*").alias("n"))


@_query
def stratified_split_rows(spark, sf):
    return _stratified(spark, sf).select("seq", "split")


@_query
def lf_val_carve(spark, sf):
    return splits.validation_carve(_table(spark, sf, "documents").select("doc_id"), "doc_id")


@_query
def quota_largest_remainder(spark, sf):
    weights = _table(spark, sf, "documents").groupBy(F.col("source").alias("key")).agg(F.countDistinct("lang").cast("double").alias("weight"))
    return quotas.largest_remainder(weights, 97)


def _plan(spark, sf):
    rows = _table(spark, sf, "documents").select("doc_id", "lang", "source")
    weights = rows.groupBy(F.col("lang").alias("key")).agg(F.countDistinct("source").cast("double").alias("weight"))
    return rows, quotas.largest_remainder(weights, 90).withColumnRenamed("key", "lang")


@_query
def plan_sample(spark, sf):
    rows, plan = _plan(spark, sf)
    return sampling.plan_sample(rows, plan, ["lang"], "doc_id", 100)


@_query
def sample_shortfall(spark, sf):
    rows, plan = _plan(spark, sf)
    few = rows.where("source = 'src1'")
    return quotas.shortfall(plan, few, rows.where("source = 'src2'"), "lang")


@_query
def supplement_pools(spark, sf):
    rows, plan = _plan(spark, sf)
    lacking = quotas.shortfall(plan, rows.where("source = 'src1'"), rows.where("source = 'src2'"), "lang")
    return sampling.supplement(rows.where("source not in ('src1', 'src2')"), lacking, "lang", ["source", "doc_id"])


@_query
def round_robin_probe(spark, sf):
    out = sampling.round_robin(_table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 120)
    return out.select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


@_query
def focus_sample(spark, sf):
    rows = _table(spark, sf, "documents").select("doc_id", "lang", "source")
    tier = F.when((F.col("lang") == "de") & (F.col("source") == "src3"), 0).when(F.col("lang") == "de", 1).when(F.col("source") == "src3", 2).otherwise(3)
    return sampling.focus_sample(rows, tier, "doc_id", 60)


@_query
def rollout_scores(spark, sf):
    return _scored(spark, sf).select("question_id", "pass_count", "rollout_count", "pass_rate", F.concat_ws("", F.transform("correct_flags", lambda c: c.cast("int"))).alias("flags"))


@_query
def pass_count_histogram(spark, sf):
    return rollouts.pass_histogram(_scored(spark, sf)).select("bin", "n")


@_query
def threshold_policy(spark, sf):
    return rollouts.threshold_policy(rollouts.pass_histogram(_scored(spark, sf)))


@_query
def difficulty_from_pass_rate(spark, sf):
    return _scored(spark, sf).groupBy("difficulty").agg(F.count("*").alias("n"))


@_query
def cascade_difficulty(spark, sf):
    tries = _attempts(spark, sf)
    first, second = tries.where("rollout_idx = 0"), tries.where("rollout_idx = 1")
    return rollouts.cascade(first, second).groupBy("rollout_stage", "difficulty").agg(F.count("*").alias("n"))


@_query
def mastered(spark, sf):
    tries = _attempts(spark, sf).withColumn("correct", F.col("event_type") != "error")
    return rollouts.mastered(rollouts.scores(tries)).select("question_id", "pass_count")


@_query
def pass_at_k(spark, sf):
    return rollouts.pass_at_k(_attempts(spark, sf)).select("n", "pass_at_k", F.round("mean_rate", 6).alias("mean_rate"))


@_query
def accuracy_by_role(spark, sf):
    return rollouts.accuracy(_attempts(spark, sf), "event_type")


@_query
def accuracy_by_difficulty(spark, sf):
    hard = _scored(spark, sf).select("question_id", "difficulty")
    return rollouts.accuracy(_attempts(spark, sf).join(hard, "question_id"), "difficulty").select("difficulty", "n", F.round("accuracy", 9).alias("accuracy"))


def _rounds(spark, sf):
    """A round for each ship month, metrics from shares of its lines."""
    share = lambda c: F.avg(c.cast("double"))
    return (
        _table(spark, sf, "lineitem")
        .groupBy((F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("round_id"))
        .agg(
            share(F.col("l_quantity") > 12).alias("probe_acc"), share(F.col("l_quantity") > 13).alias("champion_probe_acc"),
            share(F.col("l_quantity") > 14).alias("base_probe_acc"), share(F.col("l_discount") > 0.05).alias("old_before"),
            share(F.col("l_discount") > 0.04).alias("old_after"), F.count("*").alias("old_count"),
            share(F.col("l_tax") > 0.04).alias("forgetting"), share(F.col("l_tax") > 0.05).alias("new_before"),
            share(F.col("l_tax") > 0.03).alias("new_after"), share(F.col("l_linenumber") > 3).alias("cotest_before"),
            share(F.col("l_linenumber") > 2).alias("cotest_after"),
        )
    )


@_query
def eval_gates(spark, sf):
    return evaluation.gates(_rounds(spark, sf)).select("round_id", "pass_frozen", "pass_old", "pass_new", "pass_probe", "promote", "stop")


@_query
def candidate_reward(spark, sf):
    out = evaluation.reward(evaluation.gates(_rounds(spark, sf)))
    return out.select("round_id", F.round("raw_reward", 6).alias("raw_reward"), F.round("reward", 6).alias("reward"))


def _inspected(spark, sf):
    """Rounds with their gates, rewards, promise and trend; few rows, so a window over all does no harm."""
    from pyspark.sql.window import Window

    past = Window.partitionBy(F.floor(F.col("round_id") / 12)).orderBy("round_id").rowsBetween(-3, -1)
    rows = evaluation.reward(evaluation.gates(_rounds(spark, sf)))
    rows = rows.withColumns({f"best_{c}": F.max(c).over(past) for c in evaluation.TREND} | {"new_count": F.col("old_count") % 90})
    rows = rows.withColumns({"round": F.col("round_id"), "rollback_streak": F.col("round_id") % 6})
    rows = rows.withColumns({"pass_frozen": F.col("round") % 5 != 0, "pass_old": F.col("round") % 7 != 0})
    return evaluation.inspection(evaluation.positive_trend(evaluation.promising(rows)).withColumn("round_id", F.col("round") % 12))


@_query
def inspection_decisions(spark, sf):
    return _inspected(spark, sf).select(F.col("round").alias("round_id"), "promising", "positive_trend", "decision")


@_query
def proportion_drops(spark, sf):
    rows = _rounds(spark, sf)
    return rows.select("round_id", evaluation.drop_is_small(F.col("new_after"), F.col("new_before"), F.col("old_count")).alias("small"))


@_query
def difficulty_weights(spark, sf):
    """Weights of three difficulties from their accuracy; three numbers on the driver."""
    known = {r.difficulty: r.accuracy for r in accuracy_by_difficulty(spark, sf).collect()}
    got = quotas.deficits(known)
    return spark.createDataFrame([(k, round(w, 9)) for k, w in got.items()], "difficulty string, weight double")


@_query
def bounded_shares(spark, sf):
    """Shares of the languages within bounds; a few numbers on the driver."""
    sizes = {r[0]: float(r[1]) for r in _table(spark, sf, "documents").groupBy("lang").count().collect()}
    return spark.createDataFrame([(k, round(w, 9)) for k, w in quotas.bounded(sizes, 0.1, 0.4).items()], "lang string, weight double")


@_query
def transcript_pairs(spark, sf):
    """Conversations written as transcripts and read again."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), F.coalesce(t["text"], F.lit("")))), "\n")
    texts = _table(spark, sf, "conversations").groupBy("conv_id").agg(lines.alias("t"))
    said = conversations.transcript_turns(F.col("t"))
    q, a = conversations.array_pairs(said)
    return texts.select("conv_id", F.md5(F.coalesce(q, F.lit(""))).alias("question_md5"), F.md5(F.coalesce(a, F.lit(""))).alias("answer_md5"))


@_query
def judged_answers(spark, sf):
    """Answers of several forms: a predicted one from props, a gold one that is a number, an interval or an equation."""
    kind, n = F.col("event_id") % 4, F.col("user_id").cast("string")
    gold = F.when(kind == 0, n).when(kind == 1, F.concat(F.lit("(0, "), n, F.lit("]"))).when(kind == 2, F.concat(F.lit("x = "), n)).otherwise(F.concat(n, F.lit(" apples")))
    other = F.when(F.col("event_type") == "view", F.concat(F.lit("[1, "), n, F.lit("]"))).when(F.col("event_type") == "click", F.concat(F.lit("the answer is X = "), n)).otherwise(
        F.concat(F.lit("so it must be "), n)
    )
    said = F.when(F.col("event_type") == "purchase", F.upper(gold)).otherwise(other)
    rows = _table(spark, sf, "events").select(kind.alias("kind"), "event_type", A.is_plain_number(gold).alias("plain"), A.is_structured(gold).alias("structured"), A.same_answer(said, gold).alias("same"))
    return rows.groupBy("kind", "event_type", "plain", "structured", "same").agg(F.count("*").alias("n"))


@_query
def goal_queries(spark, sf):
    """Queries that fall back on another column, then on the domain of a goal."""
    said = F.when(F.col("p_partkey") % 3 == 0, "HuggingFace dataset search").when(F.col("p_partkey") % 3 == 1, "medium difficulty").otherwise(F.col("p_name"))
    fallback = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit("hard dataset"))
    goal = F.when(F.col("p_size") < 10, "better at ALGEBRA").when(F.col("p_size") < 20, "fix a bug").when(F.col("p_size") < 30, "translate logic").otherwise("poems")
    return _table(spark, sf, "part").select("p_partkey", T.content_query(said, goal, fallback).alias("query"))


@_query
def metadata_columns(spark, sf):
    """Rows of question tables by the name of their question column; metadata names give none."""
    parts = []
    for name in ("title", "category", "domain", "Language"):
        rows = _table(spark, sf, "part").select("p_partkey", F.concat(F.lit("What is the price of "), "p_name", F.lit("?")).alias(name), F.col("p_brand").alias("answer"))
        out = normalize.canonical(rows, normalize.Fields(question=name, answer="answer"), "parts", "p_partkey")
        parts.append(out.agg(F.lit(name).alias("column"), F.count("*").alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _registry(spark, sf, of="true"):
    """Every order is an event of its customer's question; those that ``of`` does not hold for are released."""
    status = F.element_at(F.array(*[F.lit(s) for s in dedup.STATUS_RANK]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    status = F.when(F.expr(of), status).otherwise("released")
    return _table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("source_dataset_id"),
        F.lit(None).cast("string").alias("source_dataset_subset"), F.lit(None).cast("string").alias("source_dataset_split"),
        F.col("o_custkey").cast("string").alias("source_dataset_row_id"), F.concat(F.lit("doc_"), "o_custkey").alias("question_id"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("text_hash"), status.alias("status"),
    )


@_query
def registry_merge(spark, sf):
    return dedup.registry_state(_registry(spark, sf)).groupBy("status").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


def _asked(spark, sf):
    return _questions(spark, sf).select(
        "seq", "question_id", F.lit("1-URGENT").alias("dataset"), F.col("seq").cast("string").alias("row_id"), I.text_hash(F.col("question")).alias("text_hash")
    )


@_query
def registry_block_train(spark, sf):
    return overlap.registry_block(_asked(spark, sf), _registry(spark, sf), overlap.TRAIN_BLOCKING).select("seq")


@_query
def registry_block_test(spark, sf):
    return overlap.registry_block(_asked(spark, sf), _registry(spark, sf, "o_orderstatus = 'P'"), overlap.TEST_BLOCKING).select("seq")


@_query
def overlap_exclusion(spark, sf):
    keys = I.key_set(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("question"), F.col("question_id"))
    rows = _questions(spark, sf).withColumn("keys", keys)
    return overlap.without_overlapping_keys(rows, rows.where("dataset = 'src0'"), "keys", "seq").select("seq")


def _line_number():
    """A number for each line, rising with its order; lines of equal order, number and price share it."""
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.floor(F.col("l_extendedprice") * 100 + 0.5)


def _replay(spark, sf):
    used = F.filter(F.array(F.col("l_linenumber") % 5, F.col("l_suppkey") % 7), lambda x: x > 1)
    return _table(spark, sf, "lineitem").select(
        _line_number().alias("seq"), F.col("l_partkey").alias("question_id"),
        F.when(F.col("l_quantity") < 17, "hard").when(F.col("l_quantity") < 34, "medium").otherwise("easy").alias("bucket"),
        F.transform(used, lambda x: x.cast("int")).alias("used_in_rounds"), F.col("l_extendedprice").alias("success"),
    )


@_query
def replay_newest(spark, sf):
    return sampling.newest_versions(_replay(spark, sf), "question_id", "seq", 1000).select("seq", "question_id")


@_query
def replay_lru_sample(spark, sf):
    return sampling.least_used(_replay(spark, sf), "bucket", 100, "seq", "hard").select("seq", "bucket")


@_query
def replay_topk(spark, sf):
    rows = _replay(spark, sf).drop("used_in_rounds")
    return sampling.admit(rows.where("bucket = 'hard'"), rows.where("bucket = 'easy'"), "question_id", "success", "seq", 200).select("seq", "success")


@_query
def replay_mix(spark, sf):
    new = _replay(spark, sf).where("bucket = 'medium'")
    out = sampling.replay_mix(new, _replay(spark, sf).where("bucket = 'hard'"), 0.1, "bucket", "seq")
    return out.groupBy("source_role").agg(F.count("*").alias("n"), F.sum(F.col("seq") % 1_000_003).alias("seqs"))


def _item_events(spark, sf):
    kinds = ("register", "reserve", "use", "defeat", "unreserve", "revive", "rate")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("event_id") % 7 + 1).cast("int"))
    return _table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("dataset"), F.col("user_id").alias("question_id"), kind.alias("kind"),
        F.col("value").alias("pass_rate"), F.lit(1).cast("long").alias("rollout_count"),
    )


@_query
def item_state_current(spark, sf):
    return lifecycle.item_states(_item_events(spark, sf)).select("dataset", "question_id", "state")


@_query
def dataset_state_counts(spark, sf):
    return lifecycle.dataset_counts(lifecycle.item_states(_item_events(spark, sf)))


@_query
def unused_items(spark, sf):
    items = lifecycle.item_states(_item_events(spark, sf))
    asked = _table(spark, sf, "events").select(F.col("event_type").alias("dataset"), F.col("user_id").alias("question_id")).distinct()
    return overlap.unused_only(asked, items)


@_query
def rollout_cache_split(spark, sf):
    cache = _table(spark, sf, "events").select(
        F.col("event_type").alias("dataset"), F.col("user_id").alias("question_id"), F.lit("unused").alias("state"),
        (F.col("event_id") % 3).alias("rollout_count"), F.when(F.col("event_id") % 2 == 0, "m1").otherwise("").alias("model_key"),
        F.lit("").alias("config_hash"), F.when(F.col("event_id") % 5 == 0, "old").otherwise("v1").alias("judge_version"),
    )
    asked = cache.select("dataset", "question_id").distinct()
    return overlap.cache_lookup(asked, cache, "m1", "c", "v1").groupBy("dataset", "cached").agg(F.count("*").alias("n"))


@_query
def shard_refs(spark, sf):
    sizes = _table(spark, sf, "documents").groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("n"))
    return files.shards(sizes, 30).withColumn("score", F.round("score", 9))


@_query
def window_offsets(spark, sf):
    """Rows seen are the labelled ones."""
    seen = _table(spark, sf, "documents").join(_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    items = seen.select(F.col("source").alias("dataset"), F.col("doc_id").alias("idx"))
    return lifecycle.next_offsets(items, 20)


@_query
def window_reuse_score(spark, sf):
    items = _table(spark, sf, "documents").select(F.col("source").alias("dataset"), F.col("doc_id").alias("idx"), F.col("lang").alias("difficulty"))
    return lifecycle.reuse_score(items, {"en": 3, "fr": 2, "de": 1}, 100)


def _series(spark, sf):
    """A run for each part, its lines in order of orders."""
    return _table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("run"), _line_number().alias("seq"), F.col("l_orderkey").alias("step"), (F.col("l_extendedprice") / 1000).alias("loss"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("eval_loss"), F.col("l_tax").alias("learning_rate"),
    )


@_query
def loss_series_summary(spark, sf):
    out = train_log.summary(_series(spark, sf), "loss")
    return out.select("run", "first", "last", "min", "min_at_step", "max", "max_at_step", F.round("slope", 9).alias("slope"), F.round("std", 6).alias("std"), "trend", "count")


@_query
def loss_spikes(spark, sf):
    return train_log.spikes(_series(spark, sf))


@_query
def lr_shape(spark, sf):
    return train_log.schedule_shape(_series(spark, sf))


@_query
def loss_phase(spark, sf):
    s = _series(spark, sf)
    return train_log.phase(train_log.summary(s, "loss"), train_log.summary(s, "eval_loss"), train_log.schedule_shape(s))


@_query
def log_failures(spark, sf):
    lines = _table(spark, sf, "documents").select(F.col("source").alias("run"), F.col("doc_id").alias("line_no"), F.concat(F.col("text"), F.when(F.col("doc_id") % 11 == 5, " request timed out").when(F.col("doc_id") % 13 == 7, " CUDA out of memory").otherwise("")).alias("line"))
    return train_log.first_failure(lines).select("run", "kind", "line_no")


def _edges(spark, sf):
    return _table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("from_node_id"), (F.col("o_custkey") * 7 % 1013 + 1).alias("to_node_id"),
        F.col("o_orderpriority").alias("action_key"), (F.col("o_totalprice") / 1e6).alias("reward"),
    )


@_query
def ucb_actions(spark, sf):
    edges = _edges(spark, sf)
    actions = edges.select("action_key").distinct().unionByName(spark.createDataFrame([("untried",)], "action_key string"))
    ranked = search_graph.rank_actions(actions.withColumn("position", F.col("action_key")), edges)
    return ranked.select("action_key", F.col("visits").cast("long").alias("visits"), F.round("mean_reward", 9).alias("mean_reward"), F.col("rank").cast("long").alias("rank"))


@_query
def dag_expansions(spark, sf):
    nodes = _table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("value"))
    return search_graph.expansions(nodes, _edges(spark, sf), "value").select("seq", F.round("delta_value", 4).alias("delta_value"))


@_query
def best_edges(spark, sf):
    return search_graph.best_edges(_edges(spark, sf), 20, F.col("reward").desc(), F.col("seq")).select("seq", "reward")


@_query
def top_cards(spark, sf):
    nodes = _table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("value_estimate"))
    return search_graph.top_cards(nodes, _edges(spark, sf), 15, 3).select("from_node_id", "seq", F.col("place").cast("long").alias("place"))


@_query
def tag_similarity(spark, sf):
    parts = _table(spark, sf, "part").withColumn("tags", F.split("p_type", " "))
    nodes = parts.select(F.col("p_partkey").alias("node_id"), "tags")
    wanted = parts.groupBy("p_brand").agg(F.min_by("tags", "p_partkey").alias("tags")).select(F.col("p_brand").alias("query_id"), "tags")
    return search_graph.tag_similarity(wanted, nodes, 5).withColumn("place", F.col("place").cast("long"))


@_query
def kernel_surrogate(spark, sf):
    candidates = _table(spark, sf, "nation").select(F.col("n_nationkey").alias("candidate_id"), (F.col("n_nationkey") / 25).alias("x"), (F.col("n_regionkey") / 5).alias("y"))
    samples = _table(spark, sf, "supplier").select((F.col("s_nationkey") / 25).alias("x"), (F.col("s_suppkey") % 5 / 5).alias("y"), (F.col("s_acctbal") / 1e4).alias("reward"))
    out = surrogate.kernel_surrogate(candidates, samples, ["x", "y"])
    return out.select("candidate_id", F.round("support", 6).alias("support"), F.round("expected", 6).alias("expected"))


@_query
def finalised_reservations(spark, sf):
    o, r = _table(spark, sf, "orders"), F.col("r_regionkey").cast("long")
    key = [F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").cast("string").alias("question_id")]
    state = F.when(F.col("o_orderstatus") == "P", "used").otherwise("reserved").alias("state")
    none = [F.lit(0).cast("long").alias("defeats"), F.lit(None).cast("long").alias("defeated_round"), F.lit(None).cast("double").alias("defeated_accuracy")]
    decision = F.when(r == 0, "promote").when(r == 1, "provisional_promote").when(r <= 3, "rollback").otherwise("prune")
    decisions = _table(spark, sf, "region").select(r.alias("round_id"), decision.alias("decision"), ((r + 1) / 10).alias("probe_acc"), (r == 2).alias("reusable"))
    out = lifecycle.finalized(o.select(*key, state, *none), o.select(*key, (F.col("o_custkey") % 5).cast("long").alias("round_id")), decisions)
    return out.fillna({"defeated_round": -1, "defeated_accuracy": -1.0})


@_query
def ancestor_walk(spark, sf):
    n, r = _table(spark, sf, "nation"), _table(spark, sf, "region")
    leaf = n.select(F.concat(F.lit("r"), "n_regionkey").alias("from_node_id"), F.concat(F.lit("n"), "n_nationkey").alias("to_node_id"), F.col("n_nationkey").cast("long").alias("seq"))
    top = r.select(F.lit("root").alias("from_node_id"), F.concat(F.lit("r"), "r_regionkey").alias("to_node_id"), (F.col("r_regionkey") + 100).cast("long").alias("seq"))
    return search_graph.ancestors(leaf.unionByName(top), "n7")


@_query
def bundle_manifest(spark, sf):
    rows = _stratified(spark, sf).withColumnRenamed("lang", "difficulty")
    return bundles.manifest(rows, "difficulty", "module")


@_query
def data_pressure(spark, sf):
    rows = _stratified(spark, sf).withColumn("difficulty", F.when(F.col("lang") == "en", "hard").otherwise("easy"))
    return bundles.pressure(rows)


@_query
def question_bank(spark, sf):
    rows = _questions(spark, sf).withColumnRenamed("question", "question_text")
    return files.bank(rows, "seq", 700).groupBy("role").agg(F.count("*").alias("n"))


@_query
def eval_prompts(spark, sf):
    rows = _table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "  ").otherwise(F.col("c_name")).alias("input"), F.col("c_mktsegment").alias("question_text"), F.when(F.col("c_custkey") % 3 == 0, "x").alias("gold_answer"))
    return files.prompts(rows, ["input", "question_text"], ["gold_answer"]).select("c_custkey", "prompt", "gold")


@_query
def content_queries(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", T.content_words(F.col("text"))).alias("query"))


@_query
def question_ids(spark, sf):
    return _table(spark, sf, "pages").select("page_id", T.question_id(F.col("url"), F.col("page_id").cast("string")).alias("question_id"))


@_query
def dominant_lang(spark, sf):
    return dedup.mode_first_seen(_table(spark, sf, "documents"), ["source"], "lang", "doc_id")


@_query
def ids_by_dataset(spark, sf):
    rows = dedup.ids_by_group(_table(spark, sf, "events"), "event_type", "user_id", "event_id")
    return rows.select("event_type", F.size("ids").cast("long").alias("n"), F.md5(F.concat_ws(",", "ids")).alias("ids_md5"))


@_query
def champion_vs_candidate(spark, sf):
    rows = _table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("a"), F.col("o_orderpriority").startswith("1").alias("b"))
    out = evaluation.side_by_side(rows.withColumnRenamed("a", "correct"), rows.withColumnRenamed("b", "correct"), ["o_orderkey"])
    return out.agg(F.count("*").alias("n"), F.count_if("gained").alias("gained"), F.count_if("lost").alias("lost"))


def _branches(spark, sf):
    """Orders as branches; effects from their amounts."""
    part = lambda m: (F.col("o_orderkey") % m) / m - 0.5
    decision = F.element_at(F.array(*[F.lit(d) for d in decisions.DECISIONS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return _table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("action_key"), decision.alias("decision"),
        (F.col("o_totalprice") / 1e6).alias("reward"), part(7).alias("forget_recovery"), part(11).alias("forgetting_recovery"),
        part(13).alias("probe"), part(17).alias("new_skill"), part(19).alias("cotest"),
    )


@_query
def dag_branch_scores(spark, sf):
    return decisions.rank_branches(_branches(spark, sf), "low_probe", 25).select("seq", F.round("score", 9).alias("score"))


@_query
def action_evidence(spark, sf):
    out = decisions.action_evidence(_branches(spark, sf), "high_forgetting")
    return out.select("action_key", "support", "failures", F.round("evidence", 6).alias("evidence"))


@_query
def dag_situations(spark, sf):
    rows = _rounds(spark, sf).select(
        "round_id", (F.col("round_id") % 5).alias("rollback_streak"), F.lit("promote").alias("previous_decision"), "forgetting",
        F.col("probe_acc").alias("probe"), F.col("new_after").alias("new_skill"), F.col("cotest_after").alias("cotest"),
    )
    return decisions.situation(rows).select("round_id", "situation")


@_query
def gate_adjustments(spark, sf):
    rows = evaluation.gates(_rounds(spark, sf)).select("round_id", "promote", (F.col("round_id") % 4).alias("rollback_streak"), F.col("probe_acc").alias("mean_acc"))
    return evaluation.gate_adjustment(rows.withColumn("promote", F.lit(True))).drop("promote", "mean_acc")


@_query
def retained_candidates(spark, sf):
    rows = _branches(spark, sf).select(F.col("seq").alias("round_id"), "decision")
    return search_graph.retained(rows, 3).where("keep").select("round_id", "decision")


@_query
def proposal_errors(spark, sf):
    rows = _table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 != 4, F.col("o_orderpriority")).alias("action_key"), F.lit("promote").alias("decision"),
        (F.col("o_orderkey") % 3 / 2.0).cast("string").alias("replay_ratio"), F.when(F.col("o_orderkey") % 2 == 0, "high").alias("confidence"),
    )
    out = decisions.proposal_errors(rows, ["1-URGENT", "2-HIGH"])
    return out.groupBy(F.concat_ws(",", "errors").alias("errors")).agg(F.count("*").alias("n"))


@_query
def worst_questions(spark, sf):
    failed = _table(spark, sf, "events").where("event_type not in ('purchase', 'view')").select(F.col("event_id").alias("seq"), F.col("event_type").alias("difficulty"))
    accuracy = _table(spark, sf, "events").groupBy(F.col("event_type").alias("difficulty")).agg(F.avg("value").alias("accuracy"))
    return decisions.worst_questions(failed, accuracy, 20)


@_query
def hardest_probe(spark, sf):
    return sampling.hardest(_scored(spark, sf), "pass_rate", "question_id", 200).select("question_id", "pass_rate")


@_query
def review_pauses(spark, sf):
    failed = _table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("dataset"), F.col("event_id").cast("double").alias("at"))
    return lifecycle.blocked_until(failed, 600.0, 2)


@_query
def keyed_exclusion(spark, sf):
    rows = _questions(spark, sf).withColumn("key", I.single_key(F.lit(None), F.lit(None), F.col("question"), F.col("question_id")))
    return overlap.without_keys(rows, rows.where("dataset = 'src1'"), "key").select("seq")


@_query
def classified_questions(spark, sf):
    rows = _questions(spark, sf).withColumn("module", F.when(F.col("seq") % 4 == 0, "geometry_measurement"))
    return cleaning.classify(rows, "question").groupBy("module", "confidence").agg(F.count("*").alias("n"))


@_query
def cleaned_rows(spark, sf):
    """The identity cleaner over all questions; the callable runs in Python."""
    rows = _questions(spark, sf).select("seq", F.col("question").alias("question_text"), F.col("answer").alias("gold_answer"))
    return cleaning.accepted(cleaning.clean(rows, "identity")).agg(F.count("*").alias("n"), F.sum("position").alias("positions"))


@_query
def first_wins_documents(spark, sf):
    return dedup.first_wins(_table(spark, sf, "documents").select("doc_id", "text"), [F.md5("text")], "doc_id").select("doc_id")


@_query
def union_new_refs(spark, sf):
    refs = _table(spark, sf, "orders").select("o_custkey", "o_orderpriority").distinct()
    out = dedup.union_new(refs.where("o_orderpriority = '1-URGENT'"), refs, ["o_custkey"])
    return out.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@_query
def verdict_merge(spark, sf):
    old = _table(spark, sf, "customer").select("c_custkey", F.lit("old").alias("verdict"))
    new = _table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("verdict", F.lit("new"))
    return overlap.overwrite_merge(old, new, ["c_custkey"]).groupBy("verdict").agg(F.count("*").alias("n"))


@_query
def config_overrides(spark, sf):
    over = _table(spark, sf, "nation").where("n_nationkey % 3 = 0").select("n_nationkey", F.lit("other").alias("n_name"))
    return overlap.with_overrides(_table(spark, sf, "nation"), over, "n_nationkey")


from . import nested, rounds, states  # noqa: E402, F401  register their queries here
