"""Queries of item and registry states and of evaluation sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decisions, dedup, lifecycle, overlap, rollouts, search_graph, splits
from .queries import _query, _table

ORACLE: dict[str, str] = {}
_STATE = "case o_custkey % 4 when 0 then 'unused' when 1 then 'reserved' when 2 then 'used' else 'defeated' end"


def _items(spark, sf):
    """Orders as items of their priority's dataset."""
    return _table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").alias("question_id"), F.expr(_STATE).alias("state"),
        (F.col("o_custkey") % 10 / 10).alias("pass_rate"), (F.col("o_custkey") % 3).alias("rollout_count"), (F.col("o_custkey") % 7 / 10).alias("defeated_accuracy"),
    )


@_query
def updated_rates(spark, sf):
    """Each line of an order is an update of its item's rate; the last line counts."""
    lines = _table(spark, sf, "lineitem").join(_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("dataset")), "l_orderkey")
    seq = F.struct("l_linenumber", "l_extendedprice")
    updates = lines.where("l_quantity < 10").select("dataset", F.col("l_orderkey").alias("question_id"), seq.alias("seq"), (F.col("l_quantity") / 10).alias("pass_rate"), F.col("l_linenumber").cast("long").alias("rollout_count"))
    return lifecycle.upsert(_items(spark, sf), updates, "seq", ["pass_rate", "rollout_count"]).select("question_id", "pass_rate", "rollout_count")


ORACLE["updated_rates"] = """with u as (select l_orderkey as k, arg_max(l_quantity / 10, (l_linenumber, l_extendedprice)) as p, arg_max(l_linenumber, (l_linenumber, l_extendedprice)) as c from lineitem where l_quantity < 10 group by 1)
select o_orderkey as question_id, coalesce(p, o_custkey % 10 / 10) as pass_rate, coalesce(c, o_custkey % 3)::bigint as rollout_count from orders left join u on k = o_orderkey"""


@_query
def revived_items(spark, sf):
    """Defeated items come back where accuracy, by priority, rose by a twentieth; unused ones lose their rates."""
    items = lifecycle.revived(_items(spark, sf), F.expr("case when dataset like '1%' then 0.3 else 0.6 end"))
    return lifecycle.reset_labels(items).select("question_id", "state", "pass_rate", "rollout_count")


ORACLE["revived_items"] = f"""with i as (select o_orderkey as question_id, {_STATE} as s, o_custkey % 10 / 10 as p, o_custkey % 3 as c, case when o_orderpriority like '1%' then 0.3::double else 0.6 end - o_custkey % 7 / 10 as rise from orders),
r as (select *, case when s = 'defeated' and rise >= 0.05::double then 'unused' else s end as state from i)
select question_id, state, case when state = 'unused' and c > 0 then 0 else p end as pass_rate, case when state = 'unused' then 0 else c end as rollout_count from r"""


@_query
def exhausted_sets(spark, sf):
    """Customers' question sets with fewer than two unused items."""
    items = _items(spark, sf).join(_table(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("c")), "question_id").withColumn("dataset", F.col("c") % 97)
    return lifecycle.exhausted(items.withColumn("state", F.when(F.col("question_id") % 5 == 0, F.col("state")).otherwise("used")), 12)


ORACLE["exhausted_sets"] = f"""with i as (select o_custkey % 97 as dataset, case when o_orderkey % 5 = 0 then {_STATE} else 'used' end as s from orders)
select dataset, count(*) filter (where s = 'unused') as unused from i group by 1 having count(*) filter (where s = 'unused') < 12"""


@_query
def stale_labels(spark, sf):
    """Items whose labels are due again, by gain or by age."""
    due = decisions.needs_rerollout(F.lit(0.55), F.col("pass_rate"), F.col("rollout_count"), 0.3, 2)
    return _items(spark, sf).where(due).select("question_id")


ORACLE["stale_labels"] = "select o_orderkey as question_id from orders where 0.55::double - o_custkey % 10 / 10 >= 0.3::double or o_custkey % 3 >= 2"


@_query
def registry_appended(spark, sf):
    """The registry of old orders after the events of late ones."""
    o = _table(spark, sf, "orders")
    status = F.element_at(F.array(*[F.lit(s) for s in ("external_probe", "probe_holdout", "active_holdout", "retired_holdout", "train_seen")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    events = o.select(F.col("o_orderkey").alias("seq"), *[F.lit(None).cast("string").alias(c) for c in dedup.REGISTRY_KEY[:4]], F.col("o_custkey").cast("string").alias("question_id"), F.lit("").alias("text_hash"), status.alias("status"), (F.year("o_orderdate") >= 1997).alias("late"))
    out = dedup.registry_append(events.where("not late").drop("late"), events.where("late").drop("late"))
    return out.groupBy("status").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


ORACLE["registry_appended"] = """with e as (select *, ['external_probe', 'probe_holdout', 'active_holdout', 'retired_holdout', 'train_seen'][o_orderkey % 5 + 1] as status from orders),
s as (select * from e qualify row_number() over (partition by o_custkey order by o_orderkey % 5, o_orderkey desc) = 1)
select status, count(*) as n, sum(o_orderkey)::bigint as seqs from s group by 1"""


@_query
def frozen_sample(spark, sf):
    """A stable holdout of 100 documents."""
    return splits.frozen_holdout(_table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


ORACLE["frozen_sample"] = "select doc_id from documents where (select count(*) from documents) > 100 order by md5('frozen:' || doc_id) limit 100"


@_query
def worker_shards(spark, sf):
    """Documents dealt to six workers in runs."""
    return rollouts.shard(_table(spark, sf, "documents").select("doc_id"), "doc_id", 6)


ORACLE["worker_shards"] = "select doc_id, ((row_number() over (order by doc_id) - 1) * 6 // (select count(*) from documents))::bigint as shard from documents"


@_query
def unused_and_rolled_out(spark, sf):
    """Documents whose item, the order of their number, is unused and rolled out."""
    items = _items(spark, sf).withColumn("question_id", F.concat(F.lit("doc_"), "question_id")).withColumn("dataset", F.lit("d"))
    docs = _table(spark, sf, "documents").select(F.lit("d").alias("dataset"), F.concat(F.lit("doc_"), "doc_id").alias("question_id"), "doc_id")
    return overlap.unused_only(docs, items, rolled_out=True).select("doc_id")


ORACLE["unused_and_rolled_out"] = "select doc_id from documents join orders on o_orderkey = doc_id where o_custkey % 4 = 0 and o_custkey % 3 > 0"


@_query
def old_set_error(spark, sf):
    """Errors on the first 50 users seen, who are right with two purchases."""
    e = _table(spark, sf, "events")
    users = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    verdicts = e.groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") > 1).alias("correct"))
    return decisions.set_error(users, verdicts, "user_id", "first")


ORACLE["old_set_error"] = """with u as (select user_id, min(event_id) as f, count(*) filter (where event_type = 'purchase') > 1 as ok from events group by 1 order by f limit 50)
select count(*) filter (where not ok) as errors, count(*) filter (where not ok) / count(*) as error_rate, count(*) as n from u"""


def _experiments(spark, sf):
    k = F.col("o_orderkey")
    return _table(spark, sf, "orders").select(k.alias("seq"), F.when(k % 11 > 0, k % 40).alias("round_id"), F.when(k % 9 > 0, F.col("o_orderpriority")).alias("action_key"), (F.col("o_totalprice") / 1e6).alias("reward"), (F.col("o_custkey") % 10 / 10).alias("forgetting"))


@_query
def edges_of_last_rounds(spark, sf):
    """The 25 latest experiments."""
    return search_graph.recent_edges(_experiments(spark, sf), 25).select("seq", "round_id")


ORACLE["edges_of_last_rounds"] = "select o_orderkey as seq, case when o_orderkey % 11 > 0 then o_orderkey % 40 end as round_id from orders order by coalesce(round_id, -1) desc, seq desc limit 25"


@_query
def action_edge_summary(spark, sf):
    """What each action's experiments gave, and how many forgot."""
    out = search_graph.edge_summary(_experiments(spark, sf))
    return out.withColumns({"mean_reward": F.round("mean_reward", 6), "best_reward": F.round("best_reward", 6)})


ORACLE["action_edge_summary"] = """select o_orderpriority as action_key, count(*) as edges, round(avg(o_totalprice / 1e6), 6) as mean_reward, round(max(o_totalprice / 1e6), 6) as best_reward,
  max(case when o_orderkey % 11 > 0 then o_orderkey % 40 end) as last_round, count(*) filter (where o_custkey % 10 / 10 > 0.5::double) as forgot from orders where o_orderkey % 9 > 0 group by 1"""


@_query
def focus_modules(spark, sf):
    """Modules of documents of low quality, as failures."""
    failed = _table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return decisions.focus_counts(_table(spark, sf, "documents").join(failed, "doc_id").select(T.module_of(F.col("text")).alias("module")))


def module_sql(module: str) -> dict[str, str]:
    return {"focus_modules": f"select module, count(*) as n from (select {module} as module from documents join labels using (doc_id) where quality = 0) where module <> 'unknown' group by 1"}
