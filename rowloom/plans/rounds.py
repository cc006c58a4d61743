"""Queries of search rounds and their samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversations, dedup, normalize, quotas, sampling, search_graph, surrogate
from ..sources import catalog, windows
from .queries import _query, _table

ORACLE: dict[str, str] = {}


@_query
def keyset_dedup(spark, sf):
    """Parts are the same by brand and size, or by name and half size."""
    keys = F.array(F.concat_ws("/", "p_brand", "p_size"), F.concat_ws("/", "p_name", F.floor(F.col("p_size") / 2)))
    return dedup.first_by_any_key(_table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), keys.alias("keys")), "keys", "seq").select("seq")


ORACLE["keyset_dedup"] = """with recursive p as (
  select p_partkey as seq, row_number() over (order by p_partkey) as i, [p_brand || '/' || p_size, p_name || '/' || p_size // 2] as keys from part),
r(i, seen, seq) as (
  select 0::bigint, []::varchar[], null::bigint
  union all
  select p.i, case when list_has_any(r.seen, p.keys) then r.seen else list_concat(r.seen, p.keys) end, case when not list_has_any(r.seen, p.keys) then p.seq end
  from r join p on p.i = r.i + 1)
select seq from r where seq is not null"""


@_query
def backpropagated_orders(spark, sf):
    """Orders are rounds of a deep tree; finished ones have a reward. Each child has an older, wrong edge, too."""
    o, k = _table(spark, sf, "orders"), F.col("o_orderkey")
    up = F.when(k % 5 == 0, F.floor(k / 2)).otherwise(k - 1)
    edges = o.where("o_orderkey > 0").select(up.alias("from_node_id"), k.alias("to_node_id"), F.lit(2).alias("seq"))
    edges = edges.unionByName(o.select(F.col("o_custkey").alias("from_node_id"), k.alias("to_node_id"), F.lit(1).alias("seq")).where("to_node_id > 0"))
    nodes = o.select(k.alias("node_id"), (F.col("o_custkey") % 3).alias("visit_count"), (F.col("o_totalprice") / 1e6).alias("value_estimate"))
    rewards = o.where("o_orderstatus = 'F'").select(k.alias("node_id"), (F.col("o_totalprice") / 1e5).alias("reward"))
    return search_graph.backpropagated(nodes, edges, rewards).select("node_id", "visit_count", F.round(F.col("value_estimate") * 1.2345678912345, 6).alias("scaled_value"))


ORACLE["backpropagated_orders"] = """with recursive e as (
  select o_orderkey as k, case when o_orderkey = 0 then null when o_orderkey % 5 = 0 then o_orderkey // 2 else o_orderkey - 1 end as up from orders),
w(node, reward) as (
  select o_orderkey, o_totalprice / 1e5 from orders where o_orderstatus = 'F'
  union all select e.up, w.reward from w join e on e.k = w.node where e.up is not null),
s as (select node, sum(reward) as s, count(*) as c from w group by node)
select o_orderkey as node_id, o_custkey % 3 + coalesce(c, 0) as visit_count,
  round(case when c is null then o_totalprice / 1e6 else (o_totalprice / 1e6 * (o_custkey % 3) + s) / (o_custkey % 3 + c) end * 1.2345678912345, 6) as scaled_value
from orders left join s on node = o_orderkey"""


def _nodes(spark, sf):
    return _table(spark, sf, "customer").select(
        F.col("c_custkey").alias("position"), F.concat(F.lit("n"), "c_custkey").alias("node_id"), F.col("c_nationkey").alias("visit_count"),
        (F.col("c_acctbal") / 1e4).alias("value_estimate"), "c_mktsegment", "c_nationkey",
    )


@_query
def next_parents(spark, sf):
    """The parent among all nodes, among the tried ones of a segment, and where no candidate is known."""
    nodes = _nodes(spark, sf)
    some = nodes.where("c_mktsegment = 'BUILDING' and c_nationkey > 0").select("node_id")
    none = nodes.select(F.concat(F.lit("x"), "node_id").alias("node_id"))
    picks = [search_graph.next_parent(nodes, c, "root").withColumn("among", F.lit(n)) for n, c in (("all", None), ("some", some), ("none", none))]
    empty = search_graph.next_parent(nodes.where("position < 0"), None, "root").withColumn("among", F.lit("no node"))
    return picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(empty)


ORACLE["next_parents"] = """with n as (select c_custkey as p, 'n' || c_custkey as node_id, c_nationkey as v, c_acctbal / 1e4 as x, c_mktsegment = 'BUILDING' and c_nationkey > 0 as ok from customer),
a as (select node_id from n order by v <> 0, case when v <> 0 then -x end, p limit 1)
select 'all' as among, node_id from a union all select 'none', node_id from a
union all (select 'some', node_id from n where ok order by -x, p limit 1) union all select 'no node', 'root'"""


def _space(spark, sf):
    key = F.concat(F.lit("a"), "n_nationkey")
    templates = _table(spark, sf, "nation").select(
        key.alias("action_key"), F.col("n_nationkey").alias("position"), ((F.col("n_nationkey") + 1) * 1e-6).alias("learning_rate"),
        (F.col("n_regionkey") / 5).alias("replay_sample_ratio"), (1.0 + F.col("n_nationkey") % 4).alias("num_train_epochs"),
    )
    s = F.col("s_suppkey")
    samples = _table(spark, sf, "supplier").select(
        s.alias("seq"), F.concat(F.lit("a"), "s_nationkey").alias("action_key"), ((1 + s % 37) * 0.7e-6).alias("learning_rate"),
        (s % 11 / 10).alias("replay_sample_ratio"), (1 + s % 7 * 0.5).alias("num_train_epochs"), (F.col("s_acctbal") / 1e4).alias("reward"),
    )
    return templates, samples


def _axes():
    return [F.round(a.name, a.digits).alias(a.name) for a in surrogate.AXES]


@_query
def continuous_candidates(spark, sf):
    """Distinct candidates of the fourth round."""
    found = surrogate.candidates(*_space(spark, sf), default="a0", round_id=3)
    return found.select("action_key", *_axes(), "generation", *[F.round(f"s_{a.name}", 6).alias(f"s_{a.name}") for a in surrogate.AXES])


@_query
def continuous_choice(spark, sf):
    """The five best candidates by all samples, with evidence for actions."""
    templates, samples = _space(spark, sf)
    evidence = templates.select("action_key", (F.col("position") % 5 / 100).alias("evidence"))
    best = surrogate.chosen(templates, samples, "a0", 3, evidence)
    return best.select("place", "action_key", *_axes(), "generation", *[F.round(c, 6).alias(c) for c in ("support", "expected", "bonus", "cost", "score")], "selected")


_HALTON = "list_sum(list_transform(range(0, 7), lambda d: (i + 3) // ({b} ** d)::bigint % {b} / ({b}::double ** (d + 1))))"
_CANDIDATES = f"""t as (select 'a' || n_nationkey as k, n_nationkey as pos, (n_nationkey + 1) * 1e-6::double as lr, n_regionkey / 5 as rp, 1.0::double + n_nationkey % 4 as ep from nation),
b as (select min(lr) as l0, max(lr) as l1, min(rp) as r0, max(rp) as r1, min(ep) as e0, max(ep) as e1 from t),
sm as (select s_suppkey as seq, 'a' || s_nationkey as k, (1 + s_suppkey % 37) * 0.7e-6::double as lr, least(1, s_suppkey % 11 / 10) as rp, 1 + s_suppkey % 7 * 0.5::double as ep, s_acctbal / 1e4 as reward from supplier),
top as (select *, row_number() over (order by reward desc, seq) as rk from sm qualify rk <= 5),
ch(i, g, f, r, e) as (values (0, 'history_exact', 1::double, 0::double, 0::double), (1, 'history_lr_down', 0.9, 0, 0), (2, 'history_lr_up', 1.1, 0, 0),
  (3, 'history_replay_up', 1, 0.05, 0), (4, 'history_replay_down', 1, -0.05, 0), (5, 'history_epochs_up', 1, 0, 0.25), (6, 'history_epochs_down', 1, 0, -0.25)),
c as (
  select 0 as tier, pos as place, k, lr, rp, ep, 'template_anchor' as g from t
  union all select 1, rk * 7 + i, null, lr * f, rp + r, ep + e, g from top, ch
  union all select 2, i, null, exp(ln(l0) + {_HALTON.format(b=2)} * (ln(l1) - ln(l0))), r0 + {_HALTON.format(b=3)} * (r1 - r0), e0 + {_HALTON.format(b=5)} * (e1 - e0), 'halton'
    from (select unnest(range(1, 33)) as i), b),
h as (select tier, place, k, least(l1, greatest(l0, lr)) as lr, least(r1, greatest(r0, rp)) as rp, least(e1, greatest(e0, ep)) as ep, g from c, b),
x as (select h.*, (ln(lr) - ln(l0)) / (ln(l1) - ln(l0)) as x, (rp - r0) / (r1 - r0) as y, (ep - e0) / (e1 - e0) as z from h, b),
tx as (select k, pos, (ln(lr) - ln(l0)) / (ln(l1) - ln(l0)) as x, (rp - r0) / (r1 - r0) as y, (ep - e0) / (e1 - e0) as z from t, b),
nk as (select x.tier, x.place, arg_min(tx.k, ((x.x - tx.x) ** 2 + (x.y - tx.y) ** 2 + (x.z - tx.z) ** 2, tx.pos)) as near from x, tx group by 1, 2),
u as (select coalesce(k, near) as k, lr, rp, ep, g, x, y, z, row_number() over (order by tier, place) as id from x join nk using (tier, place)
  qualify row_number() over (partition by coalesce(k, near), round(lr, 12), round(rp, 6), round(ep, 6) order by tier, place) = 1)"""
_SHOWN = "k as action_key, round(lr, 12) as learning_rate, round(rp, 6) as replay_sample_ratio, round(ep, 6) as num_train_epochs, g as generation"
ORACLE["continuous_candidates"] = f"""with {_CANDIDATES}
select {_SHOWN}, round(x, 6) as s_learning_rate, round(y, 6) as s_replay_sample_ratio, round(z, 6) as s_num_train_epochs from u"""
ORACLE["continuous_choice"] = f"""with {_CANDIDATES},
sx as (select reward, greatest(0, least(1, (ln(lr) - ln(l0)) / (ln(l1) - ln(l0)))) as x, greatest(0, least(1, (rp - r0) / (r1 - r0))) as y, greatest(0, least(1, (ep - e0) / (e1 - e0))) as z from sm, b),
d as (select u.id, reward, (u.x - sx.x) ** 2 + (u.y - sx.y) ** 2 + (u.z - sx.z) ** 2 as d from u, sx),
s as (select id, sum(exp(-d / (2 * 0.35 * 0.35))) as w, sum(exp(-d / (2 * 0.35 * 0.35)) * reward) as r, max(reward - 0.25 * sqrt(d)) as near, count(*) as n from d group by id),
v as (select u.*, w, greatest(case when w > 1e-12 then r / w else 0 end, near, 0) as expected, 0.15 * sqrt(ln(n + 2) / (w + 1)) as bonus, 0.02 * z as cost, pos % 5 / 100 as evidence
  from u join s using (id) join t on t.k = u.k),
p as (select *, expected + bonus + evidence - cost as score, row_number() over (order by expected + bonus + evidence - cost desc, id) as place from v)
select place::integer as place, {_SHOWN.replace("lr,", "p.lr,").replace("rp,", "p.rp,").replace("ep,", "p.ep,")}, round(w, 6) as support, round(expected, 6) as expected, round(bonus, 6) as bonus, round(cost, 6) as cost, round(score, 6) as score, place = 1 as selected
from p where place <= 5"""


def _capped_sql(groups: str, key: str, within: str) -> str:
    """Quotas of table ``groups`` (within, key, weight, available, total) by going round the keys one at a time, as ``quota``."""
    by = f"partition by {within}" if within else ""
    cols = f"{within}, {key}" if within else key
    return f"""(with s as (select *, case when weight > 0 and available > 0 then total * weight / sum(case when weight > 0 and available > 0 then weight else 0 end) over ({by}) else 0 end as exact from {groups}),
  f as (select *, least(available, floor(exact))::bigint as base from s),
  l as (select *, case when exact > 0 then available - base else 0 end as room, total - sum(base) over ({by}) as lft from f),
  g as (select {cols}, lft, row_number() over ({by} order by r, exact - floor(exact) desc, {key}) as turn from (select *, unnest(range(0, room)) as r from l)),
  m as (select {cols}, count(*) as more from g where turn <= lft group by {cols})
  select l.*, base + coalesce(more, 0) as quota from l left join m using ({cols}))"""


@_query
def quotas_within_supply(spark, sf):
    """Three fifths of each source's documents, shared out to languages by characters, no more than there are."""
    groups = _table(spark, sf, "documents").groupBy("source", "lang").agg(F.sum("n_chars").cast("double").alias("weight"), F.count("*").alias("available"))
    total = _table(spark, sf, "documents").groupBy("source").agg(F.floor(F.count("*") * 3 / 5).alias("total"))
    return quotas.capped_table(groups.join(total, "source"), "total", "lang", ["source"]).select("source", "lang", "quota")


ORACLE["quotas_within_supply"] = f"""with a as (select source, lang, sum(n_chars)::double as weight, count(*) as available from documents group by 1, 2),
t as (select source, count(*) * 3 // 5 as total from documents group by 1), g as (select * from a join t using (source))
select source, lang, quota from {_capped_sql("g", "lang", "source")}"""

_BUCKET = "case lang when 'en' then 'easy' when 'fr' then 'hard' when 'de' then 'medium' else 'other' end"


@_query
def filled_quotas(spark, sf):
    """Sources are tiers; medium wants twice what there is, so easy and hard rows of the first tier fill in."""
    rows = _table(spark, sf, "documents").select("doc_id", F.expr(_BUCKET).alias("bucket"), F.expr("case source when 'src0' then 0 when 'src1' then 1 else 2 end").alias("tier"))
    wanted = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    wanted = wanted.select("bucket", F.expr("case bucket when 'medium' then 2 * n when 'other' then 0 else n div 20 end").cast("long").alias("quota"))
    return sampling.filled(rows, wanted, "bucket", "tier", "doc_id")


ORACLE["filled_quotas"] = f"""with d as (select doc_id, {_BUCKET} as bucket, case source when 'src0' then 0 when 'src1' then 1 else 2 end as tier from documents),
q as (select bucket, case bucket when 'medium' then 2 * count(*) when 'other' then 0 else count(*) // 20 end as quota, count(*) as n from d group by 1),
r as (select *, row_number() over (partition by bucket order by tier, md5('fill:' || doc_id)) as p from d join q using (bucket)),
lack as (select sum(greatest(0, quota - n)) as lack from q),
rest as (select *, row_number() over (partition by bucket order by md5('fill:' || doc_id)) as k from r where p > quota and tier = (select min(tier) from d) and bucket in ('easy', 'hard')),
easy as (select least((select count(*) from rest where bucket = 'easy'), lack * 2 // 3) as easy, lack from lack)
select doc_id, bucket, tier, 'quota' as taken_as from r where p <= quota
union all select doc_id, bucket, tier, 'backfill' from rest, easy where k <= case bucket when 'easy' then easy else lack - easy end"""


def _pool(spark, sf):
    lang = F.expr("case lang when 'en' then 'hard' when 'fr' then 'easy' when 'de' then 'medium' end")
    return _table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("question_id"), F.col("doc_id").alias("seq"), F.md5("text").alias("dedup_key"), lang.alias("difficulty"), T.module_of(F.col("text")).alias("module")
    )


@_query
def round_sample_by_plan(spark, sf):
    """A round of 300: three difficulties by weight, modules by how often they occur, toxic documents mastered before."""
    weights = spark.createDataFrame([("easy", 0.15), ("medium", 0.7), ("hard", 0.15)], "difficulty string, weight double")
    pool = _pool(spark, sf)
    modules = pool.groupBy("module").agg(F.count("*").cast("double").alias("weight"))
    mastered = _table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("question_id"))
    return sampling.round_sample(pool, 300, weights, modules, mastered)


@_query
def round_sample_by_focus(spark, sf):
    """A round of 400 without weights: rows of the modules of failed questions (low quality) first."""
    pool = _pool(spark, sf)
    failed = _table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("question_id"))
    focus = pool.where("difficulty = 'hard'").join(failed, "question_id").select("module")
    return sampling.round_sample(pool, 400, focus=focus)


def round_sql(module: str) -> dict[str, str]:
    """SQL of the two round samples, given that of a text's module."""
    first = f"""a as (select doc_id, text, case lang when 'en' then 'hard' when 'fr' then 'easy' when 'de' then 'medium' else 'unknown' end as difficulty, {module} as module from documents),
o as (select * from a qualify row_number() over (partition by md5(text) order by doc_id) = 1)"""
    plan = f"""with {first}, p as (select * from o where doc_id not in (select doc_id from labels where toxic = 1)),
w(difficulty, weight) as (values ('easy', 0.15::double), ('medium', 0.7), ('hard', 0.15)), mw as (select module, count(*)::double as weight from a group by 1),
bg as (select difficulty, weight, count(*) as available, 300 as total from p join w using (difficulty) group by 1, 2), bq as (select * from {_capped_sql("bg", "difficulty", "")}),
cg as (select p.difficulty, p.module, mw.weight, count(*) as available, bq.quota as total from p join bq using (difficulty) join mw using (module) group by 1, 2, 3, 5), cq as (select * from {_capped_sql("cg", "module", "difficulty")}),
r as (select p.*, row_number() over (partition by difficulty, module order by md5('round:' || doc_id)) as i from p),
n as (select r.*, i <= coalesce(cq.quota, 0) as inside from r left join cq using (difficulty, module)),
k as (select *, row_number() over (partition by difficulty, inside order by md5('round:' || doc_id)) as j, count(*) filter (where inside) over (partition by difficulty) as used from n)
select doc_id::varchar as question_id, difficulty, module, case when inside then 0 when j <= coalesce(quota, 0) - used then 1 else 2 end as tier
from k left join (select difficulty, quota from bq) using (difficulty) order by tier, md5('round:' || doc_id) limit 300"""
    focus = f"""with {first}, f as (select distinct module from a join labels using (doc_id) where quality = 0 and difficulty = 'hard' and module <> 'unknown')
select doc_id::varchar as question_id, difficulty, module, case when module in (select module from f) then 0 else 1 end as tier from o order by tier, md5('round:' || doc_id) limit 400"""
    return {"round_sample_by_plan": plan, "round_sample_by_focus": focus}


@_query
def bucket_oversample(spark, sf):
    """200 documents, seven tenths of them German."""
    rows = _table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.oversampled(rows, "lang", "de", 200, "doc_id")


ORACLE["bucket_oversample"] = """with d as (select doc_id, lang, coalesce(lang = 'de', false) as own, row_number() over (partition by coalesce(lang = 'de', false) order by md5('bucket:' || doc_id)) as p from documents),
a as (select count(*) as n from d where own and p <= 140)
select doc_id, lang from d, a where p <= case when own then 140 else 200 - n end"""


@_query
def raw_window_accepted(spark, sf):
    """From raw row 150 on, the first 400 documents of more than 300 characters that are not French."""
    rows, facts = windows.raw_window(spark, f"{sf}/documents.parquet", 150, 400, (F.col("lang") != "fr") & (F.col("n_chars") > 300))
    return rows.select("position", "doc_id", F.lit(facts["processed"]).cast("long").alias("processed"), F.lit(facts["exhausted"]).alias("exhausted"))


ORACLE["raw_window_accepted"] = """with d as (select doc_id, lang, n_chars, row_number() over (order by doc_id) - 1 as position from documents),
a as (select *, row_number() over (order by position) as k from d where position >= 150 and lang <> 'fr' and n_chars > 300),
e as (select count(*) < 400 as exhausted, case when count(*) < 400 then (select count(*) from d) else max(position) filter (where k = 400) + 1 end as stop from a)
select position, doc_id, stop - 150 as processed, exhausted from a, e where k <= 400"""


@_query
def catalog_search(spark, sf):
    """Parts by name, type and brand; each brand asks for its first part, every other one with a word that no part has."""
    p = _table(spark, sf, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    text = F.concat_ws(" ", "p_name", "p_type")
    first = p.groupBy("p_brand").agg(F.min_by(F.concat_ws(" ", "p_name", F.lower("p_type")), "p_partkey").alias("q"))
    asked = first.select(F.col("p_brand").alias("query_id"), F.concat("q", F.when(brand % 2 == 0, " missing").otherwise("")).alias("query"))
    entries = p.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_partkey").alias("position"), text.alias("text"))
    return catalog.search(entries, asked, 12)


_STOP = "'a', 'an', 'the', 'and', 'or', 'of', 'in', 'to', 'for', 'with', 'is', 'on', 'at', 'by'"
ORACLE["catalog_search"] = f"""with f as (select p_brand, arg_min(p_name || ' ' || lower(p_type), p_partkey) as q from part group by 1),
q as (select p_brand as query_id, q || case when regexp_extract(p_brand, '(\\d+)', 1)::int % 2 = 0 then ' missing' else '' end as query from f),
k as (select *, list_filter(string_split_regex(lower(trim(query)), '\\s+'), lambda t: t <> '' and t not in ({_STOP}) and length(t) > 1) as w from q),
v as (select query_id, list_concat([query], case when len(w) >= 2 then [array_to_string(w, ' ')] else [] end,
  case when len(w) >= 3 then [array_to_string(w[1:2], ' '), array_to_string(w[-2:], ' ')] else [] end) as vs from k),
u as (select query_id, i - 1 as variant, vs[i] as query from (select query_id, vs, unnest(range(1, len(vs) + 1)) as i from v) where list_position(vs, vs[i]) = i),
e as (select p_partkey as position, string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+') as words from part),
r as (select query_id, dense_rank() over (partition by query_id order by variant) - 1 as variant, query from u),
h as (select query_id, variant, position, row_number() over (partition by query_id, variant order by position) as p
  from r join e on list_has_all(e.words, list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda x: x <> ''))),
m as (select * from h where p <= case when variant = 0 then 12 else 6 end),
c as (select query_id, variant, coalesce(sum(count(*)) over (partition by query_id order by variant rows between unbounded preceding and 1 preceding), 0) as before,
  min(variant) over (partition by query_id) as least from m group by query_id, variant),
o as (select query_id, position, min(variant) as variant from m join c using (query_id, variant) where before < 12 and (least > 0 or variant = 0) group by 1, 2),
z as (select *, row_number() over (partition by query_id order by variant, position) as place from o)
select query_id, position::varchar as name, variant::integer as variant, place::integer as place from z where place <= 12"""


@_query
def repaired_conversations(spark, sf):
    """Conversations as JSON, inside an object, as transcripts and as two columns become the same rows."""
    c, q, a = F.col("conv_id"), F.col("question"), F.col("answer")
    turns = lambda r, t: F.to_json(F.array(F.struct(F.lit("system").alias(r), F.lit("rules").alias(t)), F.struct(F.lit("User").alias(r), q.alias(t)), F.struct(F.lit("assistant").alias(r), a.alias(t))))
    messages = F.when(c % 4 == 0, turns("role", "content")).when(c % 4 == 1, F.concat(F.lit('{"id": 1, "conversations": '), turns("from", "value"), F.lit("}")))
    spoken = F.concat(F.lit("Preface\nUser: "), q, F.lit("\nGPT : "), a)
    rows = conversations.pairs(_table(spark, sf, "conversations")).select(
        c, messages.alias("messages"), F.when(c % 4 == 2, spoken).alias("note"), F.when(c % 4 == 3, q).alias("ask"), F.when(c % 4 == 3, a).alias("reply")
    )
    out = normalize.canonical(rows, normalize.Fields(question="ask", answer="reply", train="messages"), "chats", "conv_id")
    return out.select("question_id", F.md5("question_text").alias("question_md5"), F.md5("gold_answer").alias("answer_md5"), "evaluation_method")


def pairs_sql(pairs: str) -> dict[str, str]:
    """SQL of the repaired conversations, given that of their pairs (p)."""
    return {"repaired_conversations": f"""with {pairs}
select 'chats_' || conv_id as question_id, md5(question) as question_md5, md5(answer) as answer_md5, 'gold' as evaluation_method from p"""}
