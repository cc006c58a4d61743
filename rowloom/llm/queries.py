"""Queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ball_kmeans, bpe, decontaminate, lang_id, licenses, near_dedup, packing, pitman_yor, prefix_trie, quality_model, quality_rules, secrets, substring_dedup,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _left_out(of: int, which: int) -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % of == which


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), width=4)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality_model.score_documents(_documents(spark, sf_dir), labels, ~_left_out(5, 0))
    return rows.select(
        "doc_id", _left_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = pitman_yor.fit(docs.where(~_left_out(7, 2)))
    rows = pitman_yor.score(docs, model)
    return rows.select(
        "doc_id", _left_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = secrets.scan_versions(_documents(spark, sf_dir), path_col="doc_id")
    spans = F.col("spans")
    counts = [F.size(secrets.of_kinds(spans, k)).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    base = F.sha2(secrets.joined(secrets.of_kinds(spans, *secrets.BASE_KINDS)), 256)
    return rows.select("doc_id", *counts, base.alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = lang_id.fit(docs.where(~_left_out(4, 2)))
    return lang_id.identify(docs, model).select("doc_id", _left_out(4, 2).alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(_documents(spark, sf_dir)), "v2")
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask(quality_rules.POLICIES["base"]))) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "failed",
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), share=True)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_OP1 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i:i+3], ' ') end as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id),
e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, root) as (
  select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.doc_id),
c as (select doc_id, min(root) as component_id from r group by doc_id)
select c.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, c.doc_id = component_id as kept
from c left join n using (doc_id)
"""

_OP7 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 33)) as i from w where len(w) >= 35),
k as (select doc_id, i, count(*) over (partition by array_to_string(w[i:i+34], ' ')) as n from s),
g as (select distinct doc_id, unnest(range(i, i + 35)) as p from k where n > 1),
gone as (select doc_id, list(p) as p from g group by doc_id),
r as (
  select doc_id, len(w) as n_words, coalesce(len(p), 0) as n_removed,
    list_filter(w, lambda x, j: p is null or not list_contains(p, j)) as kept
  from w left join gone using (doc_id))
select doc_id, n_words::bigint as n_words, n_removed::bigint as n_removed,
  sha256(array_to_string(kept, ' ')) as kept_sha256
from r
"""

_OP10 = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as (
  select doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) as n_letters,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from d),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from m where len(w) > 2),
r as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i+1], w[i+2]) as n from g),
p as (select distinct doc_id, unnest([i, i + 1, i + 2]) as i from r where n > 1),
c as (select doc_id, count(*) as n from p group by doc_id),
a as (
  select m.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, n_symbols, n_letters,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
  from m left join c using (doc_id)),
f as (
  select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
    (case when n_words < 50 then 1 else 0 end)
    + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when 100 * n_symbols > 7 * word_chars then 4 else 0 end)
    + (case when 100 * n_dup_lines > 30 * n_lines and 100 * n_repeat_words > 30 * n_words then 8 else 0 end)
    + (case when word_chars < 2 * n_words then 16 else 0 end)
    + (case when word_chars > 20 * n_words then 32 else 0 end)
    + (case when 100 * n_letters < 60 * word_chars then 64 else 0 end) as failed
  from a)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed, failed = 0 as kept,
  failed::bigint as failed
from f
"""

_OP11 = r"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) as digest, turn
  from conversations where conv_id is not null),
o as (
  select conv_id, {'d': digest, 'n': length(text)} as x,
    row_number() over (partition by conv_id order by turn nulls first, role, digest) as i from t),
c as (select conv_id, list(x order by i) as xs from o group by conv_id),
h as (
  select conv_id, xs, conv_id - conv_id % 100 as giver, xor(list_reduce(
    list_prepend(4294967295::ubigint, list_transform(range(1, length(conv_id::varchar) + 1), lambda k: ascii(substr(conv_id::varchar, k, 1))::ubigint)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda r, z: xor(r >> 1, 3988292384::ubigint * (r & 1)))
  ), 4294967295::ubigint) % 6 as h
  from c),
b as (select h.conv_id, list_concat(coalesce(g.xs[1:h.h::bigint], []), h.xs[h.h::bigint + 1:]) as xs from h left join c g on g.conv_id = h.giver),
m as (
  select conv_id, xs, d, list_transform(xs[1:d], lambda x: x.d) as node, xs[d].n as n
  from (select conv_id, xs, unnest(range(0, len(xs) + 1)) as d from b)),
n as (
  select node, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(any_value(n), 0) as n,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(xs) = d), '') as ends
  from m group by node),
k as (select node[:depth - 1] as node, count(*) as n_children from n where depth > 0 group by 1),
a as (select conv_id, depth, (n_convs - 1) * n as saved, n.node, n_children from n left join k on k.node = n.node),
u as (select node[:d] as node, saved, n_children from (select *, unnest(range(0, depth + 1)) as d from a)),
s as (select node, sum(saved) as saved, count(*) filter (where n_children is null) as leaves from u group by node)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs,
  coalesce(k.n_children, 0)::bigint as n_children, s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens,
  sha256(n.ends) as ends_sha256
from n join s on s.node = n.node left join k on k.node = n.node left join n p on n.depth > 0 and p.node = n.node[:n.depth - 1]
"""


def _op13(rounds: int = 5) -> str:
    """k-means, round by round."""
    near = """
a{t} as materialized (
  select r, arg_min(j, (d, j)) as j, min(d) as d from (
    select v.r, c.j, sum((v.x - c.x) * (v.x - c.x)) as d from v join c{t} c on c.i = v.i group by v.r, c.j) group by r)"""
    mean = """
m{t} as (select a.j, v.i, floor(sum(v.x)::double / count(*))::bigint as x from a{t} a join v using (r) group by a.j, v.i),
c{u} as materialized (select c.j, c.i, coalesce(m.x, c.x) as x from c{t} c left join m{t} m on m.j = c.j and m.i = c.i)"""
    steps = ",".join((near + "," + mean).format(t=t, u=t + 1) for t in range(rounds)) + "," + near.format(t=rounds)
    return f"""
with e as (
  select row_number() over () as r, vec_id, embedding::double[] as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (
  select r, i, floor(256 * x[i])::bigint as x from (select r, x, unnest(range(1, 65)) as i from e)),
f as (
  select r, row_number() over (order by sha256('2:' || vec_id), x) - 1 as j from e where vec_id is not null
  qualify row_number() over (order by sha256('2:' || vec_id), x) <= 40),
c0 as materialized (select f.j, v.i, v.x from f join v using (r)),{steps},
k as (select j, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by j),
s as (select j, sum(d) as d from a{rounds} group by j)
select e.vec_id, a.j::integer as cluster, a.d::bigint as distance, s.d::bigint as cluster_inertia,
  (select sum(d) from a{rounds})::bigint as inertia, k.centroid_sha256
from a{rounds} a join e using (r) join k using (j) join s using (j)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_licenses": op2_licenses,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_model": op4_quality_model,
    "op5_lm_score": op5_lm_score,
    "op6_secrets": op6_secrets,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_bpe": op9_bpe,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_packing": op12_packing,
    "op13_ball_kmeans": op13_ball_kmeans,
}
ORACLE: dict[str, str] = {"op1_near_dedup": _OP1, "op7_substring_dedup": _OP7, "op10_quality_rules": _OP10, "op11_prefix_trie": _OP11, "op13_ball_kmeans": _op13()}
