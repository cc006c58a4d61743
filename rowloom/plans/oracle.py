"""The same queries in SQL for DuckDB, written from the definitions."""

from __future__ import annotations

from . import nested, rounds, states

# Fixed values, written out again: a wrong list in the library is no longer right on both sides.
COT_MARKERS = (
    "<think", "</think>", "####", "step by step", "let's solve", "let us solve", "we need", "we have", "therefore", "thus", "so the answer",
    "solution:", "reasoning", "解：", "解析", "因此", "所以",
)
PROOF_MARKERS = (
    "import ", "theorem ", "lemma ", "example ", "begin", "end", ":=", "#eval", "def ", "by ", "qed", "coq", "lean", "isabelle",
)
GENERIC_WORDS = (
    "huggingface", "hugging", "face", "hf", "dataset", "datasets", "data", "search", "training", "train", "task", "tasks", "improve", "enhance",
    "increase", "ability", "abilities", "skill", "skills", "problem", "problems", "solving", "for", "with", "to", "of", "in", "the", "and",
)
DIFFICULTY_WORDS = (
    "easy", "medium", "hard", "difficulty", "difficulties", "beginner", "intermediate", "advanced",
)
MODULES = {
    "ratio_rate": ("per", "each", "every", "rate", "miles per", "km/h", "hour", "minute", "second"),
    "money_cost": ("$", "dollar", "cost", "price", "rent", "paid", "buy", "sold", "profit", "percent off"),
    "counting_combinatorics": ("how many", "ways", "arrangements", "combinations", "permutations"),
    "geometry_measurement": ("area", "perimeter", "rectangle", "triangle", "circle", "radius", "volume", "length", "width", "height"),
    "fraction_percent": ("fraction", "%", "percent", "half", "third", "quarter", "ratio"),
    "work_time": ("finish", "complete", "together", "alone", "work", "days", "hours"),
    "age_numbers": ("older", "younger", "age", "years old", "sum of", "difference"),
}
TRAIN_BLOCKING = (
    "active_holdout", "probe_holdout", "external_probe",
)
TEST_BLOCKING = (
    "active_holdout", "probe_holdout", "external_probe", "retired_holdout", "train_seen",
)
FAILURES = {
    "cuda_oom": "(?i)out of memory",
    'timeout': '(?i)\\btimed out\\b|\\btimeout\\b|time limit exceeded',
    "no_loadable_model": "(?i)no loadable model|no model can be loaded|could not load .*model|cannot load .*model",
    'not_found': '(?i)filenotfounderror|no such file or directory|(?:checkpoint|model|artifact).{0,40}\\bnot found\\b',
}


def _strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def _fuzzy(t: str) -> str:
    spaced = rf"regexp_replace({_strip(f'lower({t})')}, '\s+', ' ', 'g')"
    return rf"regexp_replace({spaced}, '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g')"


def _any(t: str, words) -> str:
    return "(" + " or ".join(f"contains({t}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _hits(t: str, words) -> str:
    return "(" + " + ".join(f"contains({t}, '{w}')::int" for w in words) + ")"


_LAST = "string_split(text, chr(10))[-1]"
_Q = f"q as (select doc_id as seq, 'doc_' || doc_id as question_id, text as question, {_LAST} as answer, source as dataset, lang from documents)"
_EAST = "length(regexp_replace(question, '[^一-鿿぀-ヿ]', '', 'g'))"


def _judged(key: str) -> str:
    return f"""{_Q}, f as (select *, case when length(question) < 100 then 'question_short' when length(question) > 20000 then 'question_long'
  when length(answer) < 2 then 'answer_short' when length(answer) > 2000 then 'answer_long'
  when length(question) = 0 then 'language' end as r from q),
j as (select *, case when r is null and row_number() over (partition by r, {key} order by seq) > 1 then 'duplicate' else r end as reason from f)"""


def _module(t: str) -> str:
    low = f"lower({t})"
    counts = [_hits(low, words) for words in MODULES.values()]
    most = "greatest(" + ", ".join(counts) + ")"
    cases = " ".join(f"when {c} = {most} then '{m}'" for m, c in zip(MODULES, counts, strict=True))
    return rf"case when {most} = 0 then case when regexp_matches({low}, '\d') then 'arithmetic_misc' else 'unknown' end {cases} end"


_PAIRS = f"""t as (select conv_id, turn, lower(role) as r, {_strip("coalesce(text, '')")} as b from conversations),
u as (select * from t where b <> ''),
p as (select conv_id, arg_min(b, turn) filter (r in ('user', 'human', 'prompter', 'question')) as question,
  arg_max(b, turn) filter (r in ('assistant', 'gpt', 'bot', 'model', 'answer')) as answer from u group by conv_id
  having question is not null and answer is not null)"""


def _split(keys: str, rows: str) -> str:
    """Stratified split of ``rows`` (seq and keys) by 0.7, 0.1, 0.1, 0.1; roles numbered in order."""
    roles = ["train", "cotest", "test", "probe"]
    ratio = {"train": 0.7, "cotest": 0.1, "test": 0.1, "probe": 0.1}
    total = f"({ratio['train']!r}::double + {ratio['cotest']!r}::double + {ratio['test']!r}::double + {ratio['probe']!r}::double)"
    longs = " union all ".join(
        f"select {keys}, n, '{r}' as role, {i} as i, n * {ratio[r]!r}::double / {total} as exact from sizes" for i, r in enumerate(roles)
    )
    return f"""sizes as (select {keys}, count(*) as n from {rows} group by {keys}),
ex as ({longs}),
fl as (select *, floor(exact) as f, exact - floor(exact) as frac, case when n >= 4 and floor(exact) = 0 then 1 else floor(exact) end as q from ex),
lf as (select *, n - sum(q) over (partition by {keys}) as lft,
  row_number() over (partition by {keys} order by frac desc, i) as up,
  row_number() over (partition by {keys} order by (q = 0)::int, frac, i) as down from fl),
qt as (select {keys}, i, role, q + case when lft > 0 and up <= lft then 1 when lft < 0 and q > 0 and down <= -lft then -1 else 0 end as quota from lf),
cu as (select *, sum(quota) over (partition by {keys} order by i) as upto, sum(quota) over (partition by {keys} order by i) - quota as frm from qt),
pl as (select *, row_number() over (partition by {keys} order by seq) as place from {rows}),
sp as (select pl.*, cu.role as split from pl join cu using ({keys}) where place > frm and place <= upto)"""


_LM = f"lm as (select doc_id as seq, lang, {_module('text')} as module from documents)"
_TRIES = """tr as (select user_id as question_id, row_number() over (partition by user_id order by ts, event_id) - 1 as rollout_idx,
  event_type in ('purchase', 'view') as correct, event_type from events),
sc as (select question_id, count(*) filter (correct) as pass_count, count(*) as rollout_count,
  count(*) filter (correct) / count(*) as pass_rate, string_agg(correct::int::varchar, '' order by rollout_idx) as flags from tr group by question_id),
ps as (select *, round_even(pass_count * 8 / rollout_count, 0)::int as passes from sc),
di as (select *, case when passes >= 5 then 'easy' when passes >= 2 then 'medium' else 'hard' end as difficulty from ps)"""
_LR = """w as (select source as key, count(distinct lang)::double as weight from documents group by source),
x as (select key, weight * 97 / sum(weight) over () as exact from w),
y as (select key, floor(exact) as f, exact - floor(exact) as frac from x)"""
_PLAN = """w as (select lang, count(distinct source)::double as weight from documents group by lang),
x as (select lang, weight * 90 / sum(weight) over () as exact from w),
y as (select lang, floor(exact) as f, exact - floor(exact) as frac from x),
z as (select lang, (f + case when row_number() over (order by frac desc, lang) <= 90 - sum(f) over () then 1 else 0 end)::bigint as quota from y)"""
_SHORT = f"""{_PLAN},
a as (select lang, count(*) filter (source = 'src1') as s, count(*) filter (source = 'src2') as m from documents group by lang),
sh as (select z.lang, greatest(0, quota - coalesce(s, 0) - coalesce(m, 0)) as shortfall from z left join a using (lang))"""
_ROUNDS = """ro as (select (year(l_shipdate) * 12 + month(l_shipdate))::bigint as round_id,
  avg((l_quantity > 12)::int::double) as probe_acc, avg((l_quantity > 13)::int::double) as champion, avg((l_quantity > 14)::int::double) as base,
  avg((l_discount > 0.05)::int::double) as old_before, avg((l_discount > 0.04)::int::double) as old_after, count(*) as old_count,
  avg((l_tax > 0.04)::int::double) as forgetting, avg((l_tax > 0.05)::int::double) as new_before, avg((l_tax > 0.03)::int::double) as new_after,
  avg((l_linenumber > 3)::int::double) as cotest_before, avg((l_linenumber > 2)::int::double) as cotest_after from lineitem group by 1),
ga as (select *, (1 - probe_acc) - (1 - champion) <= 0.03::double as pass_frozen, old_count < 2 or forgetting <= 0.1::double as pass_old,
  ((1 - champion) - (1 - probe_acc)) + (old_after - old_before) + (new_after - new_before) as total_gain from ro),
gb as (select *, total_gain > 0.1::double as pass_new, probe_acc >= 0.75 as pass_probe from ga),
gc as (select *, pass_frozen and pass_old and pass_new as promote, pass_frozen and pass_old and pass_new and pass_probe as stop from gb)"""
_STATUSES = "['external_probe', 'probe_holdout', 'active_holdout', 'retired_holdout', 'train_seen']"
_REG = f"""rg as (select o_orderkey as seq, case when o_custkey % 3 <> 0 then o_orderpriority else '' end as ds, o_custkey::varchar as row_id,
  'doc_' || o_custkey as question_id, sha256(o_custkey::varchar) as text_hash, {_STATUSES}[o_orderkey % 5 + 1] as status, o_orderkey % 5 as worse from orders)"""


def _blocked(statuses) -> str:
    names = ", ".join(f"'{s}'" for s in statuses)
    own = _strip("text")
    return f"""with {_REG}, bl as (select * from rg where status in ({names})),
d as (select doc_id as seq, 'doc_' || doc_id as question_id, doc_id::varchar as row_id, sha256({own}) as text_hash from documents)
select seq from d where question_id not in (select question_id from bl)
  and row_id not in (select row_id from bl where ds = '1-URGENT')"""


_REPLAY = """rp as (select (l_orderkey * 10 + l_linenumber) * 100000000 + floor(l_extendedprice * 100 + 0.5)::bigint as seq, l_partkey as question_id,
  case when l_quantity < 17 then 'hard' when l_quantity < 34 then 'medium' else 'easy' end as bucket,
  list_filter([l_linenumber % 5, l_suppkey % 7], lambda x: x > 1) as used, l_extendedprice as success from lineitem)"""
_KINDS = "['register', 'reserve', 'use', 'defeat', 'unreserve', 'revive', 'rate']"
_ITEMS = f"""ev as (select event_id as seq, event_type as dataset, user_id as question_id, {_KINDS}[event_id % 7 + 1] as kind,
    row_number() over (partition by event_type, user_id order by event_id) as n from events),
st as (
  select dataset, question_id, n, case when kind = 'register' then 'unused' end as s from ev where n = 1
  union all
  select ev.dataset, ev.question_id, ev.n, case
    when s is null then case when kind = 'register' then 'unused' end
    when kind = 'reserve' and s = 'unused' then 'reserved' when kind = 'unreserve' and s = 'reserved' then 'unused'
    when kind = 'use' and s = 'reserved' then 'used' when kind = 'defeat' and s = 'reserved' then 'defeated'
    when kind = 'revive' and s = 'defeated' then 'unused' else s end
  from st join ev on ev.dataset = st.dataset and ev.question_id = st.question_id and ev.n = st.n + 1),
it as (select dataset, question_id, arg_max(coalesce(s, ''), n) as state from st group by dataset, question_id having arg_max(coalesce(s, ''), n) <> '')"""
_SERIES = """se as (select l_partkey as run, (l_orderkey * 10 + l_linenumber) * 100000000 + floor(l_extendedprice * 100 + 0.5)::bigint as seq, l_orderkey as step, l_extendedprice / 1000 as loss,
  case when l_linenumber % 2 = 0 then l_quantity end as eval_loss, l_tax as learning_rate from lineitem)"""


def _summary(name: str, value: str) -> str:
    return f"""{name}0 as (select run, arg_min({value}, seq) as fst, arg_max({value}, seq) as lst, min(step) filter (true) as _s,
  arg_min(step, seq) as fs, arg_max(step, seq) as ls, min({value}) as mn, max({value}) as mx, stddev_pop({value}) as std, count(*) as cnt
  from se where {value} is not null group by run),
{name} as (select *, case when lst < fst - greatest(abs(fst) * 0.05, 1e-12) then 'falling'
  when lst > fst + greatest(abs(fst) * 0.05, 1e-12) then 'rising' else 'flat' end as trend from {name}0)"""


_SHAPE = """lr as (select run, seq, learning_rate as v, lag(learning_rate) over (partition by run order by seq) as b from se),
sha as (select run, case when bool_or(coalesce(v > b, false)) and bool_or(coalesce(v < b, false)) then 'warmup_then_decay'
  when bool_or(coalesce(v < b, false)) then 'decaying' when bool_or(coalesce(v > b, false)) then 'warming_up' else 'constant' end as shape,
  count(*) as count from lr group by run)"""
_EDGES = """ed as (select o_orderkey as seq, o_custkey as f, o_custkey * 7 % 1013 + 1 as t, o_orderpriority as action_key, o_totalprice / 1e6 as reward from orders)"""
_BODY = _strip("text")
_LOW = f"lower({_BODY})"
_NUM = r"'-?\d+\.?\d*'"


def _phrase(p: str) -> str:
    return rf"nullif(regexp_extract(text, '{p}', 1), '')"


_FAIL = "case " + " ".join(f"when regexp_matches(line, '{p}') then '{k}'" for k, p in FAILURES.items()) + " end"
_GENERIC = ", ".join(f"'{w}'" for w in GENERIC_WORDS)
_DIFF = ", ".join(f"'{w}'" for w in DIFFICULTY_WORDS)

_DEC = "['promote', 'provisional_promote', 'keep_branch', 'prune', 'rollback']"
_BRANCH = f"""br as (select o_orderkey as seq, o_orderpriority as action_key, {_DEC}[o_orderkey % 5 + 1] as decision, o_totalprice / 1e6 as reward,
  o_orderkey % 7 / 7 - 0.5::double as fr, o_orderkey % 11 / 11 - 0.5::double as gr, o_orderkey % 13 / 13 - 0.5::double as pr,
  o_orderkey % 17 / 17 - 0.5::double as ns, o_orderkey % 19 / 19 - 0.5::double as ct from orders),
bn as (select *, case when decision = 'promote' then 0.15::double when decision in ('provisional_promote', 'keep_branch') then 0.08::double else 0 end
  - case when decision = 'rollback' then 0.1::double else 0 end + 0.2::double * reward as bonus from br)"""

ORACLE: dict[str, str] = {
    "filter_reasons": f"with {_judged('md5(question)')} select coalesce(reason, 'kept') as reason, count(*) as n from j group by 1",
    "filter_kept": f"with {_judged('md5(question)')} select seq, dataset from j where reason is null",
    "filter_dedup_question_answer": f"with {_judged('md5(question || chr(10) || answer)')} select coalesce(reason, 'kept') as reason, count(*) as n from j group by 1",
    "filter_dedup_rows": """with f as (select *, case when length(text) < 100 then 'question_short' end as r from documents),
j as (select case when r is null and row_number() over (partition by r, text, lang order by doc_id) > 1 then 'duplicate' else r end as reason from f)
select coalesce(reason, 'kept') as reason, count(*) as n from j group by 1""",
    "flagship_curriculum": f"""with {_judged('md5(question)')}, b as (select distinct {_fuzzy('text')} as t from benchmark where text <> ''),
k as (select seq, dataset, {_module('question')} as module from j where reason is null and {_fuzzy('question')} not in (select t from b)),
{_split('dataset, module', 'k')} select split, module, count(*) as n from sp group by 1, 2""",
    "column_profile_documents": """with n as (select count(*) as n from documents)
select 'doc_id' as column_name, 'number' as kind, null::double as avg_length, round(count(*) filter (doc_id is null) / count(*), 3) as null_share from documents
union all select 'text', 'string', round(avg(length(text)), 1), round(count(*) filter (text is null) / count(*), 3) from documents
union all select 'lang', 'string', round(avg(length(lang)), 1), round(count(*) filter (lang is null) / count(*), 3) from documents
union all select 'source', 'string', round(avg(length(source)), 1), round(count(*) filter (source is null) / count(*), 3) from documents
union all select 'n_chars', 'number', null, round(count(*) filter (n_chars is null) / count(*), 3) from documents""",
    "normalize_text_hash": f"select doc_id, md5({_fuzzy('text')}) as fuzzy_md5, sha256({_BODY}) as text_hash from documents",
    "decontam_exact_clean": f"select doc_id from documents where {_fuzzy('text')} not in (select {_fuzzy('text')} from benchmark where text <> '')",
    "decontam_exact_hits": f"select doc_id from documents where {_fuzzy('text')} in (select {_fuzzy('text')} from documents where lang = 'es' and text <> '')",
    "decontam_ngram_overlap": f"""with b as (select item_id, {_fuzzy('text')} as t from benchmark where text <> ''),
bg as (select distinct item_id, substring(t, i::int, 13) as g from (select item_id, t, unnest(range(1, length(t) - 11)) as i from b where length(t) >= 13)),
d as (select doc_id, {_fuzzy('text')} as t from documents),
dg as (select distinct doc_id, substring(t, i::int, 13) as g from (select doc_id, t, unnest(range(1, length(t) - 11)) as i from d where length(t) >= 13)),
n as (select doc_id, count(*) as n_grams from dg group by doc_id),
k as (select doc_id, item_id, count(*) as k from dg join bg using (g) group by doc_id, item_id),
m as (select doc_id, max(k) as k from k group by doc_id)
select doc_id, coalesce(n_grams, 0)::bigint as n_grams, coalesce(k, 0)::bigint as n_shared,
  coalesce(k / n_grams, 0) >= 0.8 as dropped, coalesce(k / n_grams, 0) >= 0.1 as suspect
from documents left join n using (doc_id) left join m using (doc_id)""",
    "decontam_min_signature": f"""with b as (select item_id, {_fuzzy('text')} as t from benchmark),
g as (select item_id, min(md5(substring(t, i::int, 13))) as signature from (select item_id, t, unnest(range(1, length(t) - 11)) as i from b where length(t) >= 13) group by item_id)
select item_id, signature from benchmark left join g using (item_id)""",
    "module_histogram": f"select {_module('text')} as module, count(*) as n from documents group by 1",
    "conversation_pairs": f"with {_PAIRS} select conv_id, md5(question) as question_md5, md5(answer) as answer_md5 from p",
    "sft_alpaca": f"with {_PAIRS} select conv_id, 'Q: ' || question as instruction, '' as input, answer as output, '' as system from p",
    "sft_sharegpt": f"""with {_PAIRS} select conv_id, 0 as turn, 'human' as who, 'Q: ' || question as value from p
union all select conv_id, 1, 'gpt', answer from p""",
    "sft_raw": f"with {_PAIRS} select conv_id, 'Q: ' || question || chr(10) || answer as text from p",
    "solution_markers": f"""select doc_id, length({_BODY}) >= 600 or {_any(_LOW, COT_MARKERS)} as worked,
  {_hits(_LOW, PROOF_MARKERS)} >= 2 or (contains({_LOW}, 'import ') and {_any(_LOW, ('begin', ':='))}) as proof, c as chat,
  length({_BODY}) > 0 and not regexp_full_match({_BODY}, '[0-9]+') and not c as valid
from (select *, case when {_any(_LOW, ('role', 'from', 'speaker'))} and {_any(_LOW, ('content', 'value', 'text'))}
  then starts_with({_BODY}, '[') or starts_with({_BODY}, '{{')
  else starts_with({_BODY}, '[') and contains({_LOW}, 'user') and contains({_LOW}, 'assistant') end as c from documents)""",
    "target_style": f"""with {_Q}, s as (select {_strip('question')} as o, {_strip('answer')} as g from q)
select case when o = '' or (o = g and length(o) < 500) then 'answer' else 'cot' end as style, count(*) as n from s group by 1""",
    "opaque_ids": r"""select (b = '' or (not regexp_matches(b, '[ \n]') and (regexp_matches(lower(b), '__|round|grade|word_problem|theorem_proving')
  or (length(b) >= 16 and length(regexp_replace(b, '[^_./:-]', '', 'g')) >= 2 and length(regexp_replace(b, '[^\p{L}\p{N}]', '', 'g')) >= 8)))) as opaque,
  count(*) as n from (select trim(p_name) as b from part) group by 1""",
    "last_number": f"select doc_id, coalesce(regexp_extract_all(text, {_NUM})[-1], '') as last_number from documents",
    "final_answer": rf"""select doc_id, md5(coalesce(case when contains(text, '####') then {_strip("string_split(text, '####')[-1]")} end,
  {_strip("coalesce(" + ", ".join((_phrase("(?i)答案[：:][ \\t\\n\\r\\f]*([^\\n]+)"), _phrase("(?i)the answer is[ \\t\\n\\r\\f]*([^\\n]+)"), _phrase("(?i)final answer[:\\s]+([^\\n]+)"))) + ")")},
  regexp_extract_all(text, {_NUM})[-1]::double::varchar, '')) as answer_md5 from documents""",
    "numeric_match": rf"""with e as (select list_transform(regexp_extract_all(props, {_NUM}), lambda x: x::double) as a, user_id::double as b from events)
select (len(a) > 0 and (abs(a[-1] - b) < 1e-6 or (len(a) = 1 and abs(a[1] - b) < 1e-6))) as same, count(*) as n from e group by 1""",
    "token_estimates": r"""select doc_id, (case when length(text) = 0 then 0 else greatest(1, floor(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 4.0::double
  + (length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) / 1.8::double)) end)::bigint as tokens from documents""",
    "trace_features": r"""with w as (select doc_id, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as words from documents)
select doc_id, length(text)::bigint as chars, words::bigint as words, words >= 384 as near_budget,
  words >= 384 and not regexp_matches(regexp_replace(text, '\s+$', ''), '[.!?。！？}\]]$') as possible_truncation,
  md5(case when length(text) > 200 then substring(text, 1, 200) || '...<truncated ' || (length(text) - 200) || ' chars>' else text end) as clipped_md5 from w""",
    "split_ratio": """with n as (select greatest(1, floor(count(*) * 0.9::double)) as n from documents)
select doc_id, case when row_number() over (order by md5('split:' || doc_id)) <= (select n from n) then 'train' else 'test' end as split from documents""",
    "split_existing": "select doc_id, case lang when 'fr' then 'test' else 'train' end as split from documents where lang in ('fr', 'en')",
    "split_holdout_by_key": """select doc_id, source, case when row_number() over (partition by source order by md5('holdout:' || doc_id))
  <= greatest(1, floor(count(*) over (partition by source) * 0.15::double)) then 'test' else 'train' end as split from documents""",
    "stratified_split_counts": f"with {_LM}, {_split('lang, module', 'lm')} select lang, module, split, count(*) as n from sp group by all",
    "stratified_split_rows": f"with {_LM}, {_split('lang, module', 'lm')} select seq, split from sp",
    "lf_val_carve": """with n as (select count(*) as c, least(64, greatest(8, floor(0.05::double * count(*)))) as k from documents)
select doc_id, case when row_number() over (order by doc_id) <= (select case when c - k >= 30 then k else 0 end from n) then 'lf_val' else 'train' end as split from documents""",
    "quota_largest_remainder": f"""with {_LR} select key, (f + case when row_number() over (order by frac desc, key) <= 97 - sum(f) over () then 1 else 0 end)::bigint as quota from y""",
    "plan_sample": f"""with {_PLAN},
r as (select doc_id, lang, source, md5('plan:' || doc_id) as h, row_number() over (partition by lang order by md5('plan:' || doc_id)) as place from documents),
t as (select r.*, case when place <= quota then 0 else 1 end as tier from r left join z using (lang))
select doc_id, lang, source from t order by tier, h limit 100""",
    "sample_shortfall": f"with {_SHORT} select lang, shortfall from sh",
    "supplement_pools": f"""with {_SHORT}, r as (select doc_id, lang, source, row_number() over (partition by lang order by source, doc_id) as place
  from documents where source not in ('src1', 'src2'))
select lang, doc_id, source from r join sh using (lang) where place <= shortfall""",
    "round_robin_probe": """select doc_id, source, turn from (select doc_id, source, row_number() over (partition by source order by md5('probe:' || doc_id)) as turn from documents)
order by turn, source limit 120""",
    "focus_sample": """with t as (select doc_id, lang, source, md5('focus:' || doc_id) as h,
  case when lang = 'de' and source = 'src3' then 0 when lang = 'de' then 1 when source = 'src3' then 2 else 3 end as tier from documents),
a as (select * from t where tier < 3 order by tier, h limit 42),
b as (select * from t where doc_id not in (select doc_id from a) order by h limit 60),
u as (select *, 0 as o from a union all select *, 1 as o from b)
select doc_id, lang, source from u order by o, tier, h limit 60""",
    "rollout_scores": f"with {_TRIES} select question_id, pass_count, rollout_count, pass_rate, flags from sc",
    "pass_count_histogram": f"""with {_TRIES} select i || '/8' as bin, count(passes) as n from range(0, 9) r(i) left join ps on passes = i group by i""",
    "threshold_policy": f"""with {_TRIES}, s as (select avg((passes <= 1)::int) as low, avg((passes between 2 and 4)::int) as border from ps)
select 5 as easy_min, 2 as medium_min, case when border >= 0.25 and low < 0.7 then 'relaxed' when low >= 0.7 then 'mostly_impossible' else 'canonical' end as reason from s""",
    "difficulty_from_pass_rate": f"with {_TRIES} select difficulty, count(*) as n from di group by 1",
    "cascade_difficulty": f"""with {_TRIES}, c as (select a.correct as x, b.correct as y from tr a left join tr b on b.question_id = a.question_id and b.rollout_idx = 1 where a.rollout_idx = 0)
select case when x or y is null then 'answer_only' else 'thinking' end as rollout_stage,
  case when not (x or coalesce(y, false)) then 'hard' when x or y is null then 'easy' else 'medium' end as difficulty, count(*) as n from c group by 1, 2""",
    "mastered": f"""with {_TRIES.replace("event_type in ('purchase', 'view')", "event_type <> 'error'")} select question_id, pass_count from sc where pass_count >= least(greatest(1, case when rollout_count = 8 then 6
  else floor(rollout_count * 0.75::double + 0.999999::double) end), greatest(1, rollout_count))""",
    "pass_at_k": f"with {_TRIES} select count(*) as n, avg((pass_count > 0)::int) as pass_at_k, round(avg(pass_rate), 6) as mean_rate from sc",
    "accuracy_by_role": "select event_type, count(*) as n, avg((event_type in ('purchase', 'view'))::int) as accuracy from events group by 1",
    "accuracy_by_difficulty": f"with {_TRIES} select difficulty, count(*) as n, round(avg(correct::int), 9) as accuracy from tr join di using (question_id) group by 1",
    "eval_gates": f"with {_ROUNDS} select round_id, pass_frozen, pass_old, pass_new, pass_probe, promote, stop from gc",
    "candidate_reward": f"""with {_ROUNDS}, r as (select *, 0.45::double * probe_acc + 0.25::double * new_after + 0.15::double * cotest_after
  + 0.10::double * (new_after - new_before) + 0.05::double * (cotest_after - cotest_before) as raw from gc)
select round_id, round(raw, 6) as raw_reward, round(raw + case when promote then 0.05::double else 0 end + case when stop then 0.15::double else 0 end, 6) as reward from r""",
    "inspection_decisions": f"""with {_ROUNDS}, r1 as (select * replace (round_id % 5 <> 0 as pass_frozen, round_id % 7 <> 0 as pass_old), old_count % 90 as k,
  0.45::double * probe_acc + 0.25::double * new_after + 0.15::double * cotest_after + 0.10::double * (new_after - new_before) + 0.05::double * (cotest_after - cotest_before) as raw from gc),
r2 as (select *, max(probe_acc) over p as bp, max(cotest_after) over p as bc, max(raw) over p as br from r1
  window p as (partition by round_id // 12 order by round_id rows between 3 preceding and 1 preceding)),
r3 as (select *, pass_frozen and pass_old
  and (new_after - new_before >= -0.02::double or (k > 0 and k <= 50 and new_after - new_before >= -0.10::double)
    or (k > 1 and (new_before - new_after <= 0 or new_before - new_after <= 1.64::double * sqrt((new_before * (1 - new_before) + new_after * (1 - new_after)) / k))))
  and (old_after - old_before >= 0.05::double or forgetting < 0 or cotest_after - cotest_before >= 0.10::double or cotest_after >= 0.55::double
    or probe_acc >= 0.30::double or coalesce(probe_acc - champion >= 0.03::double, false) or raw >= 0.24::double) as promising from r2),
r4 as (select *, promising or coalesce(probe_acc >= bp + 0.03::double, false) or coalesce(cotest_after >= bc + 0.10::double, false)
  or coalesce(raw >= br + 0.03::double, false) as positive_trend from r3)
select round_id, promising, positive_trend, case when round_id % 12 >= 10 then case when pass_frozen and pass_old then 'promote' else 'rollback' end
  when round_id % 6 >= 4 and not positive_trend then 'prune' when pass_frozen and pass_old and pass_new then 'promote'
  when promising then 'provisional_promote' when round_id % 6 >= 4 then 'keep_branch' else 'rollback' end as decision from r4""",
    "proportion_drops": f"""with {_ROUNDS} select round_id, coalesce(old_count > 1 and (new_after <= new_before
  or new_after - new_before <= 1.64::double * sqrt((new_after * (1 - new_after) + new_before * (1 - new_before)) / old_count)), false) as small from ro""",
    "difficulty_weights": f"""with {_TRIES}, a as (select difficulty, avg(correct::int) as acc from tr join di using (question_id) group by 1),
u as (select * from (values ('easy', 0.15::double), ('medium', 0.70::double), ('hard', 0.15::double)) t(difficulty, usual)),
l as (select difficulty, usual, case when acc is null then usual else 1 - acc end as lack from u left join a using (difficulty)),
w as (select difficulty, case when (select count(*) from a) = 0 or sum(lack) over () = 0 then usual else lack end as w from l),
x as (select *, max(w) over () as top, sum(w) over () as s, row_number() over (order by w desc) as p from w),
y as (select *, 0.05::double + 0.85::double * top / s > 0.8::double as over from x)
select difficulty, round(case when not over then 0.05::double + 0.85::double * w / s when p = 1 then 0.8::double
  when s = top then 0.1::double else 0.05::double + 0.1::double * w / (s - top) end, 9) as weight from y""",
    "bounded_shares": """with recursive w as (select lang, count(*)::double as w from documents group by 1), n as (select count(*) as n from w),
o as (select lang, w, row_number() over (order by w desc) as p, sum(w) over (order by w desc rows between current row and unbounded following) as tail from w),
f as (select min(p - 1) as k from o, n where 0.1::double + (1 - (p - 1) * 0.4::double - (n - p + 1) * 0.1::double) * w / tail <= 0.4::double + 1e-12)
select lang, round(case when p <= k then 0.4::double else 0.1::double + (1 - k * 0.4::double - (n - k) * 0.1::double) * w / (select tail from o where p = k + 1) end, 9) as weight
from o, n, f""",
    "transcript_pairs": rf"""with t as (select conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) order by turn) as t from conversations group by 1),
s as (select conv_id, regexp_extract_all(t, '(?im)^\s*(user|human|prompt|instruction|assistant|gpt|bot|model|completion|response)\s*:\s*', 1) as r,
  regexp_split_to_array(t, '(?im)^\s*(?:user|human|prompt|instruction|assistant|gpt|bot|model|completion|response)\s*:\s*')[2:] as b from t),
x as (select conv_id, unnest(r) as r, unnest(b) as b, unnest(range(1, len(r) + 1)) as i from s),
y as (select conv_id, lower(r) in ('user', 'human', 'prompt', 'instruction') as u, {_strip('b')} as b, i from x),
z as (select conv_id, arg_min(b, i) filter (u) as q, arg_max(b, i) filter (not u) as a from y where b <> '' group by 1)
select conv_id, md5(coalesce(q, '')) as question_md5, md5(coalesce(a, '')) as answer_md5 from t left join z using (conv_id)""",
    "judged_answers": """with e as (select event_id % 4 as kind, event_type, user_id::varchar as n from events),
g as (select *, case kind when 0 then n when 1 then '(0, ' || n || ']' when 2 then 'x = ' || n else n || ' apples' end as gold from e),
p as (select *, case event_type when 'purchase' then upper(gold) when 'view' then '[1, ' || n || ']' when 'click' then 'the answer is X = ' || n else 'so it must be ' || n end as said from g)
select kind, event_type, kind = 0 as plain, kind in (1, 2) as structured,
  case when event_type = 'purchase' then true when kind = 1 then false when kind = 2 then event_type = 'click'
    else true end as same, count(*) as n from p group by 1, 2, 3, 4, 5""",
    "goal_queries": rf"""with q as (select p_partkey, case when p_size % 2 = 0 then p_type end as f, p_name, p_size,
  case when p_size < 10 then 'math reasoning' when p_size < 20 then 'code repair' when p_size < 30 then 'translation' else 'reasoning instruction' end as g from part),
c as (select *, list_filter(regexp_split_to_array(regexp_replace(lower(f), '[^a-z0-9+.#\s-]', ' ', 'g'), '\s+'), lambda x: x <> '') as fw,
  array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z0-9+.#\s-]', ' ', 'g'), '\s+'), lambda x: x <> '')[1:4], ' ') as own from q)
select p_partkey, case when p_partkey % 3 = 2 then own when len(list_filter(fw, lambda x: x not in ({_DIFF}))) > 0
  then array_to_string(fw[1:4], ' ') else g end as query from c""",
    "metadata_columns": """select c as "column", case when c = 'title' then (select count(*) from part) else 0 end as n
from (values ('title'), ('category'), ('domain'), ('Language')) t(c)""",
    "boxed_answer": r"""select doc_id, trim(regexp_extract(substring(text, 1, 8) || '}', '^([^}]*)\}', 1), ' ' || chr(9) || chr(10) || chr(13)) as boxed from documents""",
    "registry_merge": f"""with {_REG}, b as (select *, row_number() over (partition by ds, row_id, question_id, text_hash order by worse, seq desc) as p from rg)
select status, count(*) as n, sum(seq)::bigint as seqs from b where p = 1 group by 1""",
    "registry_block_train": _blocked(TRAIN_BLOCKING),
    "registry_block_test": _blocked(TEST_BLOCKING).replace("as worse from orders)", "as worse from orders where o_orderstatus = 'P')"),
    "overlap_exclusion": f"select doc_id as seq from documents where sha256({_BODY}) not in (select sha256({_BODY}) from documents where source = 'src0')",
    "replay_newest": f"""with {_REPLAY} select seq, question_id from (select *, row_number() over (partition by question_id order by seq desc) as p from rp)
where p = 1 order by seq desc limit 1000""",
    "replay_lru_sample": f"""with {_REPLAY} select seq, bucket from rp order by case when len(used) = 0 and bucket = 'hard' then 0 when len(used) = 0 then 1 when bucket = 'hard' then 2 else 3 end,
  len(used), coalesce(list_max(used), -1), md5('replay:' || seq) limit 100""",
    "replay_topk": f"""with {_REPLAY}, b as (select * from rp where bucket = 'hard'),
u as (select * from b union all select * from rp where bucket = 'easy' and question_id not in (select question_id from b))
select seq, success from u order by success desc, seq limit 200""",
    "replay_mix": f"""with {_REPLAY}, n as (select * from rp where bucket = 'medium'), h as (select *, row_number() over (order by (len(used) > 0)::int, len(used), coalesce(list_max(used), -1), md5('replay:' || seq)) as p from rp where bucket = 'hard')
select 'new' as source_role, count(*) as n, sum(seq % 1000003)::bigint as seqs from n union all
select 'replay', count(*), sum(seq % 1000003)::bigint from h where p <= (select floor(count(*) * 0.1::double) from n)""",
    "item_state_current": f"with recursive {_ITEMS} select dataset, question_id, state from it",
    "dataset_state_counts": f"""with recursive {_ITEMS} select dataset, count(*) as n, count(*) filter (state = 'unused') as unused, count(*) filter (state = 'reserved') as reserved,
  count(*) filter (state = 'used') as used, count(*) filter (state = 'defeated') as defeated from it group by dataset""",
    "unused_items": f"""with recursive {_ITEMS}, a as (select distinct event_type as dataset, user_id as question_id from events)
select dataset, question_id from a anti join (select * from it where state <> 'unused') using (dataset, question_id)""",
    "rollout_cache_split": """with a as (select distinct event_type as dataset, user_id as question_id from events),
h as (select distinct event_type as dataset, user_id as question_id, true as cached from events where event_id % 3 > 0 and event_id % 5 <> 0)
select dataset, coalesce(cached, false) as cached, count(*) as n from a left join h using (dataset, question_id) group by 1, 2""",
    "shard_refs": """with d as (select source as dataset, count(*) as n from documents group by 1),
s as (select dataset, n, ceil(n / 30)::bigint as k, unnest(range(0, ceil(n / 30)::bigint)) as i from d)
select dataset, i as shard_id, i * 30 as "first", least((i + 1) * 30, n) as "end", round(1 - i / k * 0.01::double, 9) as score from s""",
    "window_offsets": """with s as (select distinct source as dataset, doc_id // 20 as w from documents where doc_id in (select doc_id from labels)),
p as (select dataset, w, row_number() over (partition by dataset order by w) - 1 as p from s),
m as (select source as dataset, max(doc_id) + 1 as next_row from documents where doc_id in (select doc_id from labels) group by 1)
select dataset, any_value(next_row) as next_row, count(*) filter (w = p) * 20 as next_offset from p join m using (dataset) group by dataset""",
    "window_reuse_score": """with c as (select source as dataset, doc_id // 100 * 100 as off, lang, count(*) as n, case lang when 'en' then 3 when 'fr' then 2 when 'de' then 1 else 0 end as need from documents group by 1, 2, 3)
select dataset, off as "offset", sum(least(n, need) * need)::bigint as score, sum(n)::bigint as total from c group by 1, 2""",
    "loss_series_summary": f"""with {_SERIES}, {_summary('su', 'loss')},
x as (select su.run, min(case when loss = mn then seq end) as ns, min(case when loss = mx then seq end) as xs from se join su on se.run = su.run group by su.run),
y as (select x.run, max(step) filter (seq = ns) as min_at, max(step) filter (seq = xs) as max_at from se join x on se.run = x.run group by x.run)
select run, fst as first, lst as last, mn as min, min_at::double as min_at_step, mx as max, max_at::double as max_at_step,
  round(case when ls <> fs then (lst - fst) / (ls - fs) when cnt > 1 then (lst - fst) / (cnt - 1) end, 9) as slope, round(std, 6) as std, trend, cnt as count from su join y using (run)""",
    "loss_spikes": f"""with {_SERIES}, b as (select run, loss, lag(loss) over (partition by run order by seq) as p from se)
select run, count(*) filter (loss > p * 1.20::double) as spikes, count(*) as count from b group by run""",
    "lr_shape": f"with {_SERIES}, {_SHAPE} select run, shape, count from sha",
    "loss_phase": f"""with {_SERIES}, {_summary('t', 'loss')}, {_summary('e', 'eval_loss')}, {_SHAPE},
j as (select t.run, t.fst, t.lst, t.std, t.trend, t.cnt, e.lst as el, e.trend as et, e.cnt as ec, shape,
  t.trend = 'flat' or coalesce(e.cnt >= 2 and e.trend = 'flat', false) as flat from t left join e using (run) left join sha using (run))
select run, case when cnt < 2 then 'insufficient_data' when trend = 'rising' or std > greatest(abs(fst) * 0.35, 0.35) then 'unstable'
  when coalesce(el - lst > 0.10, false) and trend = 'falling' then 'overfit_or_distribution_gap' when flat then 'plateau'
  when (case when fst <> 0 then (fst - lst) / greatest(abs(fst), 1e-12) else 0 end) < 0.20 then 'underfit'
  when shape = 'warmup_then_decay' then 'warmup_then_decay' when trend = 'falling' then 'converging' else 'stable' end as phase,
  flat and cnt >= 2 as plateau from j""",
    "log_failures": f"""with l as (select source as run, doc_id as line_no, text || case when doc_id % 11 = 5 then ' request timed out' when doc_id % 13 = 7 then ' CUDA out of memory' else '' end as line from documents),
k as (select run, line_no, {_FAIL} as kind from l)
select run, arg_min(kind, line_no) as kind, min(line_no) as line_no from k where kind is not null group by run""",
    "ucb_actions": f"""with {_EDGES}, a as (select action_key, count(*) as visits, sum(reward) as s from ed group by 1 union all select 'untried', 0, 0),
t as (select *, sum(visits) over () + 1 as total from a),
u as (select action_key, visits, s / greatest(visits, 1) as mean_reward, case when visits = 0 then 1e300 else s / visits + 0.15 * sqrt(ln(total + 1) / visits) end as score from t)
select action_key, visits::bigint as visits, round(mean_reward, 9) as mean_reward, row_number() over (order by score desc, action_key) as rank from u""",
    "dag_expansions": f"with {_EDGES} select seq, round(c.c_acctbal - p.c_acctbal, 4) as delta_value from ed join customer p on p.c_custkey = f join customer c on c.c_custkey = t",
    "best_edges": f"with {_EDGES} select seq, reward from ed order by reward desc, seq limit 20",
    "top_cards": f"""with {_EDGES}, n as (select c_custkey as f from customer order by c_acctbal desc, c_custkey limit 15)
select from_node_id, seq, place from (select f as from_node_id, seq, row_number() over (partition by f order by reward desc, seq) as place from ed join n using (f)) where place <= 3""",
    "tag_similarity": """with p as (select p_partkey as node_id, p_brand, list_distinct(string_split(p_type, ' ')) as tags from part),
w as (select p_brand as query_id, arg_min(tags, node_id) as tags from p group by 1),
s as (select query_id, node_id, len(list_intersect(w.tags, p.tags)) as k, len(w.tags) as a, len(p.tags) as b from w join p on len(list_intersect(w.tags, p.tags)) > 0),
r as (select query_id, node_id, k / (a + b - k) as similarity, row_number() over (partition by query_id order by k / (a + b - k) desc, node_id) as place from s)
select query_id, node_id, similarity, place from r where place <= 5""",
    "kernel_surrogate": """with c as (select n_nationkey as candidate_id, n_nationkey / 25 as x, n_regionkey / 5 as y from nation),
s as (select s_nationkey / 25 as x, s_suppkey % 5 / 5 as y, s_acctbal / 1e4 as reward from supplier),
j as (select candidate_id, reward, exp(-((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) / (2 * 0.25 * 0.25)) as w from c, s)
select candidate_id, round(sum(w), 6) as support, round(sum(w * reward) / sum(w), 6) as expected from j group by 1""",
    "finalised_reservations": """with r as (select *, o_custkey % 5 as round_id, o_orderstatus is distinct from 'P' as open from orders),
d as (select *, coalesce(open and round_id >= 3, false) as lost from r)
select o_orderpriority as dataset, cast(o_orderkey as varchar) as question_id,
  case when not open or round_id <= 1 then 'used' when lost then 'defeated' else 'reserved' end as state,
  cast(case when lost then 1 else 0 end as bigint) as defeats, cast(case when lost then round_id else -1 end as bigint) as defeated_round,
  case when lost then (round_id + 1) / 10 else -1 end as defeated_accuracy from d""",
    "ancestor_walk": "select * from (select 'n7' as node_id, 0 as depth union all select 'r' || n_regionkey, 1 from nation where n_nationkey = 7 union all select 'root', 2)",
    "bundle_manifest": f"""with {_LM}, {_split('lang, module', 'lm')} select split, lang as difficulty, module, count(*) as n from sp
group by grouping sets ((), (split), (split, lang), (split, module))""",
    "data_pressure": f"""with {_LM}, {_split('lang, module', 'lm')} select count(*) as n, count(*) filter (lang = 'en') as hard, count(*) filter (split = 'train') as train,
  count(*) filter (lang = 'en') / count(*) >= 0.8 as hard_dominated, count(*) filter (split = 'train') < 64 as train_short from sp""",
    "question_bank": "select case when doc_id >= 700 then 'probe_holdout' else 'train_pool' end as role, count(*) as n from documents where trim(text) <> '' group by 1",
    "eval_prompts": "select c_custkey, case when c_custkey % 2 = 0 then c_mktsegment else c_name end as prompt, case when c_custkey % 3 = 0 then 'x' else '' end as gold from customer",
    "content_queries": rf"""with w as (select doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9+.#\s-]', ' ', 'g'), '\s+'),
  lambda x: x <> '' and x not in ({_GENERIC})) as w from documents)
select doc_id, case when len(list_filter(w, lambda x: x not in ({_DIFF}))) = 0 then '' else array_to_string(w[1:4], ' ') end as query from w""",
    "question_ids": r"select page_id, translate(url, '/\', '__') || '_' || page_id as question_id from pages",
    "dominant_lang": """with c as (select source, lang, count(*) as n, min(doc_id) as o from documents group by 1, 2)
select source, arg_max(lang, n * 1000000000 - o) as lang, max(n) as n from c group by 1""",
    "ids_by_dataset": """with f as (select event_type, user_id, min(event_id) as o from events group by 1, 2)
select event_type, count(*) as n, md5(string_agg(user_id::varchar, ',' order by o)) as ids_md5 from f group by 1""",
    "champion_vs_candidate": """select count(*) as n, count(*) filter (o_orderstatus = 'F' and o_orderpriority not like '1%') as gained,
  count(*) filter (o_orderstatus <> 'F' and o_orderpriority like '1%') as lost from orders""",
    "dag_branch_scores": f"""with {_BRANCH} select seq, round(1.0::double * pr + 0.25::double * fr + 0.15::double * ns + 0.10::double * ct + bonus, 9) as score from bn
order by 1.0::double * pr + 0.25::double * fr + 0.15::double * ns + 0.10::double * ct + bonus desc, seq limit 25""",
    "action_evidence": f"""with {_BRANCH}, s as (select *, fr + 0.7::double * gr + 0.25::double * pr + 0.15::double * ns + 0.10::double * ct + bonus as score from bn)
select action_key, count(*) filter (score > 0 and decision <> 'rollback') as support, count(*) filter (score <= 0 or decision = 'rollback') as failures,
  round(least(greatest(avg(score), -0.25::double), 0.25::double), 6) as evidence from s group by 1""",
    "dag_situations": f"""with {_ROUNDS} select round_id, case when round_id % 5 >= 3 then 'repeated_rollback' when forgetting > 0.1::double then 'high_forgetting'
  when probe_acc < 0.75 then 'low_probe' when new_after < 0.5 then 'low_new_skill' when cotest_after < 0.5 then 'low_cotest' else '' end as situation from gc""",
    "gate_adjustments": f"""with {_ROUNDS}, g as (select round_id, round_id % 4 as rollback_streak, round_id % 4 >= 3 as l, round_id % 4 = 0 and round_id > 2 and probe_acc > 0.8::double as t from gc)
select round_id, rollback_streak, case when l then 0.06::double else 0.03::double end as frozen_tolerance, case when l then 0.15::double else 0.1::double end as forgetting_tolerance,
  case when t then 0.8::double else 0.75::double end as probe_gate, l or t as adjusted from g""",
    "retained_candidates": f"""with {_BRANCH} select round_id, decision from (select seq as round_id, decision,
  row_number() over (partition by decision = 'promote' order by seq desc) as p from br) where p <= case when decision = 'promote' then 1 else 3 end""",
    "proposal_errors": """with a as (select concat_ws(',', case when o_orderkey % 9 = 4 then 'missing_action_key' end,
  case when o_orderkey % 9 <> 4 and o_orderpriority not in ('1-URGENT', '2-HIGH') then 'invalid_action_key' end,
  case when o_orderkey % 2 = 0 then 'confidence_not_number' end) as errors from orders) select errors, count(*) as n from a group by 1""",
    "worst_questions": """with w as (select event_type from events group by 1 order by avg(value), event_type limit 1)
select event_type as difficulty, event_id as seq from events where event_type not in ('purchase', 'view') order by event_type <> (select event_type from w), event_id limit 20""",
    "hardest_probe": f"with {_TRIES} select question_id, pass_rate from sc order by pass_rate, question_id limit 200",
    "review_pauses": """with f as (select user_id as dataset, event_id::double as x from events where event_type = 'error')
select dataset, count(*) as n, max(x) as "last", case when count(*) >= 2 then max(x) + 600 end as "until" from f group by 1""",
    "keyed_exclusion": f"select doc_id as seq from documents where sha256({_BODY}) not in (select sha256({_BODY}) from documents where source = 'src1')",
    "classified_questions": f"""with m as (select case when doc_id % 4 = 0 then 'geometry_measurement' end as g, {_module('text')} as k from documents)
select coalesce(g, k) as module, (case when g is not null then 1.0 when k = 'unknown' then 0.3 else 0.7 end)::double as confidence, count(*) as n from m group by 1, 2""",
    "cleaned_rows": f"""select count(*) as n, sum(doc_id)::bigint as positions from documents where length({_BODY}) > 0 and not regexp_full_match({_BODY}, '[0-9]+')
  and {_strip(_LAST)} <> '' and not (case when {_any(_LOW, ('role', 'from', 'speaker'))} and {_any(_LOW, ('content', 'value', 'text'))}
  then starts_with({_BODY}, '[') or starts_with({_BODY}, '{{') else starts_with({_BODY}, '[') and contains({_LOW}, 'user') and contains({_LOW}, 'assistant') end)""",
    "first_wins_documents": "select min(doc_id) as doc_id from documents group by md5(text)",
    "union_new_refs": """with r as (select distinct o_custkey, o_orderpriority from orders), u as (select * from r where o_orderpriority = '1-URGENT')
select o_orderpriority, count(*) as n from (select * from u union all select * from r where o_custkey not in (select o_custkey from u)) group by 1""",
    "verdict_merge": """select case when o_custkey is null then 'old' else 'new' end as verdict, count(*) as n
from customer full join (select distinct o_custkey from orders) on o_custkey = c_custkey group by 1""",
    "config_overrides": "select n_nationkey, case when n_nationkey % 3 = 0 then 'other' else n_name end as n_name, n_regionkey from nation",
}

ORACLE |= nested.ORACLE | rounds.ORACLE | rounds.round_sql(_module("text")) | rounds.pairs_sql(_PAIRS) | states.ORACLE | states.module_sql(_module("text"))
