"""Operators for training data against brute force, and on difficult rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import canonical
from rowloom.llm import (
    _text, bpe, decontaminate, lang_id, licenses, near_dedup, pitman_yor, quality_model, quality_rules, queries, secrets, substring_dedup,
)
from rowloom.llm._graph import components
from rowloom.llm._lookup import HashIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(random.Random(5).choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(i % 97) for i in range(30_000))
#: Null in any column, empty and very long texts, repeated rows, equal identifiers.
ODD = [
    (1, None, "en", "s", None), (2, "", None, None, 0), (3, " \n\t ", "en", "s", 3), (4, "one", "en", None, 3), (4, "one", "en", None, 3),
    (5, "one", "de", "s", 3), (None, "no id here at all", "en", "s", 1), (6, LONG, "en", "s", len(LONG)), (7, LONG + " more", "en", "s", 1),
    (8, "x" * 40_000, "en", "s", 40_000), (9, "éß \U0001f600 日本", "de", "s", 6), (4, "a different text of the same id", "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Difficult rows, with columns whose names operators might use."""
    df = spark.createDataFrame(ODD, DOCS)
    for c in ("kept", "n_words", "class", "blob", "spans", "uid", "seq", "words", "key", "row_number", "score"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def plain(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# Shared parts


@given(st.lists(st.text(alphabet="abé \n\t\x0b.", max_size=30) | st.none(), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words(texts):
    got = [
        [w.data[a:b].tobytes().decode() for a, b in zip(w.start[s:e], w.end[s:e], strict=True)]
        for w in _text.words(pa.array(texts, pa.string()))
        for s, e in zip(w.first[:-1], w.first[1:], strict=True)
    ]
    assert got == [WORD.findall(t or "") for t in texts]


def test_long_rows_are_hashed_in_pieces():
    text = "ab cde " * 400_000
    whole = [w for w in _text.words(pa.array([text, "ab"]))]
    assert len(whole[0].hash) == 800_000 and len(set(whole[0].hash.tolist())) == 2
    assert whole[1].hash[0] == whole[0].hash[0]


def test_patterned_words_have_hashes_of_their_own():
    a = "a"
    for _ in range(12):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    (w,) = _text.words(pa.array([f"{a} {b} {a}"]))
    assert w.hash[0] == w.hash[2] != w.hash[1]
    one, two = (np.array([3 if x == "a" else 5 for x in y], np.uint64) for y in (a, b))
    assert _text.sequence(one) != _text.sequence(two) and _text.sequence(one[:0]) == 0


def test_rolling_depends_on_the_words_alone():
    h = np.arange(100, dtype=np.uint64) * np.uint64(77) + np.uint64(5)
    for width in (1, 4, 8, 9, 35):
        r = _text.rolling(np.concatenate([h, h]), width)
        assert (r[: 101 - width] == r[100 : 201 - width]).all() and len(set(r[:100].tolist())) == 100
    assert len(_text.rolling(h[:3], 4)) == 0


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=60), st.lists(st.integers(0, 2**64 - 1), max_size=60))
@settings(max_examples=100, deadline=None)
def test_hash_index(keys, asked):
    import pickle

    index = pickle.loads(pickle.dumps(HashIndex(np.array(keys, np.uint64))))
    want = {k: i for i, k in enumerate(keys)}
    asked = np.array([*asked, *keys], np.uint64)
    assert index.get(asked).tolist() == [want.get(int(k), -1) for k in asked]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 205), (205, 203)]
    got = dict(plain(components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100 and got[203] == 200 and 7 in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Queries against SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, duck, sf_dir, name):
    assert canonical(queries.QUERIES[name](spark, sf_dir).toPandas()) == canonical(duck.execute(queries.ORACLE[name]).df())


# Near copies


def _near_brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(rows))), key=repr)


def _variants(seed, n, edits):
    rnd = random.Random(seed)
    words = [rnd.choice("abcdefgh") + rnd.choice("ijklmnop") + str(rnd.randrange(40)) for _ in range(120)]
    out = []
    for i in range(n):
        w = list(words)
        for _ in range(rnd.randrange(edits)):
            k, what = rnd.randrange(len(w)), rnd.randrange(3)
            if what == 0:
                w[k] = f"new{rnd.randrange(9)}"
            elif what == 1:
                del w[k]
            else:
                w.insert(k, f"add{rnd.randrange(9)}")
        out.append(" ".join(w))
    return out


def test_near_copies_of_many_degrees(spark):
    texts = _variants(1, 60, 12) + _variants(2, 30, 25) + ["a b c d e", "A b c D e f", "x", "x", "", None]
    texts += [" ".join(t.split()[:n]) for t in _variants(3, 8, 3) for n in (5, 6, 9, 40, 50)]
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    for width in (4, 5):
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width)
        assert plain(got, "doc_id", "n_shingles", "component_id") == _near_brute(rows, width, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_groups_do_not_make_all_pairs(spark, monkeypatch):
    texts = _variants(7, 400, 3)
    seen = []
    before = near_dedup._confirmed

    def counted(pairs, *more):
        seen.append(pairs.count())
        return before(pairs, *more)

    monkeypatch.setattr(near_dedup, "_confirmed", counted)
    out = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=4)
    assert out.where("component_id = 0").count() == 400
    assert sum(seen) < 10 * 400


def test_near_copies_of_odd_rows(spark, odd):
    got = near_dedup.near_duplicates(odd)
    by = {(r.doc_id, r.n_shingles): r for r in got.collect()}
    assert got.count() == len(ODD)
    assert by[(1, 0)].component_id == 1 and by[(2, 0)].kept and by[(5, 1)].component_id == 4
    assert [r.component_id for r in got.collect() if r.doc_id == 7] == [6]
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


# Licenses


def test_license_wording():
    exact = licenses.TEMPLATES["MIT-text"]
    text = f"Some intro here. {exact}\nThe end of it."
    (a, b), *_ = licenses.blocks(text)
    assert any(n == "MIT-text" and d == 0 for n, _, _, d, _ in licenses.judge(text[a:b]))
    changed = exact.replace("free of charge", "for a fee of ten")
    name, reduction, words, differ, shown = licenses.judge(changed)[0]
    assert name == "MIT-text" and 0 < differ <= 5 and "free" in shown and reduction > 0.3
    assert licenses.judge("The license of this dog was renewed by its owner yesterday.") == []
    assert [n for n, *_ in licenses.judge("Licensed under the Apache License, Version 2.0.")][0] == "Apache-2.0"


def test_license_scan(spark, odd):
    assert licenses.scan(odd).count() == 0
    rows = [(1, "Words. Released under the MIT License. More words."), (1, "Words. Released under the MIT License. More words."), (2, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license, r.block_start, r.n_different) for r in got] == [(1, "MIT", 7, 0)] * 2


# Decontamination

ITEM = "Alice has 12 apples and gives Bob 5 apples so how many apples does the girl named Alice have left at the end"


def test_templates_catch_new_parameters(spark):
    rows = [
        (1, "intro text here. But " + ITEM + " and more words follow"), (2, ITEM.replace("Alice", "Maria").replace("12", "30")),
        (3, ITEM.upper()), (4, "nothing to see here at all in this text of words"), (5, None), (6, ""),
        (7, " ".join(ITEM.split()[:9])), (8, "Note that Ann has 12 apples and gives Bob 5 apples so how many apples does Ann have now I wonder"),
    ]
    bench = spark.createDataFrame([(0, ITEM), (1, None), (2, ""), (3, "short item")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (10**6, 0):
        got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs, bench, most=most).collect()}
        assert got == {(1, 0): "exact", (2, 0): "reparameterised", (3, 0): "exact"}
    assert plain(decontaminate.decontaminate(docs, bench), "doc_id")[:2] == [(4,), (5,)]


def test_inconsistent_slots_are_no_leak(spark):
    item = "we know that Tom likes tea and then Tom drinks tea while again Tom makes tea for the whole long evening"
    swap = item.replace("Tom", "Ann", 1).replace("Tom", "Eve", 1)
    docs = spark.createDataFrame([(1, item.replace("Tom", "Ann")), (2, swap)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert plain(decontaminate.leaks(docs, bench), "doc_id", "kind") == [(1, "reparameterised")]


def test_leaks_equal_brute_force(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: [re.sub(r"[^\w]", "", w.lower()) for w in WORD.findall(r.text)] for r in bench.collect()}
    want = set()
    for r in docs.collect():
        own = [x for x in (re.sub(r"[^\w]", "", w.lower()) for w in WORD.findall(r.text)) if x]
        have = {tuple(own[i : i + 8]) for i in range(len(own) - 7)}
        for item, w in items.items():
            w = [x for x in w if x]
            runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
            if sum(x in have for x in runs) >= 0.5 * len(runs):
                want.add((r.doc_id, item))
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op3_decontaminate"](spark, sf_dir).collect()}
    assert want <= got and len(got - want) <= 1


def test_leaks_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(odd, none).count() == 0
    bench = spark.createDataFrame([(0, "no id here at all")], "item_id long, text string")
    assert plain(decontaminate.leaks(odd, bench), "doc_id") == [(None,)]
    assert decontaminate.decontaminate(odd, bench).count() == len(ODD) - 1
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns
    assert decontaminate.leaks(odd.limit(0), bench).count() == 0


# Quality model


def test_isotonic():
    y = np.array([1.0, 3, 2, 2, 5])
    got = quality_model.isotonic(y, np.ones(5))
    assert np.allclose(got, [1, 7 / 3, 7 / 3, 7 / 3, 5])


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op4_quality_model"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    out = both[both.held_out]
    good, bad = out[out.quality == 1].score.values, out[out.quality == 0].score.values
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, None), (99, 1)], "doc_id long, quality int")
    got = quality_model.score_documents(odd, labels)
    assert got.count() == len(ODD) and got.where("score is null or score < 0 or score > 1").count() == 0
    none = quality_model.score_documents(odd, labels.limit(0))
    assert plain(none.select("score").distinct(), "score") == [(0.5,)]
    assert quality_model.score_documents(odd.limit(0), labels).count() == 0


# Language model


def _tokens(t):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]


@pytest.mark.parametrize("frequent", [pitman_yor.FREQUENT, 50])
def test_language_model(spark, sf_dir, frequent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.where(F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    model = pitman_yor.fit(train, frequent=frequent)
    got = {r.doc_id: r for r in pitman_yor.score(docs, model).collect()}
    texts = {r.doc_id: _tokens(r.text) for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in texts.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.distinct) == (n, v)
    for i, ws in texts.items():
        r = got[i]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert sum(got[i].score for i in texts if held(i)) > sum(got[i].base_score for i in texts if held(i))


def test_scores_are_sums_over_restaurants(spark):
    """Scores against a walk over all tables, and each context's chances against one."""
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice("abcdefg") * rnd.randrange(1, 3) for _ in range(rnd.randrange(12)))) for i in range(60)] + [(60, None), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frequent, cells in ((pitman_yor.FREQUENT, pitman_yor.MOST_CELLS), (4, 20)):
        model = pitman_yor.fit(docs, frequent=frequent, most_cells=cells)
        h, _, logp, logg = model.frequent
        words = {x: (a, b) for x, a, b in zip(h.tolist(), logp.tolist(), logg.tolist(), strict=True)}
        words |= {r.h % 2**64: (r.logp, r.logg) for r in model.words.collect()}
        delta = dict(zip(*(x.tolist() for x in model.common), strict=True)) | {r.k % 2**64: r.delta for r in model.pairs.collect()}
        got = {r.doc_id: r.score for r in pitman_yor.score(docs, model).collect()}
        seen, used, contexts = Counter(), {}, set()
        for i, text in rows:
            (w,) = _text.words(pa.array([text], pa.string()), _text.LOWER)
            h, k, _ = pitman_yor._tokens(w)
            before = [0, *h.tolist()[:-1]]
            want = sum(words[x][0] + words[u][1] + delta.get(key, 0) for u, x, key in zip(before, h.tolist(), k.tolist(), strict=True))
            assert abs(got[i] - want) < 1e-9 * max(1, abs(want))
            seen.update(k.tolist())
            used |= {key: (u, x) for u, x, key in zip(before, h.tolist(), k.tolist(), strict=True)}
            contexts |= set(before)
        assert {k for k, n in seen.items() if n > 1} == set(delta)  # every pair seen twice, whatever the bounds
        for u in contexts:
            share = 10 ** words[u][1]
            own = sum(share * 10 ** words[w][0] * (10 ** delta[k] - 1) for k, (a, w) in used.items() if a == u and k in delta)
            assert abs(share + own - 1) < 1e-5  # factors are kept as floats
        assert sum(10 ** p for p, _ in words.values()) < 1


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, many = ({r.doc_id: r.score for r in pitman_yor.score(d, pitman_yor.fit(d)).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert all(abs(one[i] - many[i]) < 1e-9 * abs(one[i]) for i in one)


def test_pairs_and_words_are_sent_by_parts(spark):
    """Counts against a plain count; few rows are shuffled, not one for each pair or word."""
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["a", "b", "é" * rnd.randrange(1, 4), str(rnd.randrange(40))]) for _ in range(rnd.randrange(90))) for _ in range(60)] + [None, "", " "]
    tokens = [_tokens(t) for t in texts]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    words = {r.word: r.c for r in pitman_yor.vocabulary(docs).collect()}
    assert words == {k.strip("\n"): n for k, n in Counter(w for ts in tokens for w in ts).items()}
    name = {r.h: r.word for r in pitman_yor.vocabulary(docs).collect()}
    want = {k: n for k, n in Counter((u.strip("\n"), w.strip("\n")) for ts in tokens for u, w in zip(["\n", *ts], ts, strict=False)).items() if n > 1}
    ranked = np.array([h for h, w in name.items() if len(w) < 2], np.int64).view(np.uint64)
    common = spark.sparkContext.broadcast(ranked)
    for bits in (0, 3):
        sent = docs.mapInArrow(pitman_yor._pairs(common, bits), pitman_yor._PARTS)
        assert sent.count() <= 3 * 2**bits < len(want)
        got = sent.groupBy("part").applyInArrow(pitman_yor._merged(common), "u long, w long, c long, easy boolean").collect()
        assert {(name[r.u], name[r.w]): r.c for r in got} == want and len(got) == len(want)
        assert all(r.easy == (len(name[r.u]) < 2 and len(name[r.w]) < 2) for r in got)


def test_seating_is_within_bounds():
    c = np.array([0, 1, 2, 1000, 10**9])
    t = pitman_yor._seat(c, np.full(5, 0.5), 0.5, np.arange(5, dtype=np.uint64), 3)
    assert t[0] == 0 and t[1] == 1 and (t <= c).all() and t[4] < 10**6


def test_draws_are_binomial():
    key = np.arange(40_000, dtype=np.uint64)
    for n, p in ((1, 0.3), (8, 0.02), (8, 0.9), (500, 0.4), (5, 0.0), (5, 1.0)):
        x = pitman_yor._binomial(np.full(len(key), n), np.full(len(key), p), key, 7)
        assert x.min() >= 0 and x.max() <= n and abs(x.mean() - n * p) < 0.03 * max(1, np.sqrt(n * p * (1 - p)))
        assert abs(x.var() - n * p * (1 - p)) <= 0.05 * n * p * (1 - p)


def test_few_customers_are_seated_as_one_by_one():
    """Tables of dishes with few customers against seating one customer after the other."""
    rnd, pull, d = random.Random(3), 0.8, 0.4
    for c in (2, 3, 4):
        t = pitman_yor._seat(np.full(30_000, c), np.full(30_000, pull), d, np.arange(30_000, dtype=np.uint64), 5)
        plain_t = []
        for _ in range(30_000):
            tables = 1
            for sat in range(1, c):
                tables += rnd.random() < pull / (pull + sat - d * tables)
            plain_t.append(tables)
        assert abs(t.mean() - np.mean(plain_t)) < 0.05


def test_spelling_is_a_distribution():
    words = [b"ab", b"abc", b"b", b"aab"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    spelled, offsets = pitman_yor._spelled(data, ends - [len(w) for w in words], ends)
    run, n = np.unique(lang_id.byte_runs(spelled, offsets, pitman_yor.ORDER), return_counts=True)
    low, m = np.unique(run[2:] & np.uint64(2**32 - 1), return_counts=True)
    for direct, customers in (({4: run}, {4: n}), ({4: run[:2], 3: low}, {4: n[:2], 3: m})):
        model = pitman_yor.Spelling(direct)
        model.sweep(customers, 1)
        model.sweep(customers, 2)
        tables = model.tables(2)
        for context in (b"\n\n\n\n", b"\n\nab", b"zzzz"):
            keys = np.array([int.from_bytes(context, "big") << 8 | b for b in range(256)], np.uint64)
            assert np.allclose(np.exp2(-tables.lookup(keys)).sum(0), 1, atol=1e-4)


def test_cells_beyond_the_bound_go_to_their_parents(spark):
    rows = [(pitman_yor._BLANK + i * 256 + (i % 7) * 2**32, 1 + i % 5) for i in range(300)]
    found = pitman_yor._directed(spark.createDataFrame(rows, "run long, n long"), 100)
    assert max(map(len, (k for k, _ in found.values()))) <= 300 and sum(int(n.sum()) for _, n in found.values()) == sum(n for _, n in rows)


def test_scores_do_not_depend_on_the_bound_of_cells(spark):
    """Every spelling cell is modelled, whether the driver or executors seat it; words that are not known, too."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, n)))
    rows = [(i, " ".join(word(8) for _ in range(rnd.randrange(20)))) for i in range(80)] + [(80, None), (81, "zz qqq " + word(99))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where("doc_id % 3 > 0")
    got = []
    for frequent, most in ((pitman_yor.FREQUENT, pitman_yor.MOST_CELLS), (pitman_yor.FREQUENT, 40), (4, 0)):
        model = pitman_yor.fit(train, frequent=frequent, most_cells=most)
        assert (model.rest is None) == (most == pitman_yor.MOST_CELLS) and max(map(len, model.spelling.cost[2:])) <= most
        got.append({r.doc_id: (r.score, r.n_known, r.base_score) for r in pitman_yor.score(docs, model).collect()})
    for other in got[1:]:
        assert all(np.allclose(other[i], got[0][i], rtol=1e-6, atol=1e-6) for i in got[0])


def test_language_model_of_odd_rows(spark, odd):
    got = pitman_yor.score(odd, pitman_yor.fit(odd)).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    untaught = pitman_yor.score(odd, pitman_yor.fit(odd.limit(0))).collect()
    assert all(math.isfinite(r.score) and r.n_known == 0 and r.base_score == 0 for r in untaught)
    assert pitman_yor.score(odd.limit(0), pitman_yor.fit(odd)).count() == 0


# Secrets


def _spans_brute(t):
    t = t or ""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secrets(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["op6_secrets"](spark, sf_dir).collect():
        assert r.base_sha256 == hashlib.sha256(_spans_brute(texts[r.doc_id]).encode()).hexdigest()


@given(st.lists(st.sampled_from(["password", "API_KEY", "apikey", "tokEn", "=", ":", " ", '"', "abc123", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "ſecret", "é"]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_spans_equal_the_patterns(parts):
    text = "".join(parts)
    found = [(k, a, b) for k, a, b in secrets.find(text) if k in secrets.BASE_KINDS]
    assert ",".join(f"{k}:{a}:{b}" for k, a, b in found) == _spans_brute(text)
    assert not found or re.search(secrets._TRIGGER, text)


def test_ledger_is_incremental(spark):
    rows = [("a", "password = hunter22"), ("b", "password = hunter22"), ("c", "plain"), ("d", None)]
    first, entries = secrets.scan_versions(spark.createDataFrame(rows, "path string, text string"))
    assert plain(first.select("path", F.size("spans").alias("n")), "path", "n") == [("a", 1), ("b", 1), ("c", 0), ("d", 0)]
    assert entries.count() == 3
    more = spark.createDataFrame([*rows, ("e", "token: abcdefgh")], "path string, text string")
    again, new = secrets.scan_versions(more, entries)
    assert new.count() == 1 and again.count() == 5
    assert again.where("path = 'a'").select(F.size("spans")).first()[0] == 1
    _, other = secrets.scan_versions(more, entries, rule_version="3")
    assert other.count() == 4


def test_findings_of_a_blob_with_most_paths(spark):
    hot = spark.range(400).select(F.lit(None).cast("string").alias("path"), F.lit("é token=abcdefgh").alias("text"))
    rows = hot.unionByName(spark.createDataFrame([("x", "plain"), ("y", None)], "path string, text string"))
    found, entries = secrets.scan_versions(rows)
    assert found.count() == 402 and entries.count() == 3
    assert found.where("path is null and spans[0].start = 2 and size(spans) = 1").count() == 400
    assert found.where("size(spans) = 0").count() == 2
    again, new = secrets.scan_versions(rows, entries)
    assert new.count() == 0 and again.where("size(spans) = 1").count() == 400


def test_secrets_of_odd_rows(spark, odd):
    found, entries = secrets.scan_versions(odd, path_col="doc_id")
    assert found.count() == len(ODD) and entries.count() == len({r[1] or "" for r in ODD})
    assert secrets.scan_versions(odd.limit(0), path_col="doc_id")[0].count() == 0
    spans = [{"kind": "a", "start": 2, "end": 5}, {"kind": "b", "start": 4, "end": 6}]
    assert secrets.redacted("0123456789", spans) == "01<secret>6789"
    rnd = random.Random(1)
    rows = []
    for i in range(60):
        text = "".join(rnd.choice("aé日\U0001f600 ") for _ in range(30))
        cuts = [sorted(rnd.sample(range(31), 2)) for _ in range(rnd.randrange(5))]
        rows.append((i, text, [("k", a, b) for a, b in cuts]))
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<kind:string,start:long,end:long>>")
    got = dict(plain(df.select("i", secrets.redact(F.col("t"), F.col("s")).alias("r")), "i", "r"))
    assert got == {i: secrets.redacted(t, [{"kind": k, "start": a, "end": b} for k, a, b in s]) for i, t, s in rows}


# Repeated passages


def _cut_brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    starts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {i + j for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,gram", [(5, 2), (9, 8), (12, 3)])
def test_repeats(spark, window, gram):
    rnd = random.Random(window)
    passages = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(4, 30))) for _ in range(8)]
    rows = [(i, " ".join(rnd.choice(passages) if rnd.random() < 0.4 else f"u{rnd.randrange(500)}" for _ in range(rnd.randrange(0, 25)))) for i in range(60)]
    rows += [(100, "r " * 40), (101, "r " * 3), (102, rows[0][1]), (103, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.remove_repeats(docs, window=window, gram=gram)
    assert plain(got, "doc_id", "n_words", "n_removed", "kept_sha256") == _cut_brute(rows, window)
    full = substring_dedup.remove_repeats(docs, window=window, gram=gram, bloom_bits=64)  # a filter that lets all through
    assert plain(full, "doc_id", "n_removed") == sorted(((r[0], r[2]) for r in _cut_brute(rows, window)), key=repr)


def test_index_of_batches(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(30))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark, 6, 3, fanout=2)
    for k in range(4):
        run = index.append(docs.where(F.col("doc_id") % 4 == k))
        assert len(index.runs) <= 3
    assert index.matches(run).count() > 0
    index.compact()
    assert len(index.runs) == 1
    got = substring_dedup.remove_repeats(docs, index, window=6, gram=3)
    assert plain(got, "doc_id", "n_words", "n_removed", "kept_sha256") == _cut_brute(rows, 6)


def test_repeats_of_odd_rows(spark, odd):
    rows = [(r[0], r[1]) for r in ODD if r[0] is not None]
    got = substring_dedup.remove_repeats(odd.where("doc_id is not null"))
    assert plain(got, "doc_id", "n_words", "n_removed", "kept_sha256") == _cut_brute(rows, 35)
    assert substring_dedup.remove_repeats(odd).where("doc_id is null").count() == 1
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


# Languages


def test_code_lengths_equal_the_definition():
    texts = {"a": "the cat sat on the mat", "b": "le chat est ici"}
    langs, lang, run, n = sorted(texts), [], [], []
    for i, k in enumerate(langs):
        data = np.frombuffer(texts[k].encode(), np.uint8)
        keys, c = np.unique(lang_id.byte_runs(data, np.array([0, len(data)])), return_counts=True)
        lang += [i] * len(keys)
        run += keys.tolist()
        n += c.tolist()
    model = lang_id.Model(langs, np.array(lang), np.array(run, np.uint64), np.array(n, float))

    def cost(known, asked):
        counts = {}
        own = b"\n\n\n" + known.encode()
        for i in range(3, len(own)):
            for o in range(4):
                counts.setdefault(own[i - o : i], Counter())[own[i]] += 1
        total, b = 0.0, b"\n\n\n" + asked.encode()
        for i in range(3, len(b)):
            for o in (3, 2, 1, 0):
                seen = counts.get(b[i - o : i])
                if not seen:
                    continue
                size, kinds = sum(seen.values()), len(seen)
                if b[i] in seen:
                    total += math.log2((size + kinds) / seen[b[i]])
                    break
                total += math.log2((size + kinds) / kinds)
            else:
                total += 8
        return total

    for asked in ("the chat", "zzz é", "le"):
        data = np.frombuffer(asked.encode(), np.uint8)
        got = model.bits(data, np.array([0, len(data)]))[0]
        assert np.allclose(got, [cost(texts[k], asked) for k in langs], rtol=1e-4)


def test_languages_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_language_id"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark, odd):
    model = lang_id.fit(odd)
    got = lang_id.identify(odd, model)
    assert got.count() == len(ODD)
    assert {r.lang_pred for r in got.where("doc_id in (1, 2, 3)").collect()} == {"und"}
    assert {r.lang_pred for r in got.where("doc_id not in (1, 2, 3)").collect()} <= {"en", "de"}
    untaught = lang_id.identify(odd, lang_id.fit(odd.limit(0)))
    assert {(r.lang_pred, r.score) for r in untaught.collect()} == {("und", 0.0)}
    assert lang_id.identify(odd.limit(0), model).count() == 0


def test_case_and_numbers_do_not_decide(spark):
    rows = [(i, "the quick brown fox and the lazy dog", "en") for i in range(5)] + [(i, "der schnelle fuchs und der faule hund", "de") for i in range(5, 10)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "THE DOG AND THE FOX"), (2, "a1b2c3d4e5f6 0x99ff der hund")], "doc_id long, text string")
    assert plain(lang_id.identify(asked, model), "doc_id", "lang_pred") == [(1, "en"), (2, "de")]


# Tokens


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(TOKENIZER)


@given(st.text(alphabet="abcdeinghtor", min_size=2, max_size=60), st.data())
@settings(max_examples=300, deadline=None)
def test_joined_halves_equal_the_whole(text, data):
    c = bpe.codec(TOKENIZER)
    cut = data.draw(st.integers(1, len(text) - 1))
    assert c.join(c.merge(text[:cut], False), c.merge(text[cut:], True), True) == c.merge(text, True)
    assert c.join(c.merge(text[:cut], False), c.merge(text[cut:], False), False) == c.merge(text, False)


def _digests(c, t):
    e = c.whole.encode(t or "", add_special_tokens=False)
    shown = c.whole.decode(e.ids, skip_special_tokens=False)
    return len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()


@pytest.mark.parametrize("long,segment", [(bpe.LONG, bpe.SEGMENT), (40, 7)])
def test_tokens_equal_the_library(spark, codec, long, segment):
    rnd = random.Random(9)
    texts = [None, "", " ", "Hello WORLD's 12 <|endoftext|>x", "<|ENDOFTEXT|>", "é　ü \u0001\x1c z", "İ Á é", "a" * 900 + "b" + "hello" * 300]
    texts += ["word " * 50 + "x1" * 400 + " tail<|startoftext|>" + "çé" * 300, "A" * 500 + "<|endoftext|>" + "the" * 90, "don't " * 3]
    texts += ["".join(rnd.choice("abcdeEé1 .'s\n") for _ in range(rnd.randrange(600))) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = plain(bpe.digests(docs, TOKENIZER, long=long, segment=segment), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(((i, *_digests(codec, t)) for i, t in enumerate(texts)), key=repr)


def test_tokens_of_odd_rows(spark, odd, codec):
    got = plain(bpe.digests(odd, TOKENIZER), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(((r[0], *_digests(codec, r[1])) for r in ODD), key=repr)
    assert bpe.digests(odd.limit(0), TOKENIZER).count() == 0


def test_ids_and_back(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    ids = bpe.encode(docs, TOKENIZER)
    assert plain(bpe.decode(ids, TOKENIZER), "doc_id", "text") == [(1, "hello</w> world</w>"), (2, "")]


def test_memo_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe, "_MEMO", 20)
    c = bpe.Codec(TOKENIZER)
    for k in range(10):
        words = {f"w{k}{j}".encode() for j in range(8)} | {b"always"}
        c.learn(words)
        assert all(w in c.ids for w in words) and len(c.ids) <= 20


# Quality rules


def test_rules_of_odd_rows(spark, odd):
    rows = quality_rules.ledger(odd)
    by = {(r.doc_id, r.n_words): r for r in rows.collect()}
    assert rows.count() == len(ODD) and by[(1, 0)].failed & 1 and by[(6, 30_000)].n_words == 30_000
    assert quality_rules.ledger(odd.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    texts = ["word " * 60, " ".join(f"good{i}" for i in range(60)), "few words", "### " * 60 + " ".join(f"x{i}" for i in range(60)), "same line here\n" * 30]
    rows = quality_rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kept = {v: plain(quality_rules.apply_policy(rows, v).where("kept"), "doc_id") for v in quality_rules.POLICIES}
    assert kept["v2"] == [(1,)] and set(kept["v2"]) <= set(kept["v1"]) <= set(kept["base"])
    table = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablations(rows, "base").collect()}
    assert table["few_words"][0] == 1 and table["repeated_runs"][0] == 2 and table["few_words"][1] == 1
    assert all(n >= only for n, only in table.values())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# The pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secrets", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, step = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, step, sf_dir)
        assert out.columns == columns and out.count() <= step.count(), name
        step = out
    texts = {r.doc_id: r.text for r in step.collect()}
    assert all(not _spans_brute(t) for t in texts.values())
    final = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in final.collect()} == set(texts)


def test_pipeline_stages_of_odd_rows(spark, odd, sf_dir):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf_dir).count() == 0, name
        out = stage(spark, odd, sf_dir)
        assert out.count() <= len(ODD)
        if name != "bpe":
            assert out.columns == odd.columns, name
    near = corpus_pipeline.near_copies(spark, odd, sf_dir)
    assert near.where("doc_id = 4 and text = 'one'").count() == 1 and near.where("doc_id in (5, 7)").count() == 0
