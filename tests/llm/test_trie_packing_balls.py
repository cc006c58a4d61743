"""Prefix tries, packing and ball k-means against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowloom.llm import ball_kmeans, packing, prefix_trie, queries

EMPTY = sha256(b"").hexdigest()


# --- prefix trie


def _trie_brute(rows, share):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role, sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in turns.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if share else 0
        convs[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    members, kids, leaves, saved, ends = defaultdict(list), Counter(), Counter(), Counter(), defaultdict(list)
    for c in sorted(convs):
        ends[convs[c]].append(str(c))
        for d in range(len(convs[c]) + 1):
            members[convs[c][:d]].append(c)
    kids.update(k[:-1] for k in members if k)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not kids[k]
    return {
        (m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], sha256(",".join(ends[k]).encode()).hexdigest())
        for k, m in members.items()
    }


_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_TURNS = "conv_id long, turn long, role string, text string"


def _trie(spark, rows, share, block=7, fan=2):
    turns = prefix_trie.ordered(spark.createDataFrame(rows, _TURNS).repartition(4))
    parts = prefix_trie.numbered(turns)
    found = prefix_trie.trie(*(prefix_trie.rebuilt if share else prefix_trie.paths)(turns, parts), block=block, fan=fan)
    return [tuple(r) for r in found.select(*_NODE).collect()]


@pytest.mark.parametrize("share", [True, False])
def test_trie(spark, share):
    rng = random.Random(3)
    rows = []
    for c in [*range(-110, 130), None]:
        for t in range(rng.choice([0, 1, 2, 3, 20])):
            role = rng.choice(["u", "a", None]) if rng.random() < 0.2 else "ua"[t % 2]
            rows.append((c, rng.choice([None, t, t, t]), role, rng.choice(["x", "yy", "x", "x", None, "é"])))
    got = _trie(spark, rows, share)
    assert len(got) == len(set(got))
    assert set(got) == _trie_brute(rows, share)


def test_trie_of_one_long_and_many_equal_conversations(spark):
    rows = [(5, t, "u", f"t{t % 3}") for t in range(400)] + [(c, t, "u", f"t{t}") for c in range(10, 210) for t in range(2)] + [(7, 1, None, None)]
    for share in (False, True):
        assert set(_trie(spark, rows, share, block=16)) == _trie_brute(rows, share)


def test_trie_of_odd_tables(spark):
    odd = spark.createDataFrame([(None, 1, "u", "x")], _TURNS)
    assert prefix_trie.prefix_trie(odd, share=True).count() == 0
    assert prefix_trie.prefix_trie(odd.where("false")).count() == 0
    other = spark.createDataFrame([(1, 2, "u", "b", 3, 4), (1, 1, "u", "a" * 100_000, 3, 4)], _TURNS + ", node long, range int")
    got = {r.depth: r.saved_tokens for r in prefix_trie.prefix_trie(other).collect()}
    assert got == {0: 0, 1: 0, 2: 0}
    turnless = spark.createDataFrame([(100, 1, "u", "a"), (101, 1, "u", "b")], _TURNS)
    assert {tuple(r) for r in prefix_trie.prefix_trie(turnless, share=True).select(*_NODE).collect()} == _trie_brute([(100, 1, "u", "a"), (101, 1, "u", "b")], True)


def test_a_name_depends_on_the_order_of_turns(spark):
    got = _trie(spark, [(1, 1, "u", "a"), (1, 2, "u", "b"), (2, 1, "u", "b"), (2, 2, "u", "a"), (3, 1, "ua", ""), (4, 1, "u", "a")], False)
    assert {(r[0], r[1]): r[3] for r in got} == {(1, 0): 4, (1, 1): 2, (1, 2): 1, (2, 1): 1, (2, 2): 1, (3, 1): 1}


# --- packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "The", "é", "日", ".", ",", "'s", "'", "12", " ", "　", "\x1c", "\x0b", "<|endoftext|>", "😀", "\r", "_", "x" * 70]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_library(parts):
    c = packing.codec(PATH)
    assert c.fast is not None
    assert c.text("".join(parts)) == c._library("".join(parts))


def test_long_runs_equal_the_library():
    c = packing.codec(PATH)
    for text in ("ab" * 3000, " " * 3000, "\n \n" * 500 + "x ", "." * 999, "日本" * 700):
        assert c.text(text) == c._library(text)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "_MEMO", 20)
    c = packing.ByteCodec(PATH)
    for i in range(50):
        text = " ".join(f"w{j}" for j in range(i, i + 9))
        assert c.text(text) == c._library(text)
        assert len(c.ids) <= 10 and len(c.old) <= 10


def test_files_of_other_kinds_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    c = packing.ByteCodec(path)
    assert c.fast is None and c.text("A b") == c._library("A b")


def _checked(rows, texts, capacity):
    """Pieces of each document are whole and in order, sequences gapless; the number of sequences."""
    tok = Tokenizer.from_file(PATH)
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for d, own in docs.items():
        ids = [*tok.encode(texts[d] or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            piece = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(piece))
            assert r.length == capacity if k else len(ids) - r.length == capacity * (len(own) - 1)
            at += r.length
        assert at == len(ids)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(seqs)


def test_packing_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op12_packing(spark, sf_dir).collect()
    n = _checked(rows, {r.doc_id: r.text for r in docs.collect()}, 2048)
    assert n <= 1 + max(-(-sum(r.length for r in rows) // 2048), sum(r.length > 1024 for r in rows))


def test_packing_of_odd_rows(spark):
    texts = {1: None, 2: "", 3: "a " * 5000, 4: " ".join(["word"] * 15), 5: "<|endoftext|>", 6: "x", None: "one more"}
    docs = spark.createDataFrame([(k, t, 9) for k, t in texts.items()], "doc_id long, text string, length int")
    rows = packing.pack(docs, PATH, capacity=16).collect()
    _checked(rows, texts, 16)
    assert packing.pack(docs.where("false"), PATH).count() == 0
    twice = packing.pack(docs.where("doc_id = 6").union(docs.where("doc_id = 6")), PATH).collect()
    assert len(twice) == 2 and {r.sequence_id for r in twice} == {0} and sorted(r.offset for r in twice) == [0, 2]


def test_sequences_hold_their_documents(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 9)) for i in range(60)], "doc_id long, text string")
    packed = packing.pack(docs, PATH, capacity=24, with_ids=True).cache()
    want = {(r.doc_id, r.piece): bytes(r.ids) for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == 4 * r.n_tokens <= 96
        assert bytes(r.ids) == b"".join(want[p.doc_id, p.piece] for p in r.pieces)


def test_two_shorter_pieces_replace_the_shortest():
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)  # 6 + 3 leaves 1; 6 + 2 + 2 fits
    assert plan.sequences == 2
    where = {(int(n), k): plan.of(np.array([n]), np.array([k]))[0][0] for n, k in ((6, 0), (2, 0), (2, 1), (3, 0))}
    assert where[6, 0] == where[2, 0] == where[2, 1] != where[3, 0]


def _fewest(sizes, capacity):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                go(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_plans_are_near_the_fewest(sizes):
    sizes = sorted(sizes, reverse=True)
    plan = packing.best_two_fit(Counter(sizes), 12)
    bins = defaultdict(list)
    for size, n in Counter(sizes).items():
        s, o = plan.of(np.full(n, size), np.arange(n))
        for a, b in zip(s, o, strict=True):
            bins[int(a)].append((int(b), size))
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 12
    assert len(bins) == plan.sequences <= _fewest(sizes, 12) + 1


def test_plans_do_not_grow_with_counts():
    rng = random.Random(1)
    counts = {s: rng.randint(1, 10**9) for s in range(1, 2049)}
    plan = packing.best_two_fit(counts)
    assert len(plan.length) < 20_000
    assert plan.sequences < 1.01 * sum(s * n for s, n in counts.items()) / 2048
    assert {int(s): int(plan.count[plan.length == s].sum()) for s in np.unique(plan.length)} == counts


def test_equal_lengths_of_many_tasks_have_places_of_their_own(spark):
    docs = spark.range(0, 3000, 1, 7).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "a b c").otherwise(F.concat(F.lit("n"), "id")).alias("text"))
    rows = packing.pack(docs, PATH, capacity=32).collect()
    assert _checked(rows, {r.doc_id: r.text for r in docs.collect()}, 32) <= 1.02 * sum(r.length for r in rows) / 32 + 1


# --- ball k-means


def _balls_brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in start[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for j, own in groups.items():
            centres[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in found)


_VECTORS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("k", [40, 7, 1])
def test_clusters(spark, k):
    rng = random.Random(5)
    rows = [(i if rng.random() > 0.1 else None, [rng.choice([-0.5, 0.25, 0.1, rng.random()]) for _ in range(3)]) for i in range(300)]
    rows += [(1, [0.0, 0.0, 0.0])] * 150 + [(1006, [5000.0, -20000.0, 3.0])]
    odd = [(1000, [float("nan"), 0.0, 0.0]), (1001, None), (1002, [1.0, 2.0]), (1003, [None, 1.0, 1.0]), (1004, [float("inf"), 0.0, 0.0]), (1005, [3e38, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, _VECTORS).repartition(3).withColumn("cluster", F.lit("x"))
    want = _balls_brute([(r.vec_id, r.embedding) for r in spark.createDataFrame(rows, _VECTORS).collect()], k, 5, 3)
    assert Counter(tuple(r) for r in ball_kmeans.cluster(df, k=k, dims=3).collect()) == want


def test_few_or_no_vectors(spark):
    none = spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<float>")
    assert ball_kmeans.cluster(none, dims=1).count() == 0
    few = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [-0.001])], _VECTORS)
    got = ball_kmeans.cluster(few, dims=1).collect()
    assert Counter(tuple(r) for r in got) == _balls_brute([(1, [1.0]), (2, [1.0]), (3, [-0.001])], 40, 5, 1)


@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=60), st.integers(1, 6), st.integers(1, 3))
@settings(max_examples=150, deadline=None)
def test_annuli_lose_no_nearer_centroid(points, k, steps):
    rows = np.array(points, np.int64)
    centres = rows[:k].copy()
    own, d, _ = ball_kmeans.assign(rows, None, ball_kmeans.Balls(centres))
    for _ in range(steps):
        new = np.array([rows[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else centres[j] for j in range(len(centres))])
        reach = np.array([math.sqrt(d[own == j].max(initial=0)) for j in range(len(centres))])
        balls = ball_kmeans.surround(new, reach + np.sqrt(((new - centres) ** 2).sum(1)))
        centres = new
        own, d, _ = ball_kmeans.assign(rows, own, balls)
        all_ = ball_kmeans.squared(rows, centres)
        assert (own == all_.argmin(1)).all() and (d == all_.min(1)).all()


def test_balls_apart_are_hardly_compared():
    rng = np.random.default_rng(1)
    centres = rng.integers(-20000, 20000, (30, 16))
    rows = (centres[:, None] + rng.integers(-300, 300, (30, 200, 16))).reshape(-1, 16)
    own, d, made = ball_kmeans.assign(rows, None, ball_kmeans.Balls(centres))
    assert made == len(rows) * 30
    balls = ball_kmeans.surround(centres, np.array([math.sqrt(d[own == j].max()) for j in range(30)]))
    again, _, made = ball_kmeans.assign(rows, own, balls)
    assert (again == own).all() and made < 1.5 * len(rows)


def test_large_components_stay_exact():
    rows = np.array([[1 << 26, -(1 << 26), 5], [-(1 << 27) + 1, (1 << 27) - 1, 0]], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in rows] for x in rows]
    assert ball_kmeans.squared(rows, rows).tolist() == want
