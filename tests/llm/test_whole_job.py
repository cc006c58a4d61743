"""Work that earlier forms of the operators left out."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rowloom.llm import bpe, decontaminate, lang_id, licenses, queries, substring_dedup


def test_a_batch_loses_what_only_history_repeats(spark, monkeypatch):
    old, new = (" ".join(f"{k}{j}" for j in range(40)) for k in "ab")
    first = spark.createDataFrame([(1, old), (2, "x " * 3), (3, new + " c")], "doc_id long, text string")
    batch = spark.createDataFrame([(4, "some words " + " ".join(old.split()[5:25]) + " end"), (5, new + " c"), (6, "y z")], "doc_id long, text string")
    want = {4: "some words end", 5: "", 6: "y z"}
    index = substring_dedup.FingerprintIndex(spark, 6, 3, fanout=2)
    index.append(first.where("doc_id = 1"))
    index.append(first.where("doc_id > 1"))
    run = index.append(batch)
    assert len(index.runs) == 2
    for r in (None, run):
        got = substring_dedup.remove_repeats(batch, index, window=6, gram=3, run=r)
        assert {x.doc_id: x.kept_sha256 for x in got.collect()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}


def test_the_query_joins_and_compacts_runs(spark, monkeypatch):
    done = []
    compact = substring_dedup.FingerprintIndex.compact
    monkeypatch.setattr(substring_dedup.FingerprintIndex, "compact", lambda self: (done.append(len(self.runs)), compact(self)))
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h").alias("text"))
    assert substring_dedup.remove_repeats(docs, window=6, gram=3).agg(F.sum("n_removed")).first()[0] == 160
    assert done == [4]


def test_edited_copies_of_items_are_leaks(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(100)]
    items = [(n, " ".join(words[:n])) for n in (30, 60, 100)]
    names = "Alice has 12 apples. Bob has 5 apples. Alice gives Bob 3 apples. How many apples does Alice have now?"
    full = "we know that yesterday Ann bought a very large cake and later she told Ann that the cake was eaten"
    bench = spark.createDataFrame([*items, (1, names), (2, full)], "item_id long, text string")
    put = [(n, " ".join([*words[: n // 2], "inserted", *words[n // 2 : n]])) for n, _ in items]
    out = [(n + 1, " ".join([*words[: n // 2], *words[n // 2 + 1 : n]])) for n, _ in items]
    docs = [*put, *out, (1, names.replace("Alice", "Maria").replace("Bob", "Tom")), (2, full.replace("Ann", "Mary Jane")), (3, "one two three")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {(n, n) for n, _ in items} | {(n + 1, n) for n, _ in items} | {(1, 1), (2, 2)} <= got
    assert all(d != 3 for d, _ in got)


def test_wrapped_notices_are_confirmed(spark):
    rows = []
    for name in ("MIT-text", "GPL-3.0-header", "Apache-2.0-header", "BSD-3-Clause"):
        lines = textwrap.wrap(licenses.TEMPLATES[name], 76)
        rows += [(name, "\n".join(f" * {x}" for x in lines)), (name, "The first of all words.\n\n" + "\n".join(lines) + "\n\nint main of the rest\n")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).where("license = doc_id and n_different = 0")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in rows)


def test_more_than_three_templates_of_a_block():
    short = [licenses.TEMPLATES[k] for k in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0", "CC-BY-4.0")]
    assert {"Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0", "CC-BY-4.0"} <= {v[0] for v in licenses.judge(" ".join(short))}


def test_white_space_alone_keeps_its_row(spark):
    path, none = public_tokenizers.path("word_bpe_49k.json"), hashlib.sha256(b"").hexdigest()
    for rows in ([(1, "\u3000" * 6000)], [(1, "\u3000" * 6000), (2, "x" * 20_000)]):
        got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
        assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
        assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, none, none) for r in got if r.doc_id == 1)


def test_every_template_is_found_in_usual_line_breaks(spark):
    rows = []
    for name, text in licenses.TEMPLATES.items():
        lines = textwrap.wrap(text, 76, break_on_hyphens=False)
        rows += [(name, text), (name, "\n".join(f" * {x}" for x in lines)), (name, "Copyright (c) 2020 Someone\n\n" + "\n".join(lines) + "\n\nint main()\n")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).where("license = doc_id and n_different = 0")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in rows)


def test_versions_and_variants_are_told_apart():
    for text, want in (
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"CC-BY-SA-4.0"}),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", {"CC-BY-3.0"}),
        (licenses.TEMPLATES["LGPL-3.0-header"], {"LGPL-3.0-header"}), (licenses.TEMPLATES["GPL-2.0-header"], {"GPL-2.0-header"}),
        ("Licensed under CC BY-NC-SA 4.0.", {"CC-BY-NC-SA-4.0-name"}), ("Licensed under the Apache License, Version 1.1.", set()),
    ):
        assert {x[2] for x in licenses.notices(text)} == want, text


def test_each_copy_of_a_notice_is_returned():
    one = licenses.TEMPLATES["Apache-2.0"]
    text = f"{one} {licenses.TEMPLATES['MIT']} {one}"
    assert sorted((x[0], x[1], x[2]) for x in licenses.notices(text) if x[2] == "Apache-2.0") == [
        (0, len(one), "Apache-2.0"), (len(text) - len(one), len(text), "Apache-2.0"),
    ]


def test_exact_notices_equal_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    docs |= {-1 - i: f"é {t} \n{t[:-20]}" for i, t in enumerate(licenses.TEMPLATES.values())} | {-100: "word " * 50_000 + licenses.TEMPLATES["MIT"]}
    want = set()
    for i, text in docs.items():
        have = f" {' '.join(licenses._words(text))} "
        want |= {(i, k) for k, t in licenses.TEMPLATES.items() if f" {' '.join(licenses._words(t))} " in have}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in licenses.scan(rows).where("n_different = 0").collect() if not r.license.endswith(("-name", "-spdx"))}
    assert got == want and len(want) > len(licenses.TEMPLATES)


def test_items_with_one_word_changed_are_found(spark, sf_dir):
    """Recall over all benchmark items of nine words or more, edited at three places in three ways, inside documents."""
    rnd = random.Random(8)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: r.text.split() for r in bench.collect()}
    around = [f"filler{rnd.randrange(900)}" for _ in range(4000)]
    docs, want = [], set()
    for item, words in items.items():
        for share in (0.25, 0.5, 0.75):
            at = int(len(words) * share)
            for edited in ([*words[:at], "other", *words[at + 1 :]], [*words[:at], "more", *words[at:]], [*words[:at], *words[at + 1 :]]):
                start = rnd.randrange(3000)
                docs.append((len(docs), " ".join([*around[start : start + 50], *edited, *around[start + 50 : start + 90]])))
                want |= {(docs[-1][0], item)} if len(words) >= 9 else set()
    docs += [(10**6 + i, " ".join(rnd.sample(around, 200))) for i in range(200)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(want & got) >= 0.9 * len(want) and all(d < 10**6 for d, _ in got)


def test_items_of_a_word_or_two_do_not_mark_ordinary_texts(spark):
    bench = spark.createDataFrame([(0, "Yes?"), (1, "so it is"), (2, "what is it then")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "yes we can and so it is"), (2, "Yes."), (3, "so it is"), (4, "and what is it then to us")], "doc_id long, text string")
    for most in (10**6, 0):
        got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, most=most).collect())
        assert got == [(2, 0), (3, 1), (4, 2)]


def test_digits_do_not_blank_texts_without_spaces(spark):
    rows = [(i, "これは日本語の文です。今日は天気がいいですね。", "ja") for i in range(5)] + [(i, "这是中文的句子。今天天气很好。", "zh") for i in range(5, 10)]
    rows += [(i, "this is a sentence of english words", "en") for i in range(10, 15)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, "今日は3月です。天気がいいですね"), (2, "今天是3月。天气很好"), (3, "v2.0 B12")]
    got = {r.doc_id: (r.lang_pred, r.bits_per_byte) for r in lang_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got[1][0] == "ja" and got[2][0] == "zh" and got[1][1] is not None
    assert got[3][0] in ("en", "ja", "zh")


def test_languages_equal_brute_force(spark, sf_dir):
    """The query's model and predictions, walked byte by byte with dictionaries, on the shorter texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2

    def clean(text):
        words = [" " * len(w) if re.search("[0-9]", w) and w.isascii() else re.sub("[0-9]", " ", w) for w in re.split(r"([\x20\x09-\x0D]+)", text)]
        low = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), "".join(words)).encode()
        return low

    def steps(data):
        own = b"\n\n\n" + data
        return [(own[:i][-3:], own[i]) for i in range(3, len(own)) if not (own[i] == 32 and i > 3 and own[i - 1] == 32)]

    counts = {}
    for r in docs:  # fewer texts of each language than the sample takes
        if r.text is not None and r.lang is not None and not held(r.doc_id):
            for context, b in steps(clean(r.text)):
                for o in range(4):
                    counts.setdefault((r.lang, context[3 - o :]), Counter())[b] += 1
    sums = {k: (sum(c.values()), len(c)) for k, c in counts.items()}
    langs = sorted({k[0] for k in counts})

    def bits(lang, data):
        total = 0.0
        for context, b in steps(data):
            for o in (3, 2, 1, 0):
                seen = counts.get((lang, context[3 - o :]))
                if not seen:
                    continue
                size, kinds = sums[lang, context[3 - o :]]
                if b in seen:
                    total += math.log2((size + kinds) / seen[b])
                    break
                total += math.log2((size + kinds) / kinds)
            else:
                total += 8
        return total

    got = {r.doc_id: r for r in queries.QUERIES["op8_language_id"](spark, sf_dir).collect()}
    short = [r for r in docs if r.text is not None and len(r.text) < 3000][:60]
    assert len(short) > 20
    for r in short:
        if not re.search(r"[^\W\d_]", r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        cost = {k: bits(k, clean(r.text)) for k in langs}
        best = min(langs, key=lambda k: (cost[k], k))
        assert got[r.doc_id].lang_pred == best or abs(cost[got[r.doc_id].lang_pred] - cost[best]) < 1e-3 * cost[best]
        share = 1 / sum(2 ** max(cost[best] - c, -1000) for c in cost.values())
        assert got[r.doc_id].lang_pred != best or abs(got[r.doc_id].score - share) < 1e-2


def test_long_unsplit_text_goes_through_tree_joins(spark, monkeypatch):
    rnd = random.Random(4)
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["".join(rnd.choice("abcdeinorst") for _ in range(n)) for n in (bpe.LONG + 1, 5_000, 40_000)]
    texts += [f"a short start {texts[1]} and {texts[0]}, then an end", "日本" * 2_000, "plain words", None, "", "x" * bpe.LONG]
    seen = []
    before = bpe.encode_long
    monkeypatch.setattr(bpe, "encode_long", lambda rest, *more: (seen.append(rest.count()), before(rest, *more))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, path).collect()}
    sums = {r.doc_id: r for r in bpe.digests(docs, path).collect()}
    shown = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert seen == [5, 5, 5]
    c = bpe.codec(path)
    for i, t in enumerate(texts):
        want = c.whole.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == want and sums[i].n_tokens == len(want)
        assert sums[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in want)).hexdigest()
        assert shown[i] == c.whole.decode(want, skip_special_tokens=False)
        assert sums[i].decoded_sha256 == hashlib.sha256(shown[i].encode()).hexdigest()


def test_files_whose_tokens_cross_white_space_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))


def test_an_index_is_opened_again(spark, tmp_path):
    """Three batches by three openings against one pass over all."""
    rnd = random.Random(12)
    passages = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(6, 16))) for _ in range(6)]
    rows = [(i, " ".join(rnd.choice(passages) if rnd.random() < 0.4 else f"u{rnd.randrange(300)}" for _ in range(12))) for i in range(45)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "index")
    whole = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, window=6, gram=3).collect()}
    for k in range(3):
        index = substring_dedup.FingerprintIndex(spark, 6, 3, fanout=2, path=path)
        assert (index.version > 0) == (k > 0)
        run = index.append(docs.where(F.col("doc_id") % 3 == k))
    again = substring_dedup.FingerprintIndex(spark, 6, 3, fanout=2, path=path)
    assert again.version == index.version and len(again.runs) == 2 and len(again.texts) == 3
    last = docs.where("doc_id % 3 = 2")
    for r in (None, run):
        got = {x.doc_id: (x.n_removed, x.kept_sha256) for x in substring_dedup.remove_repeats(last, again, window=6, gram=3, run=r).collect()}
        assert got == {i: v for i, v in whole.items() if i % 3 == 2}
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, 7, 3, path=path)


def _one_edit(item, own):
    """Whether some words of ``own`` in a row are ``item`` but for one word."""
    n = len(item)
    for a in range(len(own)):
        for m in (n - 1, n, n + 1):
            x = own[a : a + m]
            p = next((i for i, (u, v) in enumerate(zip(item, x)) if u != v), min(n, len(x)))
            if x == item or len(x) == m and item[p + (m <= n) :] == x[p + (m >= n) :]:
                return True
    return False


def test_edits_of_short_items_equal_brute_force(spark):
    rnd = random.Random(11)
    names = ["".join(rnd.choice("bcdfghklmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(900)]
    items = {n: rnd.sample(names, n) for n in range(4, 30)}
    docs = []
    for n, words in items.items():
        for k in range(40):
            own = list(words)
            for _ in range(k % 4):
                at, way = rnd.randrange(len(own)), rnd.randrange(3)
                own[at : at + (way != 1)] = [] if way == 2 else ["zzzz" + rnd.choice("abcd")]
            before, after = ([f"y{c}{rnd.choice('abc')}" for c in "stuvw"[: rnd.randrange(6)]] for _ in range(2))
            docs.append((len(docs), before + own + after))
    want = set()
    for d, own in docs:
        have = {tuple(own[i : i + 8]) for i in range(len(own) - 7)}
        for n, words in items.items():
            windows = [tuple(words[i : i + 8]) for i in range(max(1, n - 7))]
            kept = sum(w in have or n < 8 and any(tuple(own[i : i + n]) == w for i in range(len(own))) for w in windows)
            if 2 * kept >= len(windows) or 9 <= n < 24 and _one_edit(words, own):
                want.add((d, n))
    rows = spark.createDataFrame([(d, " ".join(own)) for d, own in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(words)) for n, words in items.items()], "item_id long, text string")
    for most in (10**6, 0):
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(rows, bench, most=most).collect()} == want


def test_one_changed_word_at_any_place_of_the_benchmark(spark):
    rnd = random.Random(9)
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    docs, asked = [], []
    for r in bench.collect():
        words = r.text.split()
        if len(words) >= 9:
            for at in range(len(words)):
                for way, edited in enumerate(([*words[:at], "other", *words[at + 1 :]], [*words[:at], "more", *words[at:]], [*words[:at], *words[at + 1 :]])):
                    around = ["filler" + rnd.choice("abcdefgh") for _ in range(12)]
                    asked.append((len(docs), r.item_id, len(words), way, 4 * at // len(words)))
                    docs.append((len(docs), " ".join([*around[:6], *edited, *around[6:]])))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    missed, of = {}, {}
    for d, item, n, way, place in asked:
        for group in ((n, way), (place, way)):
            of[group] = of.get(group, 0) + 1
            missed[group] = missed.get(group, 0) + ((d, item) not in got)
    assert all(missed[g] <= 0.1 * of[g] for g in of), {g: (missed[g], of[g]) for g in of if missed[g]}
    print("missed", sum(missed.values()) // 2, "of", len(docs))


def test_numbers_change_beside_one_word_and_ends_at_texts_borders(spark):
    item = "If Tom has 12 apples and 5 pears how many does he have"
    rows = {
        1: item.replace("12", "31").replace("5", "8"), 2: item.replace("12", "31").replace("many", "few"),
        3: item.replace("If Tom", "Since Ann").replace("12", "31").replace("many", "few"), 4: item.rsplit(" ", 1)[0], 5: item.split(" ", 1)[1],
        6: item.replace("has", "buys").replace("does", "can"), 7: item.replace("12", "5"), 8: " ".join(item.split()[:7]),
    }
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    for most in (10**6, 0):
        got = {r.doc_id: r.kind for r in decontaminate.leaks(docs, bench, most=most).collect()}
        assert got == {1: "reparameterised", 2: "reparameterised", 4: "exact", 5: "exact", 7: "exact"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under the MIT License.", {"MIT-name"}), ("Distributed under the MIT License", {"MIT-name"}), ("See the mit LICENSE file", {"MIT-name"}),
        ("# SPDX-License-Identifier: Apache-2.0", {"Apache-2.0-spdx"}), ("// SPDX-License-Identifier: (MIT OR GPL-2.0-or-later) */\nMIT", {"MIT-spdx", "GPL-2.0-or-later-spdx"}),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", {"GPL-2.0-only-spdx"}), ("SPDX-License-Identifier:", set()),
        ("SPDX-License-Identifier:\nMIT", set()), ("Licensed under CC BY 4.0.", {"CC-BY-4.0-name"}), ("CC BY-SA 4.0", {"CC-BY-SA-4.0-name"}),
        ("GNU General Public License v3.0", {"GPL-3.0-name"}), ("under GPLv2 and LGPL-2.1", {"GPL-2.0-name", "LGPL-2.1-name"}),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", {"GPL-2.0-name"}),
        ("                                 Apache License\n                           Version 2.0, January 2004\n", {"Apache-2.0-name"}),
        ("GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007", {"AGPL-3.0-name"}), ("Licensed under CC BY-SA 9.0.", set()),
        ("Released under the MIT License.", {"MIT"}), ("The license of a city such as Apache 2.0", set()), ("MIT has a license", set()),
    ],
)
def test_usual_names_and_tags(text, want):
    for around in (text, f"Some words first.\n{text}\nand then others", f"é {text}"):
        got = licenses.notices(around)
        assert {x[2] for x in got} == want and all(x[3] > 0 for x in got if x[1] - x[0] > 12), (around, got)
        assert all(around[x[0] : x[1]].strip() == around[x[0] : x[1]] for x in got)


def test_names_equal_brute_force():
    rnd = random.Random(6)
    wordings = [(x, k) for k, names in licenses._NAMES.items() for x in names]
    for _ in range(150):
        parts = rnd.sample(wordings, 4)
        text = " so it is here under the license ".join(x for x, _ in parts) + " end"
        have, want = licenses._words(text), []
        i = 0
        while i < len(have):
            fits = [(len(w), k) for x, k in wordings if have[i : i + len(w := licenses._words(x))] == w]
            want += [max(fits)[1]] if fits else []
            i += max(fits)[0] if fits else 1
        got = [x[2].removesuffix("-name") for x in sorted(licenses.notices(text))]
        assert got == want and {k for _, k in parts} <= set(want), text
