"""Benchmark decontamination by canonical templates.

Words lose punctuation and case, then numbers, units after numbers and names
(capitalised words inside a sentence) become typed placeholders. Windows of
``WINDOW`` template words of documents are hash-joined with those of the
benchmark. The windows that join, laid along one alignment of a document and
an item, must cover enough of the item; then the placeholders' words are
compared. Every window is joined by its words as well, whatever their case;
where more than half are placeholders only so, and tables of numbers join
with themselves alone. All this is done twice: with every word on its own, and
with runs of equal placeholders as one and sentence openers as names if they
are names elsewhere in the text. Alignments are windows on one shift between
document and item, and those on shifts at most a reach apart, as when words
are put in or left out; the reach is a window or a quarter of the item. An alignment is consistent if equal words of the item stand for
equal words of the document, as in a question with its numbers or names
exchanged; windows whose placeholders stand for themselves are also taken
alone.

Items of ``EDITED`` to ``3 * WINDOW - 1`` template words have too few windows to
lose those around a changed word. Their first and last ``n`` words, ``n`` by
``_half``, are windows of their own: one word replaced, put in or left out
leaves one of the two whole. Where it joins, the rest of the item is laid
along the words before or after it in the document, which the hit carries, and
must agree but for one word. Longer items keep half of their windows around
one changed word.

The benchmark is sent to the executors only while its windows number at most
``MOST``; they drop document windows that cannot join. Beyond that all
document windows are joined by shuffles. Items with fewer template words than
a window are one window of their own length; those with fewer than
``LEAST_WORDS`` stand in ordinary texts by chance, and are found only in
documents that have no other words.

Null and empty texts have no windows and are clean. Repeated rows get equal
results; rows that share an identifier share a verdict, so do null
identifiers. Very long texts are read whole; ties of alignments do not matter,
as the best covered counts give one row. An empty benchmark leaves all clean; an empty table gives an
empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._lookup import HashIndex
from ._shared import small_batches, stored

WINDOW = 8
#: Share of an item's windows that one alignment must hold.
COVERED = 0.5
MOST = 1_000_000
LEAST_WORDS = 4
#: Items of this many template words or more are found with any one word changed.
EDITED = 9
_U = np.uint64

# Units that follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles g kg mg lb lbs oz ton tons l ml gal gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit volt volts watt watts"
).split()

_PLAIN = np.zeros(256, np.uint8)  # 0: not part of a word's form
for _b in range(0x21, 0x100):
    if _b >= 0x80 or chr(_b).isalnum():
        _PLAIN[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63, 58, 59]] = True  # ! . ? : ;
_TAGS = _text.mix(np.array([1, 2, 3], _U))  # number, unit, name
NUMBER, UNIT, NAME = 1, 2, 3


class _Templates:
    """Template words of some rows, empty forms left out."""

    def __init__(self, w: _text.Words, folded: bool = False):
        data = w.data
        kept = _PLAIN[data]
        second = np.zeros(len(data), bool)  # after 0xC3: capitals of Latin-1
        second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        kept[second] += 0x20
        solid = kept > 0
        place = np.zeros(len(data) + 1, np.int64)
        np.cumsum(solid, out=place[1:])
        value = kept[solid].astype(_U) + _U(1)
        sums = np.zeros(len(value) + 1, _U)
        np.cumsum(value * _text.powers(_text._BASE, len(value)), out=sums[1:])
        a, b = place[w.start], place[w.end]
        plain = _text.mix((sums[b] - sums[a]) * _text.powers(_text._INVERSE, len(sums))[a] + (b - a).astype(_U) * _U(0xD6E8FEB86659FD93))
        digits = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_DIGIT[data], out=digits[1:])
        number = digits[w.end] > digits[w.start]
        lead = np.flatnonzero(solid)[np.minimum(a, max(0, len(value) - 1))] if len(value) else a
        capital = np.zeros(len(a), bool)
        if len(value):
            c, end = data[lead], len(data) - 1
            latin = (c == 0xC3) & second[np.minimum(lead + 1, end)]
            then = data[np.minimum(lead + np.where(latin, 2, 1), end)]  # words all in capitals are none
            capital = (((c >= 65) & (c <= 90)) | latin) & (((then >= 97) & (then <= 122)) | (then >= 0x80))
        stop = _STOP[data[w.end - 1]] if len(a) else np.zeros(0, bool)
        opens = np.ones(len(a), bool)  # a sentence's or text's first word
        opens[1:] = stop[:-1]
        opens[w.first[:-1][w.first[:-1] < len(a)]] = True
        opens[np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(data == 10), w.start), prepend=0) > 0)] = True
        after = np.zeros(len(a), bool)
        after[1:] = number[:-1]
        after[w.first[:-1][w.first[:-1] < len(a)]] = False
        kind = np.zeros(len(a), np.int8)
        kind[capital & ~opens] = NAME
        row = np.searchsorted(w.first, np.arange(len(a)), "right") - 1
        if folded:  # openers that are names elsewhere in their text
            own = _text.mix(plain + row.astype(_U) * _U(_text._BASE))
            kind[capital & opens & (HashIndex(np.unique(own[kind == NAME])).get(own) >= 0)] = NAME
        if after.any():
            kind[after & (_units().get(plain) >= 0)] = UNIT
        kind[number] = NUMBER
        full = b > a
        self.word = np.flatnonzero(full)
        self.plain, self.kind = plain[full], kind[full]
        if folded and len(self.word):
            r, k = row[full], self.kind
            head = np.ones(len(k), bool)
            head[1:] = (k[1:] == 0) | (k[1:] != k[:-1]) | (r[1:] != r[:-1])
            at = np.flatnonzero(head)
            size = np.diff(np.append(at, len(k)))
            place = np.arange(len(k)) - np.repeat(at, size)
            whole = np.add.reduceat(self.plain * _text.powers(_text._BASE, int(size.max()))[place], at)
            self.plain = np.where(size > 1, _text.mix(whole), self.plain[at])  # a run stands for all its words
            self.kind, self.word = k[at], self.word[at]
        self.hash = np.where(self.kind > 0, _TAGS[np.maximum(self.kind - 1, 0)], self.plain)
        self.first = np.searchsorted(self.word, w.first)


def _units() -> HashIndex:
    global _unit_index
    if _unit_index is None:
        (w,) = _text.words(pa.array([" ".join(UNITS)]))
        _unit_index = HashIndex(np.unique(_Templates(w).plain))
    return _unit_index


_unit_index: HashIndex | None = None


def _keys(t: _Templates, a: int, b: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the windows of ``n`` words from a to b: of the words, and of the template.

    The second is the first again where placeholders are none or more than half.
    """
    typed = np.concatenate([[0], np.cumsum(t.kind[a:b] > 0)])
    many = 2 * (typed[n:] - typed[:-n]) > n
    words = _text.rolling(t.plain[a:b], n)
    return words, np.where(many, words, _text.rolling(t.hash[a:b], n))


#: Keys of either form are told apart by these.
_FORMS = ((False, _U(0)), (True, _U(0x5851F42D4C957F2D)))


#: Keys of an item's windows, of its first and of its last words are told apart by these.
_SIDES = np.array([0, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], _U)
_HALVES = (WINDOW // 2, WINDOW * 3 // 4, WINDOW)


def _half(n: int) -> int:
    """Words at each end of an item of ``n`` that are joined alone; 0 if its windows bear a changed word, or none does."""
    return max((h for h in _HALVES if 2 * h <= n), default=0) if EDITED <= n < 3 * WINDOW else 0


#: Words that an end's hit carries, one more than the rest of the longest item with such ends.
_REST = {h: max(n for n in range(EDITED, 3 * WINDOW) if _half(n) == h) - h + 1 for h in _HALVES}

_HIT = "key long, at int, of int, slots array<long>, next_hash array<long>, next_plain array<long>"


def _lists(parts: list[np.ndarray | None]) -> pa.ListArray:
    full = [p for p in parts if p is not None]
    ends = np.cumsum([0, *[0 if p is None else len(p) for p in parts]])
    flat = np.concatenate(full) if full else np.empty(0, np.int64)
    none = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()), mask=none)


def _hits(window: int, known: np.ndarray | None, lengths: tuple[int, ...], ends: np.ndarray | None, halves: tuple[int, ...]):
    """Windows of documents: key, place, and the words that they stand for.

    Those that may be an item's first or last words once more for each side,
    with the words after or before them, outward.
    """
    index = HashIndex(known) if known is not None else None
    outer = HashIndex(ends) if ends is not None else None
    sizes = sorted({window, *lengths, *halves})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, keys, at, of, slots, near = batch.column(0), [], [], [], [], [], []
            for w in _text.words(batch.column(1)):
                for t, salt, n in ((t, salt, n) for t, salt in ((_Templates(w, f), salt) for f, salt in _FORMS) for n in sizes):
                    if len(t.hash) < n:
                        continue
                    words, typed = (k ^ salt for k in _keys(t, 0, len(t.hash), n))
                    stop = np.repeat(t.first[1:], np.diff(t.first))[: len(words)]
                    inside = np.arange(len(words)) + n <= stop
                    for key, ok in ((words, inside), (typed, inside & (typed != words))):
                        if index is not None:
                            ok = ok & (index.get(key) >= 0)
                        found = np.flatnonzero(ok)
                        for side in range(3):
                            if side == 0 and n not in lengths and n != window or side and n not in halves:
                                continue
                            own = found if not side or outer is None else found[outer.get(key[found]) >= 0]
                            row = np.searchsorted(t.first, own, "right") - 1
                            rows.append(w.row + row)
                            keys.append((key[own] ^ _SIDES[side]).view(np.int64))
                            at.append((own - t.first[row]).astype(np.int32))
                            of.append(np.diff(t.first)[row].astype(np.int32))
                            slots += [t.plain[p : p + n].view(np.int64) for p in own]
                            for p, r in zip(own.tolist(), row.tolist(), strict=True):
                                if side == 1:
                                    near.append((t, slice(p + n, min(p + n + _REST[n], int(t.first[r + 1]))), 1))
                                elif side == 2:
                                    near.append((t, slice(max(p - _REST[n], int(t.first[r])), p), -1))
                                else:
                                    near.append(None)
            row = np.concatenate(rows) if rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(row)),
                    pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)),
                    pa.array(np.concatenate(at) if at else np.empty(0, np.int32)),
                    pa.array(np.concatenate(of) if of else np.empty(0, np.int32)),
                    _lists(slots),
                    _lists([x and x[0].hash[x[1]][:: x[2]].view(np.int64) for x in near]),
                    _lists([x and x[0].plain[x[1]][:: x[2]].view(np.int64) for x in near]),
                ],
                names=["doc_id", "key", "at", "of", "slots", "next_hash", "next_plain"],
            )

    return run


def _items(window: int):
    """All windows of benchmark items, with kinds of their words and the item's number of windows; the ends of some with the rest, outward."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for w in _text.words(batch.column(1)):
                for t, salt, i in ((t, salt, i) for t, salt in ((_Templates(w, f), salt) for f, salt in _FORMS) for i in range(len(t.first) - 1)):
                    a, b = int(t.first[i]), int(t.first[i + 1])
                    n = min(window, b - a)
                    if not n:
                        continue
                    for p, (k1, k2) in enumerate(zip(*((k ^ salt).view(np.int64).tolist() for k in _keys(t, a, b, n)), strict=True)):
                        words, kinds = t.plain[a + p : a + p + n].view(np.int64).tolist(), t.kind[a + p : a + p + n].tolist()
                        rows += [(w.row + i, key, bool(salt), p, b - a - n + 1, words, kinds, 0, None, None, None) for key in {k1, k2}]
                    h = _half(b - a) if window == WINDOW else 0
                    for side, x, rest in ((1, a, slice(a + h, b)), (2, b - h, slice(a, b - h))) if h else ():
                        out = [c[rest][:: 3 - 2 * side] for c in (t.hash.view(np.int64), t.plain.view(np.int64), t.kind)]
                        words, kinds = t.plain[x : x + h].view(np.int64).tolist(), t.kind[x : x + h].tolist()
                        for key in {int((k ^ salt ^ _SIDES[side]).view(np.int64)[0]) for k in _keys(t, x, x + h, h)}:
                            rows.append((w.row + i, key, bool(salt), 0, 1, words, kinds, side, *(c.tolist() for c in out)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 11
            longs, bytes_ = pa.list_(pa.int64()), pa.list_(pa.int8())
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), longs, bytes_, pa.int32(), longs, longs, bytes_]
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            names = ["item_id", "key", "folded", "at", "windows", "words", "kinds", "side", "rest_hash", "rest_plain", "rest_kinds"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(made[0]), *made[1:]], names=names)

    return run


#: Lanes of windows are 0 to 2; then those of ends: as it stands, one word replaced, left out, put in; by templates, by words.
_LANES = [(3 + 4 * typed + way, typed, way) for typed in (0, 1) for way in range(4)]


def _get(name: str, i) -> Column:
    return F.get(name, i)


def _agreeing(typed: int, step: int) -> Column:
    """Whether each word of an item's rest agrees with the document's at the same place plus ``step``."""

    def same(i):
        equal = _get("rest_plain", i) == _get("next_plain", i + step)
        return F.coalesce(equal | (_get("rest_hash", i) == _get("next_hash", i + step)) if typed else equal, F.lit(False))

    return F.transform(F.sequence(F.lit(0), F.size("rest_plain") - 1), same)


def _ends(joined: DataFrame) -> DataFrame:
    """Lanes in which the rest of an end's item agrees with the document but for one word; ``p0`` and ``p1``: words before that."""
    m = F.size("rest_plain")
    out = joined
    for typed in (0, 1):
        for step in (-1, 0, 1):
            out = out.withColumn(f"e{typed}{step + 1}", _agreeing(typed, step))
        out = out.withColumn(f"p{typed}", F.when(F.forall(f"e{typed}1", lambda x: x), m).otherwise(F.array_position(f"e{typed}1", F.lit(False)).cast("int") - 1))
    lanes = []
    for lane, typed, way in _LANES:
        p = F.col(f"p{typed}")
        step, start = ((1, p), (1, p + 1), (0, p + 1), (2, p))[way]
        tail = F.forall(F.slice(f"e{typed}{step}", start + 1, m), lambda x: x)
        agrees = (p == m) if way == 0 else (p < m) & tail
        whole = F.size("words") + m
        share = F.lit(1.0) if way in (0, 3) else (whole - 1) / whole
        lanes.append(F.when(agrees, F.struct(F.lit(lane).alias("lane"), (F.col("shift") * 2 + F.col("side")).cast("long").alias("band"), share.alias("share"))))
    return out.withColumn("ends", F.filter(F.array(*lanes), lambda x: x.isNotNull()))


def _rest_pairs() -> Column:
    """Placeholders of an end's rest in lane ``b.lane``: kind, item's word, document's word; the changed word aside."""
    lane = F.col("b.lane")
    way, p = F.pmod(lane - 3, F.lit(4)), F.when(lane < 7, F.col("p0")).otherwise(F.col("p1"))
    step = F.when(way == 2, -1).when(way == 3, 1).otherwise(0)

    def pair(i):
        there = i + F.when(i < p, 0).otherwise(step)
        return F.struct(_get("rest_kinds", i).alias("k"), _get("rest_plain", i).alias("a"), F.when((i != p) | (way == 3), _get("next_plain", there)).alias("b"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size("rest_plain") - 1), pair), lambda s: (s["k"] > 0) & s["b"].isNotNull())


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    covered: float = COVERED,
    most: int = MOST,
) -> DataFrame:
    """Rows (doc_id, item_id, n_windows, covered, slots_equal, kind) of documents that hold an item.

    ``kind`` is ``exact`` if all placeholders stand for the item's own words,
    else ``reparameterised``. Alignments with inconsistent placeholders are
    no leaks. ``covered`` is the share of an item's windows on one alignment,
    or of its words where its ends were joined.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).alias("item_id"), F.col("text").alias("item_text"))
    kind = dict(docs.dtypes)["doc_id"]
    own = stored(
        bench.mapInArrow(
            _items(window),
            f"item_id {dict(bench.dtypes)['item_id']}, key long, folded boolean, at int, windows int, words array<long>, kinds array<byte>, "
            "side int, rest_hash array<long>, rest_plain array<long>, rest_kinds array<byte>",
        ),
        "benchmark-windows",
    )
    sizes = [(r.side > 0, r.n) for r in own.select("side", F.size("words").alias("n")).distinct().collect()]  # 8 and 2 lengths at most
    short = tuple({n for end, n in sizes if not end and n < window})
    halves = tuple({n for end, n in sizes if end})
    known = ends = None
    if own.count() <= most:
        keys = own.select("key", "side").distinct().toArrow()
        side = keys.column("side").to_numpy()
        plain = keys.column("key").to_numpy().view(_U) ^ _SIDES[side]
        known, ends = np.unique(plain), np.unique(plain[side > 0])
    hits = docs.mapInArrow(_hits(window, known, short, ends, halves), f"doc_id {kind}, {_HIT}")
    hits = hits.select("doc_id", "key", F.col("at").alias("doc_at"), "of", "slots", "next_hash", "next_plain")
    joined = hits.join(own, "key").where((F.size("words") >= LEAST_WORDS) | (F.col("of") == F.size("words"))).withColumn("shift", F.col("doc_at") - F.col("at"))
    # The item's word and the document's, at every placeholder, by kind.
    pairs = F.filter(
        F.transform("kinds", lambda k, i: F.struct(k.alias("k"), F.get("words", i).alias("a"), F.get("slots", i).alias("b"))),
        lambda s: s["k"] > 0,
    )
    # Bands of shifts: one alone, and wider ones that overlap, so that shifts a reach apart share one; also without changed placeholders.
    band = F.floor(F.col("shift") / F.greatest(F.lit(window), F.floor(F.col("windows") / 4)))
    share = F.lit(None).cast("double").alias("share")
    bands = [F.struct(F.lit(lane).alias("lane"), F.lit(x).cast("long").alias("band"), share) for lane, x in ((0, F.col("shift")), (1, band), (1, band - 1), (2, band), (2, band - 1))]
    equal = F.forall("pairs", lambda s: s["a"] == s["b"])
    lanes = F.when(F.col("side") > 0, F.col("ends")).when(equal, F.array(*bands)).otherwise(F.array(*bands[:3]))
    placed = _ends(joined.withColumn("pairs", pairs)).withColumn("b", F.explode(lanes))
    placed = placed.withColumn("pairs", F.when(F.col("side") > 0, F.concat("pairs", _rest_pairs())).otherwise(F.col("pairs")))
    lines = placed.groupBy("doc_id", "item_id", "folded", "windows", "b.lane", "b.band").agg(
        F.count_distinct("at").alias("n_windows"), F.max("b.share").alias("share"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("slots")
    )
    lines = lines.where(F.col("n_windows") >= F.ceil(F.col("windows") * covered))
    firsts = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["k"], s["a"]))))
    consistent = lines.where(firsts == F.size("slots"))
    same = F.forall("slots", lambda s: s["a"] == s["b"])
    found = consistent.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").cast("long").alias("n_windows"),
        F.max(F.coalesce("share", F.col("n_windows") / F.col("windows"))).alias("covered"),
        F.coalesce(F.max(F.when(F.col("lane") != 2, same)), F.lit(True)).alias("slots_equal"),
    )
    return found.withColumn("kind", F.when(F.col("slots_equal"), "exact").otherwise("reparameterised"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns as before."""
    bad = leaks(docs, benchmark, id_col=id_col, **more).select(F.col("doc_id").alias("_leaking")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_leaking"]), "left_anti")
