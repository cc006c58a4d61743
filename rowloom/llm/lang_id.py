"""Language identification by prediction by partial matching over bytes.

Texts are lower-cased (A-Z and Latin-1 letters). ASCII words with a digit are
blanked, since they are of no language, and in other words the digits, since
scripts without spaces have long ones; blanks after blanks cost nothing.
Each language has a context tree of orders 0 to ``ORDER`` over UTF-8 bytes,
kept as counts of runs of ``ORDER + 1`` bytes; those of lower orders are
their sums. A byte costs log2((n + q) / c) bits in the longest context that
knows it, after log2((n + q) / q) bits for every longer known context that
must be escaped from (n: bytes seen there, q: distinct ones, c: this one);
below order 0 every byte costs 8 bits. Statistics are frozen after training,
so a text's code length is a sum over its bytes, looked up in tables.

Training takes at most about ``PER_LANG`` rows of each language, chosen by a
hash, whole texts. Rows without language or text teach nothing.

Very long texts are read in pieces. Null texts and texts without a letter are ``und`` with score 0, as is all
text when nothing was learned. Ties go to the first language by name. Rows
are judged one by one: repeated rows get equal results, an empty table gives
an empty one, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._lookup import HashIndex
from ._shared import small_batches

ORDER = 3
PER_LANG = 800
_PAD = 10  # a text is preceded by line feeds


def byte_runs(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For every byte, it and the ``order`` bytes before it in its text, as one number."""
    key = data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for j in range(1, order + 1):
        back = np.full(len(data), _PAD, np.uint64)
        back[j:] = data[: max(0, len(data) - j)]
        back[place < j] = _PAD
        key |= back << np.uint64(8 * j)
    return key


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row numbers from and to, and those rows' canonical bytes."""
    for w in _text.words(column, _text.LOWER):
        data = w.data
        if len(data):
            data[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 0x20
            digit = (data >= 48) & (data <= 57)
            digits, beyond = (np.concatenate([[0], np.cumsum(x)]) for x in (digit, data >= 0x80))
            marked = np.flatnonzero((digits[w.end] > digits[w.start]) & (beyond[w.end] == beyond[w.start]))
            edge = np.zeros(len(data) + 1, np.int8)
            edge[w.start[marked]] += 1
            edge[w.end[marked]] -= 1
            data[(np.cumsum(edge[:-1]) > 0) | digit] = 32
        yield w.row, w.row + len(w.first) - 1, data, w.offsets


def _counted(data: np.ndarray) -> np.ndarray:
    """Bytes that cost: all but blanks after blanks."""
    out = np.ones(len(data), bool)
    out[1:] = (data[1:] != 32) | (data[:-1] != 32)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for at, to, data, offsets in _chunks(batch.column(1)):
            keys, who = byte_runs(data, offsets), np.repeat(langs[at:to], np.diff(offsets))
            keys, who = keys[_counted(data)], who[_counted(data)]
            for lang in set(langs[at:to]):
                key, n = np.unique(keys[who == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n)], names=["lang", "run", "n"]
                )


class ByteTables:
    """Bits of every byte after its context, for several models at once.

    A known run costs ``own``; any other costs the escape from its context, if
    that is known, and what it costs one order below.
    """

    def __init__(self, order: int, columns: int):
        self.order, self.columns = order, columns
        self.index: list[HashIndex | None] = []
        self.cost: list[np.ndarray] = []
        self.escape: list[tuple[HashIndex, np.ndarray] | None] = []

    def add(self, cells: np.ndarray, known: np.ndarray, own: np.ndarray, contexts: np.ndarray, of: np.ndarray, escape: np.ndarray) -> None:
        """The next order's runs: bits where ``known``, context and bits to escape from it."""
        order = len(self.cost)
        if order == 0:
            cost = np.full((256, self.columns), 8.0) + (escape[0] if len(contexts) else 0)
            at = cells.astype(int)
            cost[at] = np.where(known, own, cost[at])
            self.index.append(None)
            self.escape.append(None)
        else:
            cost = np.where(known, own, escape[of] + self.lookup(cells, order - 1))
            self.index.append(HashIndex(cells))
            self.escape.append((HashIndex(contexts), escape.astype(np.float32)))
        self.cost.append(cost.astype(np.float32))

    def lookup(self, keys: np.ndarray, order: int | None = None) -> np.ndarray:
        """Bits of any runs, a column for each model."""
        order = self.order if order is None else order
        keys = keys & np.uint64((1 << 8 * (order + 1)) - 1)
        if order == 0:
            return self.cost[0][keys.astype(int)]
        if not len(self.cost[order]):
            return self.lookup(keys, order - 1)
        at = self.index[order].get(keys)
        out = self.cost[order][at]
        lost = np.flatnonzero(at < 0)
        if len(lost):
            index, escape = self.escape[order]
            context = index.get(keys[lost] >> np.uint64(8))
            out[lost] = self.lookup(keys[lost], order - 1) + np.where((context >= 0)[:, None], escape[context], np.float32(0))
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray, counted: np.ndarray | None = None) -> np.ndarray:
        """Code length of each text under each model; ``counted``: bytes that cost."""
        out = np.zeros((len(offsets) - 1, self.columns))
        full = np.flatnonzero(np.diff(offsets))
        for a in range(0, len(data), _text.CHUNK):  # a very long text comes in pieces
            b, lead = min(len(data), a + _text.CHUNK), min(a, self.order)
            own = np.clip(offsets, a - lead, b) - (a - lead)
            cost = self.lookup(byte_runs(data[a - lead : b], own, self.order))[lead:]
            if counted is not None:
                cost[~counted[a:b]] = 0
            inside = full[(offsets[full] < b) & (offsets[full + 1] > a)]
            out[inside] += np.add.reduceat(cost, np.maximum(offsets[inside] - a, 0), axis=0, dtype=np.float64)
        return out


class Model(ByteTables):
    """Frozen code lengths of all languages, from counts of runs."""

    def __init__(self, langs: list[str], lang: np.ndarray, run: np.ndarray, n: np.ndarray):
        super().__init__(ORDER, len(langs))
        self.langs = langs
        for order in range(ORDER + 1):
            keys = run & np.uint64((1 << 8 * (order + 1)) - 1)
            cells, place = np.unique(keys, return_inverse=True)
            c = np.zeros((len(cells), len(langs)))
            np.add.at(c, (place, lang), n)
            contexts, of = np.unique(cells >> np.uint64(8), return_inverse=True)
            total, kinds = (np.zeros((len(contexts), len(langs))) for _ in range(2))
            np.add.at(total, of, c)
            np.add.at(kinds, of, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
                own = np.where(c > 0, np.log2((total + kinds)[of] / c), 0.0)
            self.add(cells, c > 0, own, contexts, of, escape)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG) -> Model:
    """Count a bounded sample of each language's rows; the tables come to the driver.

    Their size is bounded by ``per_lang`` texts of each language.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.empty(0, int), np.empty(0, np.uint64), np.empty(0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, per_lang / sizes[k]) * 2**32))])
    chance = F.xxhash64(F.lit("lang_id"), F.col(id_col)).bitwiseAND(F.lit(2**32 - 1))
    sample = rows.where(chance <= share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = sample.mapInArrow(_count, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    name = {k: i for i, k in enumerate(langs)}
    lang = np.array([name[x] for x in got.column("lang").to_pylist()], int)
    return Model(langs, lang, got.column("run").to_numpy().astype(np.uint64), got.column("n").to_numpy().astype(float))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (share of the best language), bits_per_byte (null without words)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            pred, score, per = ["und"] * n, np.zeros(n), np.full(n, np.nan)
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            for at, to, data, offsets in _chunks(batch.column(1)) if m.langs else ():
                counted = _counted(data)
                bits = m.bits(data, offsets, counted)
                sizes = np.concatenate([[0], np.cumsum(counted & (data != 32))])
                sizes = sizes[offsets[1:]] - sizes[offsets[:-1]]
                best = bits.argmin(axis=1)
                low = bits[np.arange(to - at), best]
                share = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
                for i in np.flatnonzero(letters[at:to]):
                    pred[at + i], score[at + i] = m.langs[best[i]], share[i]
                    per[at + i] = low[i] / sizes[i] if sizes[i] else np.nan
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred), pa.array(score), pa.array(per, from_pandas=True)],
                names=["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("has_letter"),
    )
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, bits_per_byte double")
