"""Quality scores by kernel ridge regression on document statistics.

``STATISTICS`` of each text are taken in one pass over its bytes. Random
Fourier features approximate a Gaussian kernel over them; tasks sum the
normal equations of their rows, sums meet by their place in the matrix, and
the driver solves a system of fixed size. Isotonic regression over a fixed
number of score bins turns the ridge scores into probabilities. All labelled
rows are used; nothing grows with them on the driver.

Null and empty texts have statistics of zero and get a score like others.
Labels that are null are left out. Without labels all scores are 0.5. Rows
are judged one by one: repeated rows get equal results, an empty table gives
an empty one, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import small_batches, stored

FEATURES = 192
BINS = 500
WIDTH = 4.0
RIDGE = 1e-3


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_KINDS = {
    "upper": _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": _bytes("abcdefghijklmnopqrstuvwxyz"),
    "digit": _bytes("0123456789"),
    "symbol": _bytes("#*$%&|<>"),
    "loud": _bytes("!?"),
    "stop": _bytes(".,;:"),
    "other_mark": _bytes("\"'()[]{}/\\@^_`~+=-"),
    "line": _bytes("\n"),
}
_BEYOND = np.arange(256) >= 0x80
STATISTICS = (
    *_KINDS, "beyond_ascii", "words", "word_length", "short_words", "long_words", "capital_words", "ended_words",
    "marked_words", "distinct_words", "distinct_runs", "distinct_lines", "words_a_line",
)


def _of(w: _text.Words) -> np.ndarray:
    """Statistics of each row."""
    rows = len(w.first) - 1
    out = np.zeros((rows, len(STATISTICS)))
    size = np.maximum(np.diff(w.offsets), 1)

    def share(on: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(on)])
        return (total[w.offsets[1:]] - total[w.offsets[:-1]]) / size

    for i, table in enumerate([*_KINDS.values(), _BEYOND]):
        out[:, i] = share(table[w.data])
    n = np.diff(w.first)
    many = np.maximum(n, 1)

    def mean(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return (total[w.first[1:]] - total[w.first[:-1]]) / many

    length, at = w.end - w.start, len(_KINDS) + 1
    last = w.data[w.end - 1] if len(w.end) else w.data[:0]
    out[:, at] = np.log1p(n)
    out[:, at + 1] = mean(length)
    out[:, at + 2] = mean(length <= 3)
    out[:, at + 3] = mean(length > 15)
    out[:, at + 4] = mean(_KINDS["upper"][w.data[w.start]]) if len(w.start) else 0
    out[:, at + 5] = mean(_KINDS["stop"][last])
    out[:, at + 6] = mean(_KINDS["symbol"][last] | _KINDS["loud"][last])
    runs = _text.rolling(w.hash, 3)
    breaks = np.flatnonzero(w.data == 10)
    lines = np.searchsorted(breaks, w.start)
    for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
        if b == a:
            continue
        out[i, at + 7] = len(np.unique(w.hash[a:b])) / (b - a)
        out[i, at + 8] = len(np.unique(runs[a : b - 2])) / (b - a - 2) if b - a > 2 else 1.0
        first = np.flatnonzero(np.diff(lines[a:b], prepend=-1))
        sums = np.add.reduceat(w.hash[a:b] * (np.arange(a, b) - np.repeat(first, np.diff(np.append(first, b - a))) - a + 1).astype(np.uint64), first)
        out[i, at + 9] = len(np.unique(sums)) / len(first)
        out[i, at + 10] = np.log1p((b - a) / len(first))
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [_of(w) for w in _text.words(batch.column(1))]
        x = np.concatenate(got) if got else np.empty((0, len(STATISTICS)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in x.T)], names=["doc_id", *STATISTICS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATISTICS of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = ", ".join(f"{c} double" for c in STATISTICS)
    return rows.mapInArrow(_measure, f"doc_id {dict(rows.dtypes)['doc_id']}, {kinds}")


@dataclass
class Model:
    """Scaling, Fourier weights, ridge coefficients and the calibration's corners."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    ridge: np.ndarray
    at: np.ndarray
    to: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.weights + self.shift), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.at, self.to), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(first, first + len(STATISTICS))], 1)


def _equations(model):
    """A task's sums of the upper triangle of Z'Z, Z'y beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.value.features(_matrix(batch, 1))
            total += z.T @ np.hstack([z, batch.column(0).to_numpy()[:, None]])
        i, j = np.triu_indices(FEATURES + 1, 0, FEATURES + 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"]
        )

    return run


def _raw(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.value.raw(_matrix(batch, 1)))], names=batch.schema.names[:1] + ["raw"]
            )

    return run


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to means ``y`` of weights ``n``."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, n, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, k = blocks.pop()
            u = blocks[-1]
            blocks[-1] = [(u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + k]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(measured: DataFrame, labels: DataFrame, seed: int = 5, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learn from ``labels`` (doc_id, 0 or 1) of rows of ``measured``."""
    spark = measured.sparkSession
    d, rng = len(STATISTICS), np.random.default_rng(seed)
    marks = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    rows = stored(measured.join(marks, "doc_id").select("y", *STATISTICS), "quality-training")
    got = rows.agg(F.count("*"), *[F.avg(c) for c in STATISTICS], *[F.stddev_pop(c) for c in STATISTICS]).first()
    n = got[0]
    if not n:
        zero = np.zeros(d)
        return Model(zero, zero + 1, np.zeros((d, FEATURES)), np.zeros(FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    spread = np.array(got[1 + d :], float)
    model = Model(
        np.array(got[1 : 1 + d], float), np.where(spread > 1e-9, spread, 1.0), rng.normal(size=(d, FEATURES)) / WIDTH,
        rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.empty(0), np.empty(0),
    )
    parts = rows.mapInArrow(_equations(spark.sparkContext.broadcast(model)), "i int, j int, v double")
    sums = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    a = np.zeros((FEATURES + 1, FEATURES + 2))
    a[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("v").to_numpy()
    gram = np.triu(a[:, :-1]) + np.triu(a[:, :-1], 1).T
    model.ridge = np.linalg.solve(gram + RIDGE * n / FEATURES * np.eye(FEATURES + 1), a[:, -1])
    raw = rows.mapInArrow(_raw(spark.sparkContext.broadcast(model)), "y double, raw double")
    place = F.floor(F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) * BINS)
    bins = raw.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("raw").alias("raw")).orderBy("b").toArrow()
    model.at = bins.column("raw").to_numpy()
    model.to = isotonic(bins.column("y").to_numpy(), bins.column("n").to_numpy())
    return model


def score(measured: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every measured row."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probability(shared.value.raw(_matrix(batch, 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return measured.select("doc_id", *STATISTICS).mapInArrow(run, f"doc_id {dict(measured.dtypes)['doc_id']}, score double")


def score_documents(docs: DataFrame, labels: DataFrame, learn_from: object = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measure all rows, learn from labelled ones for which ``learn_from`` holds, score all."""
    measured = stored(statistics(docs, id_col, text_col), "quality-statistics")
    marks = labels if learn_from is None else labels.where(learn_from)
    return score(measured, fit(measured, marks))
