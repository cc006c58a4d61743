"""Substring dedup over a log-structured fingerprint index.

Of every window of ``WINDOW`` words the smallest fingerprint among its runs
of ``GRAM`` words is retained, so equal windows retain equal fingerprints
while a text has about 7 for each 100 words. A batch's fingerprints become an
immutable run, one row per fingerprint, sorted, with a text that holds it and
whether it is shared: of two texts, or twice in one. A new run is joined with
the older ones by fingerprint, those of another text are shared as well, and
``fanout`` runs are compacted to one. The index keeps the texts of its batches,
so a batch is verified against history that is not passed again.

Texts are then read again, those of the index too. Windows that retain a shared fingerprint, told by
a Bloom filter of bounded size, are verified by digests of their exact words;
a word goes if a window over it has its words at another start. Windows that
a text itself repeats are settled where the text is read, and each text sends
a digest once, so no digest has more rows than there are texts.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and empty texts have none;
texts with fewer words than a window lose nothing. Repeated rows, also of two
batches, are copies of each other and lose all windows; so do rows that share an identifier only
if their texts match. Null identifiers are allowed, an empty table gives an
empty one, other columns are ignored. Very long texts are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._lookup import BLOOM_BITS, bloom, inside
from ._shared import dropped, exists, scratch, small_batches, stored

WINDOW = 35
GRAM = 8
_U = np.uint64
RUN = "fp long, seq long, many boolean"
_MANIFEST = "version long, window int, gram int, runs array<string>, crossed array<string>, texts array<string>"
#: Batches of the query, more than an index keeps apart.
BATCHES = 5


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` neighbours."""
    n, have = len(x) - width + 1, 1
    if n <= 0:
        return np.empty(0, x.dtype)
    out = x
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[:n], out[width - have : width - have + n]) if have < width else out[:n]


def _retained(w: _text.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs, and what each window start retains (0: no window)."""
    grams = _text.rolling(w.hash, gram)
    least = _sliding(grams, window - gram + 1, np.minimum).copy()
    ends = np.repeat(w.first[1:], np.diff(w.first))[: len(least)]
    least[np.arange(len(least)) + window > ends] = 0
    return grams, least


def _sequences(w: _text.Words) -> np.ndarray:
    """A number for each row's word sequence."""
    out = np.empty(len(w.first) - 1, _U)
    for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
        out[i] = _text.sequence(w.hash[a:b])
    return out


def _fingerprints(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fp", "seq", "many"]
        for batch in batches:
            for w in _text.words(batch.column(0)):
                grams, least = _retained(w, window, gram)
                if not len(least):
                    continue
                pad = np.zeros(window - gram, _U)
                top = _sliding(np.concatenate([pad, least, pad]), window - gram + 1, np.maximum)
                at = np.flatnonzero((top == grams) & (top != 0))
                row = np.searchsorted(w.first, at, "right") - 1
                own = _sequences(w)[row]
                # equal fingerprints of one text become one row
                order = np.lexsort((row, grams[at]))
                fp, r = grams[at][order], row[order]
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (r[1:] != r[:-1])
                first = np.flatnonzero(new)
                again = np.diff(np.append(first, len(fp))) > 1
                own = own[order][first].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[first].view(np.int64)), pa.array(own), pa.array(again)], names=names
                )

    return run


class FingerprintIndex:
    """Sorted immutable runs in a shared folder; ``fanout`` of them are compacted.

    ``path``: where the index lives on and is opened again, by other programs
    too, one writer at a time; without it, it goes with the run's other
    tables. Each change writes its tables first and then one row of the
    manifest, which names the tables that count; what a failed job left
    behind is not in it.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, fanout: int = 4, path: str | None = None):
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        self.path = (path or f"{scratch(spark)}/fingerprint-index-{uuid.uuid4().hex}").rstrip("/")
        self.version = 0
        self.runs: list[DataFrame] = []
        self.crossed: list[DataFrame] = []
        self.texts: list[DataFrame] = []
        if exists(spark, f"{self.path}/manifest"):
            last = spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").orderBy(F.desc("version")).first()
            if (last.window, last.gram) != (window, gram):
                raise ValueError(f"{self.path} has windows of {last.window} words and grams of {last.gram}")
            self.version = last.version
            self.runs, self.crossed, self.texts = (
                [self._open(name, schema) for name in names] for names, schema in ((last.runs, RUN), (last.crossed, "fp long"), (last.texts, "text string"))
            )

    def _open(self, name: str, schema: str) -> DataFrame:
        table = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        table._rowloom_path = f"{self.path}/{name}"
        return table

    def _commit(self) -> None:
        """Write what counts now."""
        self.version += 1
        names = [[t._rowloom_path.rsplit("/", 1)[1] for t in tables] for tables in (self.runs, self.crossed, self.texts)]
        row = self.spark.createDataFrame([(self.version, self.window, self.gram, *names)], _MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def append(self, docs: DataFrame, text_col: str = "text", keep: bool = True) -> DataFrame:
        """Add a batch's run, join it with the older ones, and compact when there are ``fanout`` of these. Returns the run.

        Without ``keep`` its texts are not stored, and must be passed whenever others are verified.
        """
        small_batches(self.spark)
        if len(self.runs) >= self.fanout:
            self.compact()
        texts = docs.select(F.col(text_col).alias("text"))
        if keep:
            texts = stored(texts, "texts", folder=self.path)
            self.texts.append(texts)
        run = self._sorted(self._merged(texts.mapInArrow(_fingerprints(self.window, self.gram), RUN)))
        if self.runs:
            old = self._rows().select(F.col("fp").alias("old_fp"), F.col("seq").alias("old_seq"))
            crossed = run.join(old, (F.col("fp") == F.col("old_fp")) & (F.col("seq") != F.col("old_seq")), "left_semi")
            self.crossed.append(stored(crossed.select("fp"), "crossed", folder=self.path))
        self.runs.append(run)
        self._commit()
        return run

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("fp").agg(F.min("seq").alias("seq"), F.max("seq").alias("last"), F.max("many").alias("many"))
        return found.select("fp", "seq", (F.col("many") | (F.col("seq") != F.col("last"))).alias("many"))

    def _sorted(self, run: DataFrame) -> DataFrame:
        return stored(run.sortWithinPartitions("fp"), "run", folder=self.path)

    def _rows(self) -> DataFrame:
        rows = self.runs[0]
        for r in self.runs[1:]:
            rows = rows.unionByName(r)
        return rows

    def compact(self) -> None:
        """One run instead of all."""
        if len(self.runs) > 1:
            old, self.runs = self.runs, [self._sorted(self._merged(self._rows()))]
            self._commit()
            dropped(*old)

    def matches(self, run: DataFrame) -> DataFrame:
        """Fingerprints of ``run`` that the index holds, by merge join."""
        return run.select("fp").join(self._rows().select("fp"), "fp", "left_semi")

    def shared(self) -> DataFrame:
        """Fingerprints of two texts, or twice in one; some come more than once."""
        rows = self._rows().where("many").select("fp")
        for c in self.crossed:
            rows = rows.unionByName(c)
        return rows


_ROWS = "seq long, n_words long, kept_sha256 string, text string, own array<int>, starts array<int>, digests array<long>"


def _suspects(shared, window: int, gram: int):
    """Per text: its sequence number; its result, or its text and the windows to verify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for w in _text.words(batch.column(1)):
                _, least = _retained(w, window, gram)
                step = np.flatnonzero(np.diff(least, prepend=_U(0)))
                hit = np.zeros(len(least), bool)
                if len(step):
                    ok = (least[step] != 0) & inside(known, least[step])
                    hit[step[0] :] = np.repeat(ok, np.diff(np.append(step, len(least))))
                hits = np.flatnonzero(hit)
                cut = np.searchsorted(hits, w.first)
                for i, seq in enumerate(_sequences(w).view(np.int64)):
                    a, b = w.first[i], w.first[i + 1]
                    own = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
                    line = b" ".join(own.split())
                    starts = hits[cut[i] : cut[i + 1]] - a
                    digests = []
                    if len(starts):
                        size = w.end[a:b] - w.start[a:b]
                        place = np.cumsum(size + 1) - size - 1
                        ends = (place + size)[starts + window - 1].tolist()
                        digests = [blake2b(line[x:y], digest_size=8).digest() for x, y in zip(place[starts].tolist(), ends, strict=True)]
                    once, first, of, n = np.unique(
                        np.frombuffer(b"".join(digests), np.int64), return_index=True, return_inverse=True, return_counts=True
                    )
                    cols[0].append(seq)
                    cols[1].append(b - a)
                    cols[2].append(None if digests else sha256(line).hexdigest())
                    cols[3].append(own.decode() if digests else None)
                    cols[4].append(starts[n[of] > 1].astype(np.int32))
                    cols[5].append(starts[first].astype(np.int32))
                    cols[6].append(once)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *made], names=["doc_id", "seq", "n_words", "kept_sha256", "text", "own", "starts", "digests"]
            )

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, left = [], [], []
            for n, done, text, own, gone, copies in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                if done and not copies:
                    removed.append(0)
                    kept.append(done)
                    left.append(None)
                    continue
                words = [] if copies else text.encode().split()
                starts = np.unique(np.array([*own, *(gone or [])], np.int64))
                if len(starts) and not copies:
                    edge = np.zeros(n + 1, np.int64)
                    edge[starts] += 1
                    edge[starts + window] -= 1
                    words = [x for x, on in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not on]
                line = b" ".join(words)
                removed.append(n - len(words))
                kept.append(sha256(line).hexdigest())
                left.append(line.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept), pa.array(left, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def _windows(rows: DataFrame) -> DataFrame:
    found = rows.where(F.size("starts") > 0).select("seq", F.explode(F.arrays_zip("starts", "digests")).alias("w"))
    return found.select("seq", F.col("w.starts").alias("start"), F.col("w.digests").alias("digest"))


def remove_repeats(
    docs: DataFrame,
    index: FingerprintIndex | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    bloom_bits: int = BLOOM_BITS,
    run: DataFrame | None = None,
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and kept_text where words were removed or checked.

    ``index`` must hold all of ``docs``; what else it holds is history, whose
    repeats ``docs`` lose, too. ``run``: what appending ``docs`` returned;
    history is then read for its fingerprints alone. Without an index, one is
    built batch by batch.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    history: list[DataFrame] = []
    if index is None:
        index = FingerprintIndex(spark, window, gram)
        batch = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES))
        for k in range(BATCHES):
            index.append(docs.where(batch == k), keep=False)
    else:
        history = index.texts
    fps = index.shared()
    if run is not None:
        fps = fps.join(run.select("fp"), "fp", "left_semi")
    shared = spark.sparkContext.broadcast(bloom(stored(fps, "shared-fingerprints"), bloom_bits))
    kind = dict(docs.dtypes)["doc_id"]
    rows = stored(docs.mapInArrow(_suspects(shared, window, gram), f"doc_id {kind}, {_ROWS}"), "substring-rows")
    wide = rows.where(F.col("n_words") >= window)
    counts = wide.groupBy("seq").agg(F.count("*").alias("n"))
    windows = _windows(rows)
    every = windows
    if history:
        # docs are in the index as well: their windows have one place in both, and rows are counted on each side
        past = history[0]
        for t in history[1:]:
            past = past.unionByName(t)
        past = past.select(F.lit(0).alias("doc_id"), "text").mapInArrow(_suspects(shared, window, gram), f"doc_id int, {_ROWS}")
        past = stored(past.select("seq", "n_words", "starts", "digests"), "substring-history")
        counts = counts.unionByName(past.where(F.col("n_words") >= window).groupBy("seq").agg(F.count("*").alias("n")))
        every = windows.unionByName(_windows(past))
    copies = counts.where("n > 1").select("seq", F.lit(True).alias("copies"))
    if history:
        copies = copies.distinct()
    place = F.xxhash64("seq", "start")
    twice = every.groupBy("digest").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("digest")
    gone = windows.join(twice, "digest").groupBy("seq").agg(F.collect_set("start").alias("gone"))
    out = rows.drop("starts", "digests").join(copies, "seq", "left").join(gone, "seq", "left")
    return out.select("doc_id", "n_words", "kept_sha256", "text", "own", "gone", "copies").mapInArrow(
        _cut(window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
