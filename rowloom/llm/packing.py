"""Best-fit packing of whole documents into token sequences: best-two-fit over a histogram of lengths.

Every document becomes its token ids and an end id. A document over the
capacity is cut into pieces of that many tokens, of which the first takes the
remainder; all others stay whole. How pieces fit together depends on lengths
alone, and there are no more lengths than the capacity. So executors encode,
the driver packs a histogram of at most ``capacity`` counts, and executors
deal the pieces, numbered within their length, to the places of that plan.

The plan fills a sequence greedily, the longest piece that fits next, then
replaces its shortest piece by two unpacked ones that fit the freed room more
tightly, while that helps. The same filling is repeated as often as the counts
allow; each repeat takes at least one length to below what the filling holds
of it, so there are a few fillings a length, whatever the number of documents.

Null and empty texts are one end id. Very long texts become many pieces.
Rows are independent of each other, repeated rows and ids are packed as often as they come,
null ids stay null; equal lengths go by place in the table. An empty table gives
an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

CAPACITY = 2048
END = 0
_MEMO = 400_000
_WORD = 64  # bytes; longer chunks are not kept in the memo
#: Pre-tokens of byte-level BPE (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank between white space and white space or the end: no place to cut a text.
_ODD = re.compile(r"\s \s|\s \Z")
_PROBES = ("a b", " a", "a ", "one  two\t\tthree\n\n four\x0b5 \n x", "don't stop, we'll 12,34", "été 日本 　x  y", "")


class ByteCodec:
    """Ids of a byte-level BPE file of the tokenizers library.

    Pre-tokens of such files never hold a blank but in front, so a text is cut
    before its blanks and each distinct chunk is encoded once while the memo
    has room. Chunks are merged by tiktoken, whose ranks are the file's ids; a
    file where that does not hold, or a text with an added token, goes whole
    through the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.fast = self._ranked(spec)
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        if self.fast and any(self.text(p) != self._library(p) for p in _PROBES):
            self.fast = None

    def _ranked(self, spec: dict):
        model, steps = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or steps != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return None
        if spec.get("normalizer") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            return None
        import tiktoken

        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if sorted(model["vocab"][m] for m in merged) != [model["vocab"][m] for m in merged]:
            return None
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.special}
        return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _library(self, text: str) -> bytes:
        return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)

    def _learn(self, words: set[bytes]) -> None:
        """Put chunks into the memo; when it is full, those not used since it last was full go."""
        need = words.difference(self.ids)
        if len(self.ids) + len(need) > _MEMO // 2:
            self.ids, self.old, need = {}, self.ids, words
        for w in need:
            known = self.old.get(w)
            self.ids[w] = self._bytes(self.fast.encode_ordinary(" " + w.decode())) if known is None else known

    def text(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not self.fast or any(s in text for s in self.special):
            return self._library(text)
        if _ODD.search(text):
            return self._bytes(self.fast.encode_ordinary(text))
        first, *words = text.encode().split(b" ")
        if any(len(w) > _WORD for w in words):
            long = {w: self._bytes(self.fast.encode_ordinary(" " + w.decode())) for w in words if len(w) > _WORD}
            self._learn({w for w in words if w not in long})
            rest = b"".join(long[w] if w in long else self.ids[w] for w in words)
        else:
            try:
                rest = b"".join(map(self.ids.__getitem__, words))
            except KeyError:
                self._learn(set(words))
                rest = b"".join(map(self.ids.__getitem__, words))
        return self._bytes(self.fast.encode_ordinary(first.decode())) + rest


@lru_cache(maxsize=2)
def codec(path: str) -> ByteCodec:
    return ByteCodec(path)


def _places(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Number of each value among equal ones, carried on in ``seen``."""
    order = np.argsort(lengths, kind="stable")
    kinds, starts, counts = np.unique(lengths[order], return_index=True, return_counts=True)
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(lengths)) - np.repeat(starts, counts) + np.repeat(seen[kinds], counts)
    seen[kinds] += counts
    return out


def _cut(path: str, capacity: int, end: int, with_ids: bool):
    """Pieces of texts, each with its number among those of its length in this task."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, seen = codec(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = c.text(text or "") + last
                n = len(ids) // 4
                at, to = 0, n % capacity or capacity
                for k in range(-(-n // capacity)):
                    own = ids[4 * at : 4 * to]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        kept.append(own)
                    at, to = to, to + capacity
            place = _places(np.array(length, np.int64), seen)
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, [part] * len(row), place))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        c.ids, c.old = {}, {}  # the worker lives on for other tasks

    return run


@dataclass
class Plan:
    """Where the pieces of each length go.

    Segment i holds ``count`` pieces of a length from number ``first`` on; the
    next ``each`` of them go to the next sequence, from ``sequence`` on, at
    ``offset`` and behind each other. Segments are in order of (length, first).
    """

    length: np.ndarray
    first: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and number."""
        at = np.zeros(len(length), np.int64)
        for size in np.unique(length):
            lo, hi = np.searchsorted(self.length, [size, size + 1])
            own = np.flatnonzero(length == size)
            at[own] = lo + np.searchsorted(self.first[lo:hi], number[own], "right") - 1
        behind = number - self.first[at]
        return self.sequence[at] + behind // self.each[at], self.offset[at] + behind % self.each[at] * length


def _pair(left: np.ndarray, low: int, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths of greatest sum over ``low`` and up to ``room``."""
    a = np.flatnonzero(left[: room + 1])
    if not len(a):
        return None
    j = np.searchsorted(a, np.minimum(room - a, a), "right") - 1
    twice = (j >= 0) & (a[j] == a) & (left[a] < 2)
    j[twice] -= 1
    total = np.where(j >= 0, a + a[j], 0)
    best = int(np.argmax(total))
    return (int(a[best]), int(a[j[best]])) if total[best] > low else None


def _filling(left: np.ndarray, capacity: int) -> dict[int, int]:
    """What the next sequence holds: copies by length. ``left`` loses them."""
    held: dict[int, int] = {}
    gap = capacity
    while gap:
        fits = np.flatnonzero(left[: gap + 1])
        if not len(fits):
            break
        size = int(fits[-1])
        n = min(int(left[size]), gap // size)
        held[size] = held.get(size, 0) + n
        left[size] -= n
        gap -= n * size
    while gap and sum(held.values()) > 1:
        least = min(held)
        pair = _pair(left, least, gap + least)
        if pair is None:
            break
        held[least] -= 1
        left[least] += 1
        if not held[least]:
            del held[least]
        for size in pair:
            held[size] = held.get(size, 0) + 1
            left[size] -= 1
        gap += least - sum(pair)
    return held


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of so many pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    used, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    while left.any():
        before = left.copy()
        held = _filling(left, capacity)
        times = min(int(before[s]) // n for s, n in held.items())
        offset = 0
        for size in sorted(held, reverse=True):
            n = held[size]
            rows.append((size, used[size], times * n, sequence, n, offset))
            used[size] += times * n
            left[size] = before[size] - times * n
            offset += n * size
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return Plan(*table.T, sequences=sequence)


def _deal(plan: Plan, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for b in batches:
            length, number = (b.column(k).to_numpy(zero_copy_only=False) for k in ("length", "number"))
            places = [pa.array(x, pa.int64()) for x in plan.of(length, number)]
            ids = [b.column("ids")] if with_ids else []
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *places, *ids], names=[*names, "sequence_id", "offset", *["ids"] * with_ids])

    return run


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; its ``ids`` (little-endian 32 bits) if wanted.

    Pieces are numbered within their length by task, then by the counts of
    the tasks before, so no task sees all pieces of a length. What is sent to
    all tasks has a row for each length of a filling: its size is bounded by
    the capacity.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    ids = ", ids binary" if with_ids else ""
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = stored(rows.mapInArrow(_cut(path, capacity, end, with_ids), f"{schema}, part long, place long{ids}"), "pieces", batch=512)
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    plan = best_two_fit({r.length: r.n for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    numbered = pieces.join(starts.select("length", "part", "before"), ["length", "part"]).withColumn("number", F.col("before") + F.col("place"))
    wanted = [c.split()[0] for c in schema.replace(f"doc_id {kind}", "doc_id").split(", ")]
    return numbered.select(*wanted, "number", *["ids"] * with_ids).mapInArrow(_deal(plan, with_ids), f"{schema}, sequence_id long, offset long{ids}")


def sequences(packed: DataFrame) -> DataFrame:
    """Training sequences of :func:`pack` with ids: sequence_id, n_tokens, ids, and the pieces in order.

    A sequence is no longer than the capacity, so its group is bounded.
    """
    own = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(own.alias("own"))
    joined = F.aggregate("own", F.lit(b""), lambda out, x: F.concat(out, x["ids"]))
    parts = F.transform("own", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length")))
    return rows.select("sequence_id", (F.length(joined) / 4).cast("long").alias("n_tokens"), joined.alias("ids"), parts.alias("pieces"))
