"""BPE encoding and decoding of whole texts, long unsplit text by tree concatenation.

The tokenizer file is one of the tokenizers library. Its pre-tokens must never
cross white space, which is checked on :data:`PROBES` when it is loaded, and a
file that does otherwise is refused; so the words of a text are encoded apart
and their tokens put together. Words of up to ``LONG`` bytes go through the library, each
distinct word once per task while the memo has room.

A text with a longer word is cut into units that are encoded as rows of their
own. A pre-token over ``SEGMENT`` symbols becomes many segments; neighbours
are then joined pairwise, level by level. At a join the tokens nearest to it
are encoded anew as one string, twice as many each time, until the pair of
tokens at each edge of the window is one that the merges leave alone. A token
sequence all of whose neighbouring pairs are left alone is the encoding of
the whole string, so the result is exact.

Null and empty texts have no tokens and decode to the empty text. Rows are
independent of each other: repeated rows get equal results, an empty table
gives an empty one, other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import small_batches, stored

LONG = 1 << 10
SEGMENT = 1 << 8
_MEMO = 300_000
#: Texts whose words must encode alike together and apart.
PROBES = ("a b", " a", "a ", "one  two\t\tthree\n\nfour\x0b5", "don't stop , . 's 12 34", "\u00e9t\u00e9 \u65e5\u672c \u3000x", "A <b> c")


class Codec:
    """One tokenizer file: memoised words, raw merges, and joins of token runs."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.last = self.whole.model
        self._inner, self._path = None, path
        self.name = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        # " token" of each id: the decoded text is its tokens, joined by blanks, where the file has no decoder
        self.shown = [(" " + self.name.get(i, "")).encode() for i in range(max(self.name) + 1)]
        steps = spec.get("normalizer") or {}
        self.lowers = any(n.get("type") == "Lowercase" for n in [steps, *steps.get("normalizers", [])]) and all(
            "<" in t for t in special
        )
        self.plain = self.whole.decoder is None
        for probe in PROBES:
            apart = [i for w in probe.encode().split() for i in self.whole.encode(w.decode(), add_special_tokens=False).ids]
            if self.whole.encode(probe, add_special_tokens=False).ids != apart:
                raise ValueError(f"{path}: tokens cross white space ({probe!r}); this operator needs a file whose words are encoded apart")
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Put words into the memo; when it is full, those not used since it last was full go."""
        need = words.difference(self.ids)
        if len(self.ids) + len(need) > _MEMO // 2:
            self.ids, self.old, need = {}, self.ids, words
        new = []
        for w in need:
            known = self.old.get(w)
            if known is None:
                new.append(w)
            else:
                self.ids[w] = known
        for w, e in zip(new, self.whole.encode_batch([w.decode() for w in new], add_special_tokens=False), strict=True):
            ids = array("I", e.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            self.ids[w] = ids.tobytes()

    def fold(self, text: bytes) -> bytes:
        """``text`` with A-Z lower-cased, if the file does so anyway and no special token can come of it."""
        return text.lower() if self.lowers and b"<" not in text else text

    def decoded(self, ids: bytes) -> bytes:
        """The decoded text of ids as bytes."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.plain:
            return b"".join(map(self.shown.__getitem__, numbers))[1:]
        return self.decode(numbers).encode() if numbers else b""

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids, skip_special_tokens=False)

    @property
    def inner(self):
        """Merges of symbols that do not end a word; made where a text first needs them."""
        if self._inner is None:
            from tokenizers.models import BPE

            model = json.load(open(self._path, encoding="utf-8"))["model"]
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            self._inner = BPE(vocab=model["vocab"], merges=merges)
        return self._inner

    def merge(self, text: str, final: bool) -> list[int]:
        """Tokens of symbols; ``final``: the last one ends its word."""
        return [t.id for t in (self.last if final else self.inner).tokenize(text)] if text else []

    def _text(self, ids: list[int], final: bool) -> str:
        text = "".join(map(self.name.__getitem__, ids))
        return text.removesuffix(self.suffix) if final and self.suffix else text

    def _stays(self, a: int, b: int, final: bool) -> bool:
        return self.merge(self._text([a, b], final), final) == [a, b]

    def join(self, left: list[int], right: list[int], final: bool) -> list[int]:
        """The encoding of both runs' text. ``final``: the right one ends its word."""
        if not left or not right:
            return left + right
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            rest_l, rest_r = left[: len(left) - len(a)], right[len(b) :]
            ends = final and not rest_r
            new = self.merge(self._text(a + b, ends), ends)
            if (not rest_l or self._stays(rest_l[-1], new[0], ends and len(new) == 1)) and (
                not rest_r or self._stays(new[-1], rest_r[0], final and len(rest_r) == 1)
            ):
                return rest_l + new + rest_r
            k *= 2

    def pieces(self, word: str) -> Iterator[tuple[str, str]]:
        """A long word as (kind, text): ``text`` for the library, ``symbols`` for merges."""
        for part in self.special.split(word) if self.special else [word]:
            if self.special and self.special.fullmatch(part):
                yield "text", part
            elif part:
                clean = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                for symbols, _ in self.whole.pre_tokenizer.pre_tokenize_str(clean):
                    yield "symbols", symbols


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _first_pass(path: str, long: int, whole: bool):
    """Results of texts whose words are all short, ids if ``whole``, else digests; the other texts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, own, n = codec(path), uuid.uuid4().hex, 0
        names, types = _FIRST[whole]
        for batch in batches:
            raw, offsets = _text.buffers(batch.column(1))
            data = raw.tobytes()
            rows: list[tuple] = []
            at = 0
            while at < len(offsets) - 1:  # about CHUNK bytes at a time
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _text.CHUNK, "right")) - 1)
                texts = [c.fold(data[offsets[i] : offsets[i + 1]]).split() for i in range(at, to)]
                over = {i for i, ws in enumerate(texts) if ws and max(map(len, ws)) > long}
                c.learn(set().union(*(ws for i, ws in enumerate(texts) if i not in over)))
                for i, ws in enumerate(texts):
                    if i in over:
                        n += 1
                        rows.append((f"{own}-{n}", data[offsets[at + i] : offsets[at + i + 1]].decode(), *[None] * (len(names) - 3)))
                        continue
                    ids = b"".join(map(c.ids.__getitem__, ws))
                    if whole:
                        rows.append((None, None, np.frombuffer(ids, "<u4").astype(np.int32)))
                    else:
                        rows.append((None, None, len(ids) // 4, sha256(ids).hexdigest(), sha256(c.decoded(ids)).hexdigest()))
                at = to
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(cols, types, strict=True))], names=names)
        c.ids, c.old = {}, {}  # the worker lives on for other tasks

    return run


_FIRST = {
    True: (["doc_id", "uid", "text", "ids"], [pa.string(), pa.string(), pa.list_(pa.int32())]),
    False: (
        ["doc_id", "uid", "text", "n_tokens", "ids_sha256", "decoded_sha256"],
        [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()],
    ),
}
_UNIT = "uid string, unit long, seg long, segs long, kind string, body string"


def _units(path: str, long: int, segment: int):
    """Ordered units of texts with long words; a long pre-token is cut into segments."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for frame in frames:
            for uid, text in zip(frame.uid, frame.text, strict=True):
                out, plain, size = [], [], 0

                def flush(uid=uid, out=out, plain=plain):
                    if plain:
                        out.append((uid, 0, 0, 1, "text", " ".join(plain)))
                        plain.clear()

                for word in text.encode().split():
                    if len(word) <= long:
                        plain.append(word.decode())
                        size += len(word)
                        if size > 4 * long:
                            flush()
                            size = 0
                        continue
                    flush()
                    for kind, body in c.pieces(word.decode()):
                        parts = [body[i : i + segment] for i in range(0, len(body), segment)] if kind == "symbols" else [body]
                        out += [(uid, 0, k, len(parts), kind, p) for k, p in enumerate(parts)]
                flush()
                made = pd.DataFrame(out, columns=["uid", "unit", "seg", "segs", "kind", "body"])
                made["unit"] = (made.seg == 0).cumsum()
                yield made

    return run


def _encode_units(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for f in frames:
            ids = [
                c.whole.encode(b, add_special_tokens=False).ids if k == "text" else c.merge(b, s == n - 1)
                for k, b, s, n in zip(f.kind, f.body, f.seg, f.segs, strict=True)
            ]
            yield f[["uid", "unit", "seg", "segs"]].assign(ids=ids)

    return run


def _join_pair(path: str):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seg")
        ids = [int(x) for x in f.ids.iloc[0]]
        if len(f) == 2:
            final = int(f.seg.iloc[1]) == int(f.segs.iloc[1]) - 1
            ids = codec(path).join(ids, [int(x) for x in f.ids.iloc[1]], final)
        out = f.iloc[:1][["uid", "unit", "seg", "segs"]]
        return out.assign(seg=out.seg // 2, segs=(out.segs + 1) // 2, ids=[ids])

    return run


def _whole_text(path: str, whole: bool):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids = [int(i) for x in f.sort_values("unit").ids for i in x]
        if whole:
            return pd.DataFrame({"uid": [f.uid.iloc[0]], "ids": [ids]})
        shown = codec(path).decode(ids).encode() if ids else b""
        raw = np.array(ids, "<u4").tobytes()
        return pd.DataFrame(
            {"uid": [f.uid.iloc[0]], "n_tokens": [len(ids)], "ids_sha256": [sha256(raw).hexdigest()], "decoded_sha256": [sha256(shown).hexdigest()]}
        )

    return run


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_IDS = "ids array<int>"


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, long: int, segment: int, whole: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = _IDS if whole else _DIGESTS
    first = rows.mapInArrow(_first_pass(path, long, whole), f"doc_id {dict(rows.dtypes)['doc_id']}, uid string, text string, {schema}")
    first = stored(first, "bpe")
    out = [c.split()[0] for c in schema.split(", ")]
    short = first.where(F.col("uid").isNull()).select("doc_id", *out)
    rest = first.where(F.col("uid").isNotNull())
    parts = encode_long(rest.select("uid", "text"), path, long, segment)
    empty = sha256(b"").hexdigest()  # texts of Unicode white space alone have no units
    blank = [F.array().cast("array<int>")] if whole else [F.lit(0).cast("long"), F.lit(empty), F.lit(empty)]
    if parts is None:
        return short.unionByName(rest.select("doc_id", *[b.alias(c) for b, c in zip(blank, out, strict=True)]))
    results = parts.groupBy("uid").applyInPandas(_whole_text(path, whole), f"uid string, {schema}")
    joined = rest.select("doc_id", "uid").join(results, "uid", "left")
    return short.unionByName(joined.select("doc_id", *[F.coalesce(c, b).alias(c) for b, c in zip(blank, out, strict=True)]))


def digests(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, segment: int = SEGMENT
) -> DataFrame:
    """Per row: doc_id, n_tokens, and hashes of ids (little-endian 32 bits) and decoded text; ids are not moved."""
    return _encoded(docs, path, id_col, text_col, long, segment, False)


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, segment: int = SEGMENT
) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row; empty for null texts."""
    return _encoded(docs, path, id_col, text_col, long, segment, True)


def encode_long(rest: DataFrame, path: str, long: int = LONG, segment: int = SEGMENT) -> DataFrame | None:
    """Token ids of (uid, text) rows with long words, as rows (uid, unit, ids); None without rows."""
    units = stored(rest.mapInPandas(_units(path, long, segment), _UNIT), "bpe-units")
    most = units.agg(F.max("segs")).first()[0]
    if most is None:
        return None
    n = max(2, int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "uid string, unit long, seg long, segs long, ids array<int>"
    parts = units.repartition(n, "uid", "unit", "seg").mapInPandas(_encode_units(path), schema)
    done = []
    while most > 1:  # each level halves the number of segments
        parts = stored(parts, "bpe-level")
        done.append(parts.where("segs = 1"))
        parts = parts.where("segs > 1").withColumn("pair", F.expr("seg div 2"))
        parts = parts.groupBy("uid", "unit", "pair").applyInPandas(_join_pair(path), schema)
        most = (most + 1) // 2
    for d in done:
        parts = parts.unionByName(d)
    return parts


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids), special tokens included."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for f in frames:
            yield f[["doc_id"]].assign(text=[c.decode([int(i) for i in x]) if x is not None and len(x) else "" for x in f.ids])

    return tokens.select("doc_id", "ids").mapInPandas(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")
