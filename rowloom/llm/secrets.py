"""Secret scans over an incremental ledger of blobs.

Every version of a file is content-addressed by the SHA-256 of its text. The
ledger has one row per (blob, rule version); only pairs that it lacks are
scanned, once however many paths hold the blob, and findings are joined back
to all paths. A blob may have most of the paths: copies are put together before
they are looked up, and rows are dealt over ``SALTS`` keys to meet their
findings, which are repeated for each. A text without any of the rules' trigger strings cannot match;
it enters the ledger with no findings, and its text is not moved.

Spans are code point places, end exclusive. Null texts count as empty, which
have no findings. Equal rows get equal findings; an empty table gives an
empty ledger; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches, stored

RULE_VERSION = "2"
# The patterns, by kind in their order. Group 2 of assign has 6
# characters or more; the whole match of access 20 and of hex 24.
PATTERNS = {
    "assign": r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "forge": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
#: Join keys over which the paths of one blob are dealt.
SALTS = 32
BASE_KINDS = ("assign", "access", "hex")
_LEAST = {"assign": 6, "access": 20, "hex": 24}
_TRIGGER = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
    r"|-----BEGIN |gh[pousr]_[A-Za-z0-9]|eyJ[A-Za-z0-9_-]{8}"
)
_SPANS = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"blob string, rule_version string, spans {_SPANS}"
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
_COMPILED["hex"] = re.compile(r"[0-9a-f]{24,}")  # the runs are maximal either way


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by the order of kinds."""
    out = []
    for k, (kind, pattern) in enumerate(_COMPILED.items()):
        group = 2 if kind == "assign" else 0
        for m in pattern.finditer(text):
            if len(m[group]) >= _LEAST.get(kind, 0):
                out.append((m.start(), k, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in f.body]
        yield pd.DataFrame({"blob": f.blob, "spans": spans})


def scan_versions(
    versions: DataFrame, ledger: DataFrame | None = None, path_col: str = "path", text_col: str = "text", rule_version: str = RULE_VERSION
) -> tuple[DataFrame, DataFrame]:
    """Findings of every row, and the ledger's new entries.

    The first has the path column, ``blob`` and ``spans``, one row per input
    row. The second has :data:`LEDGER` rows for the pairs that ``ledger``
    lacked; append them to it.
    """
    spark = versions.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(text_col), F.lit(""))
    paths = stored(
        versions.select(
            F.col(path_col).alias("path"), F.sha2(body, 256).alias("blob"), F.when(body.rlike(_TRIGGER), body).alias("body")
        ),
        "secret-versions",
    )
    known = ledger if ledger is not None else spark.createDataFrame([], LEDGER)
    known = known.where(F.col("rule_version") == rule_version).select("blob", "spans")
    texts = paths.where(F.col("body").isNotNull()).select("blob", "body").dropDuplicates(["blob"])
    scanned = texts.join(known, "blob", "left_anti").mapInPandas(_scan, f"blob string, spans {_SPANS}")
    entries = (
        paths.select("blob").distinct().join(known, "blob", "left_anti").join(scanned, "blob", "left")
        .select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))
    )
    entries = stored(entries, "secret-ledger")
    findings = known.unionByName(entries.select("blob", "spans")).where(F.size("spans") > 0)
    findings = findings.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = paths.select("path", "blob", (F.monotonically_increasing_id() % SALTS).cast("int").alias("salt"))
    found = dealt.join(findings, ["blob", "salt"], "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))
    return found.select(F.col("path").alias(path_col), "blob", "spans"), entries


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(text: Column, spans: Column) -> Column:
    """:func:`redacted` as an expression."""
    places = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("a"), s["end"].cast("int").alias("b"))))

    def step(done: Column, s: Column) -> Column:
        more = F.concat(done["out"], F.substring(text, done["at"] + 1, s["a"] - done["at"]), F.lit("<secret>"))
        return F.struct(F.when(s["a"] >= done["at"], more).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["b"]).alias("at"))

    begun = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(places, begun, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redacted(text: str, spans) -> str:
    """``text`` with every span, overlaps united, replaced by ``<secret>``."""
    out, at = [], 0
    for _, start, end in sorted(((s["kind"], s["start"], s["end"]) for s in spans), key=lambda s: s[1:]):
        if start >= at:
            out += [text[at:start], "<secret>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
