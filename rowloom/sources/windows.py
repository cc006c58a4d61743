"""Windows of raw rows: positions from the files' own row numbers, without an index column and without a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File tables up to this size are sent to all tasks.
MOST_SENT = 100_000
_BLOCK = 1 << 16


def _located(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def file_counts(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(file, rows, rows of the files before) of a Parquet table, by name; as long as the list of files, which the driver has anyhow."""
    counts = sorted((r[0], r[1]) for r in _located(spark, path).groupBy("_file").count().collect())
    out, before = [], 0
    for name, n in counts:
        out.append((name, n, before))
        before += n
    return out


def _placed(rows: DataFrame, files: list[tuple[str, int, int]], column: str) -> DataFrame:
    starts = rows.sparkSession.createDataFrame([(name, before) for name, _, before in files], "_file string, _before long")
    if len(files) <= MOST_SENT:
        starts = F.broadcast(starts)
    return rows.join(starts, "_file").withColumn(column, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def positioned(spark: SparkSession, path: str, column: str = "position") -> DataFrame:
    """All rows of a Parquet table with their position, from 0, by file name and row in it."""
    return _placed(_located(spark, path), file_counts(spark, path), column)


def raw_window(
    spark: SparkSession, path: str, offset: int = 0, limit: int | None = None, accept: Column | None = None, dataset: str = "", split: str = "", column: str = "position"
) -> tuple[DataFrame, dict]:
    """Rows from raw position ``offset`` on that ``accept`` holds for, ``limit`` of them at most; and facts of the window.

    The offset counts raw rows, the limit accepted ones. Files before the
    offset are not opened; from there on files are counted a few at a time,
    twice as many each time, until they hold enough. The last row is found in
    its file by counts of blocks. Null is not accepted. The facts tell how
    many raw rows were ``processed`` and whether the table ended first.
    """
    accept = F.coalesce(accept, F.lit(False)) if accept is not None else F.lit(True)
    files = [f for f in file_counts(spark, path) if f[2] + f[1] > offset]
    total = files[-1][2] + files[-1][1] if files else 0
    located = _located(spark, path)
    part = lambda names: located.where(F.col("_file").isin(names)).where(accept)  # noqa: E731  other files are not opened
    behind = lambda f: F.col("_row") >= max(0, offset - f[2])

    chosen, got, at, step, end = [], 0, 0, 1, total
    while at < len(files) and (limit is None or got < limit):
        some = files[at : at + step]
        first = (F.col("_file") != some[0][0]) | behind(some[0]) if at == 0 else F.lit(True)
        counts = {r[0]: r[1] for r in part([f[0] for f in some]).where(first).groupBy("_file").count().collect()}
        for f in some:
            n = counts.get(f[0], 0)
            chosen.append(f)
            if limit is not None and got + n >= limit:
                end = f[2] + _nth(part([f[0]]).where(behind(f)), limit - got) + 1 if limit > got else f[2]
                got = limit
                break
            got += n
        at, step = at + step, step * 2
    if limit == 0:
        chosen, end = files[:1], offset
    rows = _placed(part([f[0] for f in chosen]), chosen or [("", 0, 0)], column).where((F.col(column) >= offset) & (F.col(column) < end))
    facts = {"window_id": f"{dataset}:{split}:{offset}:{limit}", "offset": offset, "limit": limit, "accepted": got, "processed": max(0, end - offset), "exhausted": limit is None or got < limit}
    return rows, facts


def _nth(rows: DataFrame, n: int) -> int:
    """The row number of the n-th of ``rows`` of one file."""
    before = 0
    for block, k in sorted((r[0], r[1]) for r in rows.groupBy(F.floor(F.col("_row") / _BLOCK).alias("b")).count().collect()):
        if before + k >= n:
            own = rows.where((F.col("_row") >= block * _BLOCK) & (F.col("_row") < (block + 1) * _BLOCK))
            return own.select("_row").orderBy("_row").offset(n - before - 1).first()[0]
        before += k
    raise ValueError("fewer rows than asked for")
