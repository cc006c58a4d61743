"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Of tables whose values hardly repeat: no time goes into dictionaries.
PLAIN = {"parquet.enable.dictionary": "false"}
#: Folder of this program's tables, by shared folder.
_runs: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This program's folder for tables, below the one that driver and executors share.

    That is the folder named by ``spark.checkpoint.dir``; where it is unset,
    ``_scratch`` in the warehouse. What is left in it goes when the program
    ends, or with :func:`release`.
    """
    base = (spark.conf.get(_SETTING, None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")
    if base not in _runs:
        _runs[base] = f"{base}/rowloom-{uuid.uuid4().hex}"
        atexit.register(_at_exit, spark, base)
    return _runs[base]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete all tables of this program; results that still read them must be written before."""
    for path in _runs.values():
        _delete(spark, path)
    _runs.clear()


def _at_exit(spark: SparkSession, base: str) -> None:
    context = spark.sparkContext
    if base in _runs and context._jsc is not None:  # else the session was stopped before
        _delete(spark, _runs.pop(base))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def stored(df: DataFrame, name: str, batch: int | None = None, folder: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Later stages read files that survive the loss of an executor, and nothing
    above is computed twice. The shuffle files of this one query go when it
    is written. ``batch``: rows of an Arrow batch in it; ``folder``: another
    shared folder, whose tables stay; ``options``: of the writer.
    """
    spark = df.sparkSession
    path = f"{folder or scratch(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = {_CLEANUP: "true", **({_BATCH: str(batch)} if batch else {})}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._rowloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete :func:`stored` tables that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t._rowloom_path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch holds, so that Python workers stay small; a lower bound of the caller's stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, str(rows))
