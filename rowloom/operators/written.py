"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Folder of this program's tables, by shared folder.
_runs: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one below the warehouse.

    A warehouse on a local disk serves a local session alone: elsewhere every
    executor would write to its own.
    """
    base = spark.conf.get(_SETTING, None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps"
        local = base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local"
        if local:
            raise ValueError(f"set {_SETTING} to a folder that driver and executors share; {base} is on a local disk")
    return base.rstrip("/")


def _at_exit(spark: SparkSession, base: str) -> None:
    if base in _runs and spark.sparkContext._jsc is not None:  # else the session was stopped before
        _delete(spark, _runs.pop(base))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    base = shared_folder(spark)
    if base not in _runs:
        _runs[base] = f"{base}/rowloom-steps-{uuid.uuid4().hex}"
        atexit.register(_at_exit, spark, base)
    path = f"{_runs[base]}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rowloom_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete :func:`written` tables that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t._rowloom_path)
