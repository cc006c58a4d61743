"""Every registered query against its SQL on the smallest tables."""

import pytest

from conftest import canonical
from rowloom.plans import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_matches_sql(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(oracle.ORACLE[name]).df()
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE)))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() >= 0


def test_entry_is_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert set(df.columns) == {"split", "module", "n"}
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_imported_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; from pyspark import SparkContext; assert e.queries() and e.oracle_sql() and SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
