"""Raw windows, catalog search and versioned tables."""

import random

import pytest
from pyspark.sql import functions as F

from rowloom.sources import catalog, windows
from rowloom.sources.versions import VersionedTable


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Rows 0..299 in eleven files of uneven size; position equals id."""
    path = str(tmp_path_factory.mktemp("many") / "t.parquet")
    cuts = [0, 1, 1, 40, 41, 90, 150, 151, 152, 200, 299, 300]
    file = sum((F.col("id") >= c).cast("int") for c in cuts[1:])
    df = spark.range(0, 300, 1, 1).withColumn("file", file)
    for n, k in enumerate(sorted(r[0] for r in df.select("file").distinct().collect())):
        df.where(F.col("file") == k).coalesce(1).write.mode("append").parquet(f"{path}/n={n:02d}")
    return path


def test_positions_of_many_files(spark, many):
    rows = windows.positioned(spark, many)
    assert rows.count() == 300 and rows.where("position <> id").count() == 0


@pytest.mark.parametrize("offset,limit", [(0, 5), (0, None), (39, 3), (41, 49), (150, 1), (299, 4), (300, 4), (7, 0), (0, 10_000), (152, 48)])
@pytest.mark.parametrize("modulo", [1, 3])
def test_windows_of_many_files(spark, many, offset, limit, modulo):
    want = [i for i in range(offset, 300) if i % modulo == 0][: limit if limit is not None else 300]
    rows, facts = windows.raw_window(spark, many, offset, limit, F.col("id") % modulo == 0)
    assert sorted(r.position for r in rows.collect()) == want == sorted(r.id for r in rows.collect())
    full = limit is not None and len(want) == limit
    assert facts["exhausted"] is not full and facts["accepted"] == len(want)
    assert facts["processed"] == ((want[-1] + 1 - offset if want else 0) if full else max(0, 300 - offset))


def test_a_window_opens_no_other_files(spark, many):
    rows, _ = windows.raw_window(spark, many, 160, 20)
    assert len(rows.inputFiles()) >= 1
    read = rows.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) == 1


def test_null_is_not_accepted_and_blocks_are_counted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(windows, "_BLOCK", 8)
    path = str(tmp_path / "one.parquet")
    spark.range(0, 200, 1, 1).withColumn("x", F.when(F.col("id") % 2 == 0, F.col("id"))).write.parquet(path)
    rows, facts = windows.raw_window(spark, path, 5, 30, F.col("x") > 20)
    assert sorted(r.id for r in rows.collect()) == list(range(22, 82, 2)) and facts["processed"] == 81 - 5


def _found(entries, query, limit):
    words = lambda t: {w for w in "".join(c if c.isalnum() and c.isascii() else " " for c in t.lower()).split()}
    tokens = query.strip().lower().split()
    keys = [t for t in tokens if t not in catalog.STOP_WORDS and len(t) > 1]
    variants = [query]
    if len(keys) >= 2:
        variants.append(" ".join(keys))
    if len(keys) >= 3:
        variants += [" ".join(keys[:2]), " ".join(keys[-2:])]
    asked = [(v, limit if i == 0 else max(1, limit // 2)) for i, v in enumerate(dict.fromkeys(variants))]
    out = []
    for v, most in asked:
        hits = [n for n, t in entries if words(v) and words(v) <= words(t)][:most]
        out += hits
        if (v == query and hits) or len(out) >= limit:
            break
    return list(dict.fromkeys(out))[:limit]


def test_search_with_variants(spark):
    rng = random.Random(5)
    vocabulary = ["math", "easy", "hard", "code", "logic", "geo", "data", "the"]
    entries = [(f"e{i:03d}", " ".join(["data", *rng.sample(vocabulary, 3)]) + ("-x" if i % 7 == 0 else "")) for i in range(80)]
    queries = [(i, " ".join(rng.sample([*vocabulary, "nothing", "of", "a"], rng.randint(1, 5)))) for i in range(40)] + [(90, ""), (91, "  "), (92, None), (93, "a of")]
    got = {}
    table = spark.createDataFrame([(n, i, t) for i, (n, t) in enumerate(entries)], "name string, position int, text string")
    for r in catalog.search(table, spark.createDataFrame(queries, "query_id int, query string"), 6).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.name)
    assert got == {q: f for q, t in queries if t is not None and (f := _found(entries, t, 6))}


def test_versions_commit_whole_or_not_at_all(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "state"))
    with pytest.raises(LookupError):
        table.read()
    ids = lambda df: sorted(r.id for r in df.collect())
    table.commit(spark.range(3), 1)
    bad = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        table.commit(bad, 2)
    assert ids(table.read()) == [0, 1, 2] and [v["round_id"] for v in table.versions()] == [1]
    table.commit(spark.range(5), 2)
    table.commit(spark.range(6), 4)
    assert ids(table.read(3)) == list(range(5)) and ids(table.read()) == list(range(6))
    table.restore(1)
    assert ids(table.read()) == [0, 1, 2] and [v["version"] for v in table.versions()] == [1, 2, 3, 4]
    gone = table.clean(keep=2)
    assert len(gone) >= 1 and ids(table.read()) == [0, 1, 2] and ids(table.read(4)) == list(range(6))
    with pytest.raises(LookupError):
        table.read(0)


def test_two_writers_cannot_take_one_version(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "state"))
    table.commit(spark.range(1), 1)
    monkeypatch.setattr(VersionedTable, "versions", lambda self: [])
    with pytest.raises(RuntimeError):
        table.commit(spark.range(2), 1)
    monkeypatch.undo()
    assert table.read().count() == 1
