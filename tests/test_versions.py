"""Versions kept by range, and write detection that reads the old table once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowledger.operators import capture
from rowledger.sources.scope import KEYLESS, PRIMARY, TableScope

KEYED = TableScope("t", ("id",), PRIMARY)
BAG = TableScope("t", (), KEYLESS)
SHAPE = "id long, name string, x double, tags map<string,int>"


def rows_of(seed, n=400):
    r = random.Random(seed)
    return [(i, r.choice(["a", "b", None]), r.choice([0.5, None, float("nan")]), r.choice([None, {}, {"k": 1}, {"k": 1, "j": 2}])) for i in range(n)]


def shown(d):
    return sorted(str(r) for r in d.select("kind", F.to_json("before"), F.to_json("after"), "changed_columns", "key_token").collect())


@pytest.mark.parametrize(("scope", "width", "most"), [(KEYED, 10, 10_000), (KEYED, None, 10_000), (BAG, None, 10_000), (KEYED, 10, 1), (BAG, None, 1)])
def test_diff_reads_ranges_that_differ(spark, tmp_path, monkeypatch, scope, width, most):
    monkeypatch.setattr(capture, "MOST_RANGES", most)
    old = rows_of(1)
    new = [r if 40 <= r[0] < 390 else (r[0], "changed", *r[2:]) for r in old if r[0] not in (3, 45)] + [(1000, "new", 1.0, None), (None, "no id", 1.0, None)] + ([] if scope.keys else [old[50], old[50]])
    a, b = spark.createDataFrame(old, SHAPE), spark.createDataFrame(new, SHAPE)
    for name, d in (("old", a), ("new", b)):
        capture.write_version(d, f"{tmp_path}/{name}", scope, 32, width)
    got = capture.diff_versions(spark, f"{tmp_path}/old", f"{tmp_path}/new", scope)
    plain = capture.snapshot_diff(a, b, scope) if scope.keys else capture.multiset_diff(a, b, scope)
    assert shown(got) == shown(plain) and len(shown(got)) > 40
    same = capture.diff_versions(spark, f"{tmp_path}/old", f"{tmp_path}/old", scope)
    assert same.collect() == []


def test_share_of_files_that_is_read(spark, tmp_path):
    old = spark.range(20_000).select("id", (F.col("id") % 7).alias("v"))
    new = old.withColumn("v", F.when(F.col("id").between(5000, 5099), -1).otherwise(F.col("v")))
    for name, d in (("old", old), ("new", new)):
        capture.write_version(d, f"{tmp_path}/{name}", KEYED, width=200)
    moved = [r["_range"] for r in capture.changed_ranges(spark, f"{tmp_path}/old", f"{tmp_path}/new").collect()]
    assert moved == [25]  # one of a hundred
    got = capture.diff_versions(spark, f"{tmp_path}/old", f"{tmp_path}/new", KEYED)
    assert got.count() == 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "25" in plan
    scan = spark.read.parquet(f"{tmp_path}/old/rows").where(F.col("_range").isin(moved))
    files = scan._jdf.queryExecution().executedPlan().collectLeaves().head().selectedPartitions().totalNumberOfFiles()
    assert files <= 2 < 100


def test_digests_add_up(spark):
    d = spark.createDataFrame(rows_of(2), SHAPE).withColumn("_range", F.col("id") % 5)
    cut = F.col("id") < 100
    whole = capture.digests(d, d.columns[:-1])
    parts = capture.merge_digests(*(capture.digests(d.where(c), d.columns[:-1]) for c in (cut, ~cut)))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    other = capture.digests(d.withColumn("name", F.when(F.col("id") == 7, "z").otherwise(F.col("name"))), d.columns[:-1])
    assert whole.join(other, ["_range", "rows", "h0", "h1"], "left_anti").count() == 1
    with pytest.raises(ValueError):
        capture.range_of(d, BAG, width=5)


def test_written_since_scans_the_old_table_once(spark, tmp_path):
    shape = "id long, kind string, v int, row_version int"
    watched = TableScope("t", ("id",), PRIMARY, "kind = 'in'")
    old = [(1, "in", 1, 0), (2, "in", 1, 0), (3, "out", 1, 0), (4, "in", 1, 0), (5, "in", 1, 0), (6, None, 1, 0), (None, "in", 1, 0), (8, "in", 1, 0)]
    new = [(1, "in", 1, 1), (2, "in", 2, 1), (3, "in", 1, 1), (4, "out", 1, 1), (6, "in", 1, 1), (7, "in", 1, 1), (None, "in", 2, 1), (8, "in", 1, 0), (9, "out", 1, 1)]
    for name, rows in (("old", old), ("new", new)):
        spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("old", "new"))
    got = capture.written_since(a, b, watched, "row_version", 0)
    seen = sorted((str(r["i"]), r["kind"], r["bv"], r["av"], ",".join(r["changed_columns"])) for r in got.select(F.coalesce("after.id", "before.id").alias("i"), "kind", F.col("before.v").alias("bv"), F.col("after.v").alias("av"), "changed_columns").collect())
    every = "id,kind,v"
    assert seen == sorted([
        ("1", "update", 1, 1, ""), ("2", "update", 1, 2, "v"), ("3", "update", 1, 1, "kind"), ("4", "left-scope", 1, None, every), ("5", "left-scope", 1, None, every), ("6", "update", 1, 1, "kind"), ("7", "insert", None, 1, every),
        ("None", "insert", None, 2, every), ("None", "left-scope", 1, None, every),
    ])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/old") == 1 and "GreaterThan(row_version,0)" in plan
