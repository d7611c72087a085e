"""Assertions over many runs at once equal those of each run alone."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowledger.operators import capture
from rowledger.plans import check as k
from rowledger.plans import runs
from rowledger.sources.scope import PRIMARY, Scope, TableScope

ITEMS = TableScope("items", ("run", "id"), PRIMARY, masked=("secret",))
WIDE = TableScope("wide", ("run", "id"), PRIMARY)
BLIND = TableScope("blind", departures_observable=False)


def assertions():
    i, w = k.changes("items"), k.changes("wide")
    return [
        k.count(k.inserted("items")).eq(2), k.count(i).ge(0), k.count(k.updated("items")).lt(3), k.is_empty(k.deleted("items")), ~k.is_empty(k.deleted("items")), k.any_(k.inserted("items", ())), k.has_write(i), k.has_write(k.inserted("items")),
        k.sum_(k.delta(i, "amount")).eq("0"), k.sum_(k.delta(w, "amount")).gt(1), k.sum_(i.after("amount")).ne(0), k.min_(k.delta(k.updated("items"), "amount")).lt(0), k.max_(k.inserted("items").after("amount")).le("10.5"), k.max_(k.inserted("items").after("name")).eq(1),
        k.single(k.inserted("items")).after("name").eq("a"), k.single(k.deleted("items")).before("ok").eq(True), k.single(k.updated("items")).delta("amount").eq("1.50"), k.single(k.inserted("items")).after("name").ne(None), k.single(k.inserted("items").where(name=None)).after("name").eq(None),
        k.count(k.inserted("items")).eq(k.var("n")), k.var("word").eq("T"), k.var("word").lt(3), k.var("gone").eq(1) | k.any_(i), k.any_(k.inserted("items")) | k.var("gone").eq(1), k.any_(k.inserted("items")) & k.var("gone").eq(1), k.var("word"),
        k.write_count(i).ge(1), k.atomic(i), k.write_count(k.inserted("items").where(name="a")).eq(1), k.count(k.rows("items", name="a")).ge(1), k.sum_(k.rows("items").after("amount")).gt(0), k.count(k.rows("wide")).eq(0),
        k.count(k.changes("itens")).eq(0), k.sum_(k.delta(i, "amuont")).eq(0), k.sum_(k.delta(i, "secret")).eq(0), k.count(k.inserted("items").where(secret=1)).eq(0), k.count(k.changes("*", ("wide", "blind"))).ge(1), k.is_empty(k.changes()), k.count(k.deleted("blind")).eq(0),
        k.sum_(k.delta(k.changes("*", ("blind",)), "amount")).ge(0), k.min_(k.delta(k.changes("*", ("blind",)), "amount")).le(0), k.max_(k.changes("*", ("blind",)).after("amount")).ge(0), k.count(k.inserted("items").where(name="a", amount="1.5")).ge(1),
    ]


def frames(spark):
    shape = "run int, id int, name string, ok boolean, amount decimal(12,2), secret int"
    old = [(1, 1, "a", True, "1.00", 1), (1, 2, "b", False, "2.00", 1), (2, 1, "a", True, "5.00", 1), (2, 2, None, True, "5.00", 1), (3, 1, "a", True, "7.00", 2), (6, 1, "z", None, None, 2)]
    new = [(1, 1, "a", True, "2.50", 1), (1, 2, "b", False, "2.00", 1), (1, 3, "a", True, "1.50", 1), (2, 2, None, True, "5.00", 1), (2, 3, "a", False, "0.25", 1), (2, 4, None, False, "9.75", 3), (3, 1, "b", True, "7.00", 2), (4, 1, None, True, "1.00", 0), (6, 1, "z", None, "3.00", 2)]
    dec = lambda rows: [(*r[:4], None if r[4] is None else Decimal(r[4]), r[5]) for r in rows]
    b, a = spark.createDataFrame(dec(old), shape), spark.createDataFrame(dec(new), shape)
    wide_b = spark.createDataFrame([(1, 1, 5), (5, 1, 1)], "run int, id int, amount int")
    wide_a = spark.createDataFrame([(1, 1, 8), (5, 1, -1), (2, 9, 4)], "run int, id int, amount int")
    blind = capture.written_since(*(spark.createDataFrame([(1, 1), (2, 5)], "run int, v int") for _ in range(2)), BLIND, "v", 0)
    changes = {"items": capture.snapshot_diff(b, a, ITEMS), "wide": capture.snapshot_diff(wide_b, wide_a, WIDE), "blind": blind}
    changes = {t: runs.with_run(c, "run") for t, c in changes.items()}
    writes = changes["items"].select("run", "table", "key_token").withColumn("transaction_id", F.when(F.col("run") != 2, F.lit("t")).otherwise(F.monotonically_increasing_id().cast("string")))
    writes = writes.unionByName(writes.where("run = 3").withColumn("transaction_id", F.lit(None).cast("string")))
    return changes, writes, {"items": a, "wide": wide_a}


@pytest.mark.parametrize("cap", [None, 1])
def test_every_run_as_if_alone(spark, cap):
    changes, writes, now = frames(spark)
    scope = Scope({"items": ITEMS, "wide": WIDE, "blind": BLIND})
    about = [(1, "write", "transactional"), (2, "value", "transactional"), (3, "write", "transactional"), (4, "write", "net"), (5, "value", "net"), (6, "write", "transactional"), (7, "write", "transactional")]
    listed = spark.createDataFrame(about, "run int, detection string, fidelity string")
    variables = [(1, "n", "1"), (2, "n", "2.0"), (3, "n", None), (4, "n", "x"), (1, "word", "true"), (2, "word", "7"), (3, "word", "t"), (4, "gone", "1"), (9, "n", "1")]
    every = capture.ChangeSet(changes, scope, "value", "net", None, writes, now)
    got = runs.evaluate_runs(every, listed, assertions(), spark.createDataFrame(variables, "run int, name string, value string"), "run", cap)
    found = {}
    for r in got.collect():
        found.setdefault(r["run"], []).append(tuple(r)[1:])
    assert sorted(found) == [1, 2, 3, 4, 5, 6, 7]
    for run, detection, fidelity in about if cap is None else about[:3:2]:
        mine = lambda d, run=run: d.where(F.col("run") == run)
        alone = capture.ChangeSet({t: mine(c).drop("run") for t, c in changes.items()}, scope, detection, fidelity, None, mine(writes).drop("run"), {t: mine(c) for t, c in now.items()})
        want = k.evaluate(spark, alone, assertions(), {n: v for r, n, v in variables if r == run}, cap)
        assert sorted(found[run]) == sorted(tuple(r) for r in want.collect()), run


def test_plan_groups_before_it_shuffles(spark):
    changes, writes, now = frames(spark)
    every = capture.ChangeSet({"items": changes["items"]}, Scope({"items": ITEMS}), "write", "net", None, None, now)
    d = runs.evaluate_runs(every, spark.createDataFrame([(1,)], "run int"), [k.count(k.inserted("items")).eq(1)], None, "run")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert d.select("status").collect() == [("passed",)]
