"""Cases of capture, through the strategies that can see them."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowledger.operators import capture, select, summary
from rowledger.plans import check as k
from rowledger.sources.scope import KEYLESS, PRIMARY, Catalog, Scope, TableScope, catalog_columns, describe, full_scope, infer_key, narrowed_scope, prove_key, scope_report, unresolved_names

ACCOUNTS = "id string, balance decimal(14,2), status string, meta string, v int"
A = TableScope("accounts", ("id",), PRIMARY)
BEFORE = [("a", "1000.00", "open", '{"k": 1}', 0), ("b", "0.00", "open", None, 0)]
#: name -> (rows after, kinds by values, kinds by writes)
CASES = {
    "an insert": (BEFORE + [("c", "5.00", "open", None, 1)], {("c", "insert")}, {("c", "insert")}),
    "an update of one column": ([("a", "900.00", "open", '{"k": 1}', 1), BEFORE[1]], {("a", "update")}, {("a", "update")}),
    "a delete": ([BEFORE[0]], {("b", "delete")}, {("b", "delete")}),
    "nothing at all": (BEFORE, set(), set()),
    "a write that changes no value": ([("a", "1000.00", "open", '{"k": 1}', 1), BEFORE[1]], set(), {("a", "update")}),
    "a NULL that becomes a value": ([BEFORE[0], ("b", "0.00", "open", "{}", 1)], {("b", "update")}, {("b", "update")}),
    "a truncate": ([], {("a", "delete"), ("b", "delete")}, {("a", "delete"), ("b", "delete")}),
    "a row put in the place of another": ([BEFORE[0], ("c", "0.00", "open", None, 1)], {("b", "delete"), ("c", "insert")}, {("b", "delete"), ("c", "insert")}),
}


def frame(spark, rows, shape=ACCOUNTS):
    return spark.createDataFrame([(i, Decimal(b), *r) for i, b, *r in rows], shape)


def kinds(c):
    return {(r["k"], r["kind"]) for r in c.select(F.coalesce("after.id", "before.id").alias("k"), "kind").collect()}


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, case):
    after, by_value, by_write = CASES[case]
    b, a = frame(spark, BEFORE), frame(spark, after)
    x, w = capture.snapshot_diff(b.drop("v"), a.drop("v"), A), capture.written_since(b, a, A, "v", 0)
    assert kinds(x) == kinds(capture.wide_snapshot_diff(b.drop("v"), a.drop("v"), A)) == by_value
    assert kinds(w) == by_write
    # the strategies differ by writes without a change of value, and by nothing else
    gone = {r["row"] for r in summary.reconcile(summary.shape(x), summary.shape(w)).collect()}
    assert gone == {f"accounts:{kind}:{i}" for i, kind in by_write - by_value}


def test_tokens_agree_between_strategies(spark):
    b, a = frame(spark, BEFORE), frame(spark, CASES["an update of one column"][0])
    t = lambda c: {r["key_token"] for r in c.collect()}
    assert t(capture.snapshot_diff(b.drop("v"), a.drop("v"), A, "s")) == t(capture.written_since(b, a, A, "v", 0, "s"))


def test_masks_and_ignored_columns(spark):
    b, a = frame(spark, BEFORE).drop("v"), frame(spark, CASES["an update of one column"][0]).drop("v")
    r = capture.snapshot_diff(b, a, TableScope("accounts", ("id",), PRIMARY, None, ("balance",), ("balance", "id"))).first()
    assert r["changed_columns"] == ["balance"] and r["visible_columns"] == [] and r["after"]["balance"] is None and r["has_write"]
    assert r["key"][0]["value"] is None and r["key_token"]


def test_keyless_rows_are_counted(spark):
    b = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "note string")
    a = spark.createDataFrame([("x",), ("z",), ("z",), (None,)], "note string")
    got = sorted((r["kind"], (r["after"] or r["before"])["note"]) for r in capture.multiset_diff(b, a, TableScope("log")).collect())
    assert got == [("delete", "x"), ("delete", "y"), ("insert", "z"), ("insert", "z")]


def test_maps_have_an_equality(spark):
    shape = "id string, m map<string,int>"
    b, a = spark.createDataFrame([("1", {"a": 1, "b": 2}), ("2", {"a": 1})], shape), spark.createDataFrame([("1", {"b": 2, "a": 1}), ("2", {"a": 2})], shape)
    assert kinds(capture.snapshot_diff(b, a, TableScope("t", ("id",), PRIMARY))) == {("2", "update")}


def test_a_key_that_is_none_downgrades_its_table(spark):
    b = spark.createDataFrame([("1", 1), ("1", 2)], "id string, n int")
    a = spark.createDataFrame([("1", 1), ("1", 3)], "id string, n int")
    cs = capture.capture_snapshots(spark, {"t": b}, {"t": a}, Scope({"t": TableScope("t", ("id",), PRIMARY)}))
    assert [r["code"] for r in cs.warnings.collect()] == ["degraded-row-identity"]
    assert sorted(r["kind"] for r in cs.changes["t"].collect()) == ["delete", "insert"]
    capped = capture.capture_snapshots(spark, {"t": b}, {"t": a}, Scope({"t": TableScope("t", ("id",), PRIMARY, max_rows=1)}))
    assert [r["code"] for r in capped.warnings.collect()] == ["scope-truncated"] and not capped.changes


def test_written_keyless_always_warns(spark):
    b, a = spark.createDataFrame([("x", 0)], "note string, v int"), spark.createDataFrame([("x", 0)], "note string, v int")
    cs = capture.capture_written(spark, {"t": b}, {"t": a}, Scope({"t": TableScope("t")}), "v", 0)
    assert cs.changes["t"].count() == 0 and cs.warnings.count() == 1


def test_keys(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, None)], "x int, y int, z string")
    assert prove_key(d, ("x", "y")).first()["is_key"] and not prove_key(d, ("x",)).first()["is_key"] and prove_key(d, ("z",)).first()["null_keys"] == 1
    assert infer_key(d) == (("x", "y"), "unique-index") and infer_key(d, ("x",), []) == ((), KEYLESS) and infer_key(d, ("x", "y")) == (("x", "y"), PRIMARY)


def test_scopes(spark):
    d = spark.createDataFrame([(1, "a")], "id int, secret string")
    cat = Catalog({"b": d, "a": d, "_m": d, "f": d}, {"a": ("id",)}, ("f",))
    s = full_scope(cat, True, ("secret", "nope"))
    assert list(s.tables) == ["a", "b"] and s.tables["a"].masked == ("secret",) and not s.tables["b"].departures_observable
    n = narrowed_scope(s, {"a": {"where": "id > 0", "ignore": ["id"]}})
    assert not n.all_tables and n.tables["a"].where == "id > 0"
    with pytest.raises(ValueError, match="zz"):
        narrowed_scope(s, {"zz": {}})
    cols = catalog_columns(spark, {t: cat.tables[t] for t in s.tables})
    assert [r["name"] for r in unresolved_names(spark, ["secret", "nope"], cols).collect()] == ["nope"]
    assert {(r["kind"], r["table"]) for r in scope_report(spark, cat, s).collect()} == {("watched", "a"), ("watched", "b"), ("keyless", "b"), ("underscore", "_m"), ("foreign", "f")}
    assert [(r["table"], r["column"], r["is_key"], r["masked"]) for r in describe(cols, s.frame(spark)).collect()][:2] == [("a", "id", True, False), ("a", "secret", False, True)]


def change_set(spark, detection=capture.VALUE, **more):
    b, a = frame(spark, BEFORE), frame(spark, [("a", "900.00", "open", '{"k": 1}', 1), ("b", "100.00", "shut", None, 1), ("c", "0.00", "open", None, 1)])
    c = capture.snapshot_diff(b.drop("v"), a.drop("v"), A) if detection == capture.VALUE else capture.written_since(b, a, A, "v", 0)
    return capture.ChangeSet({"accounts": c}, Scope({"accounts": A}), detection, capture.NET, capture.warn(spark), None, {"accounts": a.drop("v")}, **more)


def statuses(spark, cs, *e, **kw):
    return [(r["status"], r["reason"]) for r in k.evaluate(spark, cs, list(e), **kw).orderBy("ordinal").collect()]


def test_assertions(spark):
    cs = change_set(spark, capture.WRITE)
    d = k.delta(k.updated("accounts"), "balance")
    got = statuses(
        spark, cs, k.sum_(d).eq("0"), k.count(k.updated("accounts").where(status="shut")).eq(1), k.single(k.updated("accounts").where(id="a")).after("balance").eq("900"), k.single(k.updated("accounts").where(id="a")).delta("balance").eq(k.var("d")),
        k.single(k.updated("accounts")).after("balance").eq(1), ~(k.count(k.inserted("accounts")).eq(2)), k.min_(k.delta(k.deleted("accounts"), "balance")).eq(0), k.sum_(k.delta(k.deleted("accounts"), "balance")).eq(0),
        k.any_(k.inserted("accounts")) | k.count(k.changes("acounts")).eq(1), k.count(k.changes("acounts")).eq(1) | k.any_(k.inserted("accounts")), k.max_(k.updated("accounts").after("status")).eq(1), variables={"d": "-100"},
    )
    assert [s for s, _ in got] == ["passed", "passed", "passed", "passed", "unevaluable", "passed", "unevaluable", "passed", "passed", "unevaluable", "unevaluable"]
    assert "did you mean accounts" in got[9][1] and got[10][1] == "2 rows have no number in status"


def test_null_cells_make_sums_unevaluable(spark):
    b = spark.createDataFrame([("a", Decimal(1)), ("b", None)], "id string, n decimal(10,2)")
    a = spark.createDataFrame([("a", Decimal(2)), ("b", Decimal(3))], "id string, n decimal(10,2)")
    t = TableScope("t", ("id",), PRIMARY)
    cs = capture.ChangeSet({"t": capture.snapshot_diff(b, a, t)}, Scope({"t": t}), capture.VALUE, capture.NET, capture.warn(spark))
    assert [s for s, _ in statuses(spark, cs, k.sum_(k.delta(k.changes("t"), "n")).eq(1), k.sum_(k.changes("t").after("n")).eq("5.0"))] == ["unevaluable", "passed"]


@pytest.mark.parametrize("fixture", ["value", "partial", "masked", "identity", "fidelity"])
def test_a_guard_stands_where_the_answer_would_be_wrong(spark, fixture):
    cs = change_set(spark)
    if fixture == "value":  # a write without a change of value would be missed
        e, kw = k.count(k.updated("accounts")).eq(2), {}
    elif fixture == "partial":
        e, kw = k.count(k.rows("accounts")).eq(1), {"rows_cap": 1}
    elif fixture == "masked":
        cs.scope = Scope({"accounts": TableScope("accounts", ("id",), PRIMARY, None, (), ("balance",))})
        e, kw = k.sum_(k.delta(k.deleted("accounts"), "balance")).eq(0), {}
    elif fixture == "identity":
        cs.scope = Scope({"accounts": TableScope("accounts", ("id",), PRIMARY, departures_observable=False)})
        e, kw = k.is_empty(k.deleted("accounts")).eq(True), {}
    else:
        e, kw = k.atomic(k.inserted("accounts")).eq(True), {}
    assert statuses(spark, cs, e, **kw)[0][0] == "unevaluable"


def test_rows_are_changed_and_current_ones_once(spark):
    r, whole = select.rows(change_set(spark), "accounts")
    assert whole and sorted((x["kind"]) for x in r.collect()) == ["insert", "update", "update"]


def test_one_aggregation_for_many_assertions(spark):
    p = k.Planner(change_set(spark, capture.WRITE))
    for i in range(20):
        p.plan(k.count(k.updated("accounts").where(id=str(i))).eq(0))
        p.plan(k.count(k.updated("accounts").where(id=str(i))).eq(1))
    assert len(p.sources) == 1 and len(next(iter(p.sources.values())).columns) == 20


def test_copies_are_given_out_in_slices(spark, monkeypatch):
    monkeypatch.setattr(capture, "SLICE", 4)
    d = spark.createDataFrame([("a",)] * 11 + [("b",)] * 2, "x string")
    out = capture.multiset_diff(d.where("x = 'b'"), d.unionByName(d.where("x = 'b'")), TableScope("t"))
    assert {(r["kind"], r["x"]): r["n"] for r in out.groupBy("kind", F.col("after.x").alias("x")).agg(F.count("*").alias("n")).collect()} == {("insert", "a"): 11, ("insert", "b"): 2}


def test_tables_bucketed_by_a_proven_key_need_no_shuffle(spark):
    d = spark.createDataFrame([(i, i % 3) for i in range(50)], "k long, v long")
    for name, x in (("bucket_b", d), ("bucket_a", d.withColumn("v", F.col("v") + F.when(F.col("k") == 7, 1).otherwise(0)))):
        x.write.mode("overwrite").bucketBy(4, "k").sortBy("k").saveAsTable(name)
    t = TableScope("t", ("k",), PRIMARY)
    out = capture.snapshot_diff(spark.table("bucket_b").hint("merge"), spark.table("bucket_a"), t, proven=True)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 1
