"""Assertion trees: to JSON and back, decided as rows as they are one by one, pruned."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowledger.operators import capture, promote
from rowledger.plans import check as k
from rowledger.plans import tree
from rowledger.sources.scope import PRIMARY, Scope, TableScope

from .test_runs import assertions

NOTES = TableScope("notes", ("id",), PRIMARY, masked=("secret",))
SHAPE = "id string, status string, amount decimal(12,2), doc string, ok boolean, secret int, updated_at timestamp_ntz"


@pytest.mark.parametrize("e", [*assertions(), k.count(k.changes("*", ("a", "b"))).eq(Decimal("1.50")), ~(k.any_(k.inserted("t").where(a="x\"\\\n", b=None, c=True, d=1)) | k.var("x"))])
def test_there_and_back(e):
    assert tree.decode(tree.encode(e)) == e


def frames(spark):
    old = [("pay_1", "COMPLETED", "100.00", '{"a": 1}', True, 1), ('a"b\\c', "NEW", "5.00", None, False, 1), ("c", "X", "1.00", "{}", None, 2), ("bell\x07", "NEW", "1.00", "{}", None, 2), ("gone", "X", "3.00", None, True, 4)]
    new = [("pay_1", "REFUNDED", "90.00", '{"a": 2}', True, 1), ('a"b\\c', 'q"uo\\te', "5.00", None, True, 1), ("c", "X", "1.00", "{}", None, 3), ("bell\x07", "OLD", "2.00", "{}", None, 2), ("in_1", "NEW", "4.00", None, True, 5), ("in_2", "NEW", "1.50", '{"b": [1, 2]}', True, 5)]
    made = lambda rows: spark.createDataFrame([(*r[:2], Decimal(r[2]), *r[3:], None) for r in rows], SHAPE)
    b, a = made(old), made(new)
    c = capture.snapshot_diff(b, a, NOTES)
    return capture.ChangeSet({"notes": c}, Scope({"notes": NOTES}), capture.WRITE, capture.NET, None, None, {"notes": a})


def test_what_is_promoted_holds(spark):
    cs = frames(spark)
    c = cs.changes["notes"]
    variables = {"payment": "pay_1", "run": "NEW"}
    offers = promote.candidates([promote.table_counts(c), promote.discriminator_counts(c, ("secret",)), promote.update_candidates(c, ["id"], ("secret",), variables), promote.invariants(c, keys=["id"], masked=("secret",))])
    found = tree.decide(cs, offers, variables).collect()
    assert len(found) == offers.count() > 8
    assert {r["status"] for r in found if r["rule"] != "invariant"} == {"passed"}
    for r in found:  # text and tree say the same
        e = tree.decode(r["tree"])
        assert ("{{payment}}" in r["expression"]) == ('"var"' in r["tree"])
        assert "pay_1" not in r["expression"] + r["tree"]
        alone = k.evaluate(spark, cs, [_resolved(e, variables)], variables).first()
        assert (alone["status"], alone["actual"], alone["expected"], alone["reason"]) == (r["status"], r["actual"], r["expected"], r["reason"])
    # without the variable, nothing that names it can be decided
    lost = tree.decide(cs, offers).where(F.col("expression").contains("{{payment}}")).select("status", "reason").distinct().collect()
    assert lost == [("unevaluable", "no value was captured for payment")]
    # the same candidates over changes that differ
    other = capture.ChangeSet({"notes": c.where("kind = 'delete'")}, cs.scope, capture.WRITE, capture.NET, None, None, cs.current)
    again = {r["expression"]: r["status"] for r in tree.decide(other, offers, variables).collect()}
    assert again["count(inserted(notes)) == 2"] == "failed" and again["count(deleted(notes)) == 1"] == "passed"


def _resolved(e, variables):
    """Predicates name variables by value in the builder."""
    what = e.args[0].args[0]
    sel = what.sel if isinstance(what, k.Col) else what
    sel = k.replace(sel, where_=tuple((c, variables[v.args[0]] if isinstance(v, k.Expr) else v) for c, v in sel.where_))
    what = k.replace(what, sel=sel) if isinstance(what, k.Col) else sel
    return k.Expr(e.op, (k.Expr(e.args[0].op, (what,)), e.args[1]))


def test_rows_are_decided_as_one_by_one(spark):
    cs = frames(spark)
    n = k.changes("notes")
    asked = [
        k.count(k.inserted("notes").where(amount="4")).eq("1.0"), k.count(k.inserted("notes").where(amount="04.000", ok="T")).eq(1), k.count(n.where(doc='{"b":[1,2]}')).eq(1), k.count(k.inserted("notes").where(doc='{ "b": [1, 2.0] }')).eq(1), k.count(k.inserted("notes").where(doc=None)).eq(1),
        k.count(k.updated("notes").where(status="nobody")).eq(0), k.count(n.where(secret=1)).eq(0), k.count(n.where(nothing=1)).eq(0), k.count(k.changes("nots")).eq(0), k.single(k.rows("notes", id="c")).after("status").eq("X"), k.single(k.rows("notes", id="in_1")).delta("amount").eq(4),
        k.single(k.rows("notes", id="nobody")).delta("amount").eq(4), k.max_(n.after("amount")).gt(89), k.min_(k.inserted("notes").where(status="NEW").after("amount")).lt("abc"), k.has_write(k.changes("*")).eq(False), k.is_empty(k.deleted("notes")).ne(True), k.sum_(k.delta(n, "secret")).eq(0),
        k.count(n).eq(6) & k.any_(n), k.any_(n), k.count(k.rows("notes", status="X")).eq(2),
    ]
    c = spark.createDataFrame([(i, tree.encode(e)) for i, e in enumerate(asked)], "at int, tree string")
    kinds = {"notes": {"doc": "json"}}
    got = {r["at"]: (r["status"], r["actual"], r["expected"], r["reason"]) for r in tree.decide(cs, c, kinds=kinds).collect()}
    alone = {r["ordinal"]: (r["status"], r["actual"], r["expected"], r["reason"]) for r in k.evaluate(spark, cs, asked, kinds=kinds).collect()}
    for i in (17, 18):  # no comparison of one question with one value
        assert got.pop(i)[3] == "only comparisons of one question with one value are decided here"
        alone.pop(i)
    assert got == alone
    assert tree.decide(cs, c.limit(0)).collect() == []


def test_pruned(spark):
    wrote = k.has_write(k.changes("t").where(id="1")).eq(True)
    kept = [k.single(k.updated("t").where(id="1")).after("a").eq("x"), k.has_write(k.changes("t").where(id="2")).eq(True), k.single(k.rows("t", id="3")).delta("a").eq("0"), k.has_write(k.changes("t").where(id="3")).eq(True), k.has_write(k.changes("*")).eq(False), k.count(k.changes("t")).eq(1), k.any_(k.changes("t")) | k.var("x")]
    gone = [wrote, k.single(k.rows("t", id="3")).delta("a").eq("0.00"), k.count(k.inserted("t")).eq(0), k.is_empty(k.deleted("u")).eq(True)]
    rows = [(i, tree.encode(e)) for i, e in enumerate([*kept, *gone])]
    d = spark.createDataFrame(rows, "ordinal int, tree string")
    assert sorted(r["ordinal"] for r in tree.prune(d).collect()) == list(range(len(kept)))
    assert sorted(r["ordinal"] for r in tree.prune(d.where("ordinal <> 4")).collect()) == [0, 1, 2, 3, 5, 6, 9, 10]
