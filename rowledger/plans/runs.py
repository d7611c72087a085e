"""Assertions over many runs at once: one plan, grouped by run.

The changes of all runs lie in one frame for each table, with a column that names the run.
The same expressions as in ``check`` become columns of one aggregate for each table, grouped by
run; aggregates, what is asked of the list of writes, and the variables of each run meet on the run,
and every answer is a struct of a reason (why it cannot be given), a kind and a text. Guards
that depend on a run (its detection, its fidelity, rows it did not read, variables it did not
capture) are conditions on its row; those that metadata decides are literals.

Nothing is collected: the result has a row for each run and assertion, also for
runs without changes. A run that holds very many changes is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import digits_of, exact, plus
from ..operators import select
from ..operators.capture import TRANSACTIONAL, WRITE, ChangeSet
from .check import _ORDER, Col, Expr, No, Planner, Sel, _Source

NULL, BOOLEAN, NUMBER, TEXT = "null", "boolean", "number", "text"


def answer(kind: str, text: Column) -> Column:
    """A value that is there; a NULL text is the value NULL."""
    return F.struct(F.lit(None).cast("string").alias("no"), F.when(text.isNull(), NULL).otherwise(kind).alias("kind"), text.cast("string").alias("text"))


def truth(condition: Column) -> Column:
    return answer(BOOLEAN, F.when(condition, "true").otherwise("false"))


def refusal(reason: Column | str) -> Column:
    return F.struct((F.lit(reason) if isinstance(reason, str) else reason).alias("no"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("text"))


def guarded(guards: list[tuple[Column, Column | str]], value: Column) -> Column:
    """The first guard that holds refuses; else the value."""
    for when, reason in reversed(guards):
        value = F.when(when, refusal(reason)).otherwise(value)
    return value


def _literal(x: object) -> Column:
    if x is None:
        return answer(TEXT, F.lit(None).cast("string"))
    if isinstance(x, bool):
        return truth(F.lit(x))
    if isinstance(x, int | Decimal):
        return answer(NUMBER, F.lit(format(x, "f") if isinstance(x, Decimal) else str(x)))
    return answer(TEXT, F.lit(str(x)))


def _holds(v: Column) -> Column:
    return (v["kind"] == BOOLEAN) & (v["text"] == "true")


def compared(op: str | Column, a: Column, b: Column, p: Column | None = None, q: Column | None = None) -> Column:
    """Equality by what both values are; order between numbers only; a refusal on either side stays one. ``op`` may be a column;
    ``p`` and ``q``: the numbers that the values are, if a column has them already."""
    p, q = number(a) if p is None else p, number(b) if q is None else q
    both = p.isNotNull() & q.isNotNull()
    plain = lambda v: F.lower(F.trim(v["text"]))
    flag = lambda v: F.when(plain(v).isin("t", "true"), "true").when(plain(v).isin("f", "false"), "false").otherwise(plain(v))
    a_null, b_null = a["kind"] == NULL, b["kind"] == NULL
    same = F.when(a_null | b_null, a_null & b_null).when(both, p == q).when((a["kind"] == BOOLEAN) | (b["kind"] == BOOLEAN), flag(a) == flag(b)).otherwise(a["text"] == b["text"])
    size = lambda v: F.struct(v["n"], v["whole"], v["fraction"])
    below = lambda x, y: F.when(x["negative"] != y["negative"], x["negative"]).when(x["negative"], size(y) < size(x)).otherwise(size(x) < size(y))
    refused = [(a["no"].isNotNull(), a["no"]), (b["no"].isNotNull(), b["no"])]
    if isinstance(op, Column):
        equal, less, more = op.isin("==", "!="), below(p, q), below(q, p)
        holds = F.when(op == "==", same).when(op == "!=", ~same).when(op == "<", less).when(op == "<=", ~more).when(op == ">", more).otherwise(~less)
        return guarded([*refused, (~equal & ~both, "only numbers have an order")], truth(holds))
    if op in ("==", "!="):
        return guarded(refused, truth(same if op == "==" else ~same))
    return guarded([*refused, (~both, "only numbers have an order")], truth({"<": below(p, q), "<=": ~below(q, p), ">": below(q, p), ">=": ~below(p, q)}[op]))


def number(v: Column) -> Column:
    return F.when(v["kind"].isin(NUMBER, TEXT), digits_of(v["text"]))


class RunPlanner(Planner):
    """Plans expressions over the changes of many runs; ``runs`` has one row for each, with its detection and fidelity if they differ."""

    def __init__(self, cs: ChangeSet, runs: DataFrame, run: str, cap: int | None = None, kinds: dict[str, dict[str, str]] | None = None):
        super().__init__(cs, {}, cap, kinds)
        self.runs, self.by, self.read = runs, run, {}
        has = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in runs.columns else F.lit(default)
        self.detection, self.fidelity = has("detection", cs.detection), has("fidelity", cs.fidelity)

    # -- sources -----------------------------------------------------------

    def source(self, sel: Sel, table: str) -> _Source:
        key = (table, sel.where_ if sel.which == "rows" else None)
        if key not in self.sources and sel.which == "rows":
            self.sources[key] = _Source(select.rows(self.cs, table, dict(sel.where_), by=(self.by,))[0])
        elif key not in self.sources:
            self.sources[key] = _Source(self.cs.changes[table])
        return self.sources[key]

    def columns(self, sel: Sel, what: str, make: Callable[[Column, DataFrame], Column], none: object = None) -> list[Column]:
        """A column of each table's aggregate; ``none`` stands for runs without rows there."""
        out = []
        for t in self.tables(sel):
            s = self.source(sel, t)
            at = list(self.sources.values()).index(s)
            known = next((n for n, (k, _) in s.columns.items() if k == (sel, what)), None)
            name = known or f"s{at}_{len(s.columns)}"
            if known is None:
                s.columns[name] = ((sel, what), make(self.chosen(sel, t), s.frame))
            out.append(F.col(name) if none is None else F.coalesce(F.col(name), F.lit(none)))
        return out

    def total(self, sel: Sel, what: str, make: Callable[[Column, DataFrame], Column]) -> Column:
        return reduce(lambda a, b: a + b, self.columns(sel, what, make, 0), F.lit(0).cast("long"))

    def guards(self, sel: Sel, detection: bool) -> list[tuple[Column, str]]:
        """Whole set, then detection, then row identity."""
        out = []
        if sel.which == "rows" and self.cap is not None:
            key = (sel.table, sel.where_)
            self.read.setdefault(key, f"r{len(self.read)}")
            out.append((F.coalesce(F.col(self.read[key]), F.lit(0)) > self.cap, "not all rows were read"))
        if detection and sel.which in ("changes", "updated"):
            out.append((self.detection != WRITE, "needs write detection: a write that changes no value is not seen"))
        if detection and sel.which in ("changes", "updated", "deleted"):
            blind = [t for t in self.tables(sel) if not self.cs.scope.tables[t].departures_observable]
            if blind and (sel.table != "*" or self.cs.scope.all_tables):
                out.append((F.lit(True), f"rows of {', '.join(blind)} have no identity: updates and departures cannot be told"))
        return out

    # -- expressions ---------------------------------------------------------

    def value_of(self, e: object) -> Column:
        if not isinstance(e, Expr):
            return _literal(e)
        if e.op == "var":
            have = F.map_contains_key("_variables", F.lit(e.args[0]))
            return guarded([(~F.coalesce(have, F.lit(False)), f"no value was captured for {e.args[0]}")], answer(TEXT, F.try_element_at("_variables", F.lit(e.args[0]))))
        if e.op in ("and", "or"):
            a, b = map(self.value_of, e.args)
            decided = truth(F.lit(e.op == "or"))
            return guarded([(a["no"].isNotNull(), a["no"])], F.when(_holds(a) == F.lit(e.op == "or"), decided).otherwise(guarded([(b["no"].isNotNull(), b["no"])], truth(_holds(b)))))
        if e.op == "not":
            a = self.value_of(e.args[0])
            return guarded([(a["no"].isNotNull(), a["no"])], truth(~_holds(a)))
        if e.op in _ORDER:
            return compared(e.op, *map(self.value_of, e.args))
        what = e.args[0]
        sel = what.sel if isinstance(what, Col) else what
        if (bad := self.known(sel)) is not None:
            return refusal(bad.reason)
        if e.op in ("count", "any", "isEmpty", "hasWrite"):
            return self.of_rows(e.op, sel)
        return self.of_writes(e.op, sel) if e.op in ("writeCount", "atomic") else self.of_column(e.op, what)

    def of_rows(self, op: str, sel: Sel) -> Column:
        guards = self.guards(sel, True)
        if op == "hasWrite":
            n = self.total(sel, op, lambda c, f: F.count_if(c & F.col("has_write")))
            return guarded([(self.detection != WRITE, "needs write detection"), *guards], truth(n > 0))
        n = self.total(sel, "count", lambda c, f: F.count_if(c))
        return guarded(guards, {"count": answer(NUMBER, n.cast("string")), "any": truth(n > 0), "isEmpty": truth(n == 0)}[op])

    def of_writes(self, op: str, sel: Sel) -> Column:
        needs = "needs a list of writes with their transactions"
        if self.cs.mutations is None:
            return refusal(needs)
        at = len(self.picked)
        chosen = lambda t: self.source(sel, t).frame.where(self.chosen(sel, t) & F.col("key_token").isNotNull())
        self.picked.append(reduce(DataFrame.unionByName, (chosen(t).select(self.by, "table", "key_token", F.lit(at).alias("_question")) for t in self.tables(sel))))
        n, t, u = (F.coalesce(F.col(f"w{at}{k}"), F.lit(0)) for k in "ntu")
        guards = [(self.fidelity != TRANSACTIONAL, needs), *self.guards(sel, False)]
        if op == "writeCount":
            return guarded(guards, answer(NUMBER, n.cast("string")))
        return guarded([*guards, (n == 0, "no writes were recorded on these rows"), (u > 0, "a write has no transaction")], truth(t == 1))

    def of_column(self, op: str, col: Col) -> Column:
        sel = col.sel
        for t in self.tables(sel):
            bad = self.column(t, col.column)
            if bad is None and col.column in self.cs.scope.tables[t].masked:
                bad = No(f"{t}.{col.column} is masked")
            if bad is not None:
                return refusal(bad.reason)

        def cell(f: DataFrame) -> tuple[Column, Column]:
            if col.side == "delta":
                return select.delta(f, col.column), F.lit(True)
            return exact(F.col(f"{col.side}.{col.column}"), f.schema["after"].dataType[col.column].dataType), F.col(col.side).isNotNull()

        name, guards = f"{col.side}.{col.column}", self.guards(sel, False)
        n = self.total(sel, f"n {name}", lambda c, f: F.count_if(c & cell(f)[1]))
        if op == "value":
            raw = (lambda f: cell(f)[0]) if col.side == "delta" else (lambda f: F.col(f"{col.side}.{col.column}"))
            texts = self.columns(sel, f"text {name}", lambda c, f: F.max(F.when(c, raw(f).cast("string"))))
            return guarded([*guards, (n != 1, F.concat(n.cast("string"), F.lit(" values where one is needed")))], answer(TEXT, F.coalesce(*texts)))
        bad = self.total(sel, f"bad {name}", lambda c, f: F.count_if(c & (cell(f)[0].isNull() | ~cell(f)[1])))
        fold = {"sum": F.try_sum, "min": F.min, "max": F.max}[op]
        got = self.columns(sel, f"{op} {name}", lambda c, f: fold(F.when(c, cell(f)[0])))
        scales = [self.cs.changes[t].select(cell(self.cs.changes[t])[0].alias("x")).schema["x"].dataType.scale for t in self.tables(sel)]
        guards = [*guards, (bad > 0, F.concat(bad.cast("string"), F.lit(f" rows have no number in {col.column}")))]
        have = F.coalesce(*got).isNotNull()
        if op == "sum":
            return guarded([*guards, ((n > 0) & ~have, "the sum has too many digits")], answer(NUMBER, F.coalesce(_sum_text(got, scales), F.lit("0"))))
        return guarded([*guards, (~have, "no rows")], answer(NUMBER, _end_text(op, got, scales)))

    # -- the plan ------------------------------------------------------------

    def wide(self, variables: DataFrame | None) -> DataFrame:
        """One row for each run with all that the expressions ask."""
        d = self.runs
        for s in self.sources.values():
            if s.columns:
                d = d.join(s.frame.groupBy(self.by).agg(*(c.alias(n) for n, (_, c) in s.columns.items())), self.by, "left")
        for (table, where), name in self.read.items():
            now = self.cs.current[table]
            now = now.where(scope.where) if (scope := self.cs.scope.tables[table]).where else now
            now = now.where(select.equals(now, dict(where)))
            d = d.join(now.groupBy(self.by).agg(F.count("*").alias(name)), self.by, "left")
        if self.picked:
            asked = reduce(DataFrame.unionByName, self.picked).distinct()
            each = self.cs.mutations.join(asked, [self.by, "table", "key_token"]).groupBy(self.by, "_question")
            each = each.agg(F.count("*").alias("n"), F.count_distinct("transaction_id").alias("t"), F.count_if(F.col("transaction_id").isNull()).alias("u"))
            d = d.join(each.groupBy(self.by).agg(*(F.max(F.when(F.col("_question") == i, F.col(k))).alias(f"w{i}{k}") for i in range(len(self.picked)) for k in "ntu")), self.by, "left")
        if variables is None:
            return d.withColumn("_variables", F.lit(None).cast("map<string,string>"))
        one = variables.groupBy(self.by, "name").agg(F.max("value").alias("value")).where("name is not null")
        return d.join(one.groupBy(self.by).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_variables")), self.by, "left")


def _sum_text(got: list[Column], scales: list[int]) -> Column:
    """The sum of the tables that have one, written with the largest scale among them."""
    if len(got) == 1:
        return got[0].cast("string")
    most = max(scales)
    zero = F.lit(0).cast(f"decimal(38,{most})")
    total = reduce(lambda a, b: plus(a, b, most), (F.coalesce(g.cast(f"decimal(38,{most})"), zero) for g in got))
    shown = F.greatest(*(F.when(g.isNotNull(), F.lit(s)) for g, s in zip(got, scales, strict=True)))
    text = total.cast("string")
    cut = F.lit(most) - shown + F.when(shown == 0, F.least(F.lit(1), F.lit(most))).otherwise(0)
    return F.when(F.coalesce(*got).isNotNull(), F.substr(text, F.lit(1), F.length(text) - cut))


def _end_text(op: str, got: list[Column], scales: list[int]) -> Column:
    most = max(scales)
    ends = F.array_compact(F.array(*(F.when(g.isNotNull(), F.struct(g.cast(f"decimal(38,{most})").alias("v"), g.cast("string").alias("t"))) for g in got)))
    return {"min": F.array_min, "max": F.array_max}[op](ends)["t"]


def with_run(changes: DataFrame, column: str) -> DataFrame:
    """Changes of tables whose rows name their run (as a part of the key): the run beside the images."""
    return changes.withColumn(column, F.when(F.col("after").isNotNull(), F.col(f"after.{column}")).otherwise(F.col(f"before.{column}")))


def evaluate_runs(cs: ChangeSet, runs: DataFrame, assertions: list[Expr], variables: DataFrame | None = None, run: str = "run_id", rows_cap: int | None = None, kinds: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(run, ordinal, source, status, actual, expected, reason): every assertion for every run.

    Frames of ``cs`` (changes, mutations, current) have the column ``run``; ``runs`` has a row for each run, and may say its detection and
    fidelity; ``variables`` is (run, name, value). Each run's rows equal those of ``check.evaluate`` over that run alone."""
    p = RunPlanner(cs, runs, run, rows_cap, kinds)
    pairs = [(p.value_of(e.args[0]), p.value_of(e.args[1])) if e.op in _ORDER else (p.value_of(e), truth(F.lit(True))) for e in assertions]
    d = p.wide(variables)
    # rows of two sides, which one expression compares, whatever their number
    sides = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(e.text()).alias("source"), F.lit(e.op if e.op in _ORDER else None).alias("op"), a.alias("a"), b.alias("b")) for i, (e, (a, b)) in enumerate(zip(assertions, pairs, strict=True))))
    d = d.select(run, F.explode(sides).alias("r")).select(run, "r.*")
    a, b, op = F.col("a"), F.col("b"), F.col("op")
    d = d.withColumn("p", F.when(op.isNotNull(), number(a))).withColumn("q", F.when(op.isNotNull(), number(b)))
    d = d.withColumn("r", F.when(op.isNull(), a).otherwise(compared(op, a, b, F.col("p"), F.col("q"))))
    no = F.col("r.no").isNotNull()
    shown = lambda v: F.when(~no, F.when(v["kind"] == NULL, "null").otherwise(v["text"]))
    status = F.when(no, "unevaluable").when(_holds(F.col("r")), "passed").otherwise("failed")
    return d.select(run, "ordinal", "source", status.alias("status"), shown(a).alias("actual"), shown(b).alias("expected"), F.col("r.no").alias("reason"))
