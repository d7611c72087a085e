"""Assertions over a change set: a builder, guards, and one fused aggregate for each table.

An expression is built with ``changes``, ``inserted``, ``updated``, ``deleted``, ``rows``,
``everything`` and the functions below. ``evaluate`` takes many of them at once: what
metadata can refuse is refused without a job; all others of a table become columns of
one aggregation, whose single row decides them. Results are rows with a status of
passed, failed or unevaluable; guards give reasons, they do not raise.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import DECIMAL_TEXT, exact
from ..functions.values import close as _close
from ..operators import select
from ..operators.capture import TRANSACTIONAL, WRITE, ChangeSet

RESULT = "ordinal int, source string, status string, actual string, expected string, reason string"


@dataclass(frozen=True)
class Sel:
    """A selection: which rows of which table (``*``: of all)."""

    which: str
    table: str
    where_: tuple[tuple[str, object], ...] = ()
    but: tuple[str, ...] = ()

    def where(self, **predicate: object) -> Sel:
        return replace(self, where_=(*self.where_, *predicate.items()))

    def before(self, column: str) -> Col:
        return Col(self, "before", column)

    def after(self, column: str) -> Col:
        return Col(self, "after", column)

    def text(self) -> str:
        inner = ", ".join([f"{self.table} except {', '.join(self.but)}" if self.but else self.table, *(f"{c} = {'null' if v is None else v}" for c, v in self.where_)])
        return f"{self.which}({inner})"


@dataclass(frozen=True)
class Col:
    sel: Sel
    side: str
    column: str
    one: bool = False

    def text(self) -> str:
        s = f"single({self.sel.text()})" if self.one else self.sel.text()
        return f"delta({s}.{self.column})" if self.side == "delta" else f"{s}.{self.side}.{self.column}"


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple = ()

    def _cmp(self, op: str, other: object) -> Expr:
        return Expr(op, (self, other))

    def eq(self, other: object) -> Expr:
        return self._cmp("==", other)

    def ne(self, other: object) -> Expr:
        return self._cmp("!=", other)

    def lt(self, other: object) -> Expr:
        return self._cmp("<", other)

    def le(self, other: object) -> Expr:
        return self._cmp("<=", other)

    def gt(self, other: object) -> Expr:
        return self._cmp(">", other)

    def ge(self, other: object) -> Expr:
        return self._cmp(">=", other)

    def __and__(self, other: Expr) -> Expr:
        return Expr("and", (self, other))

    def __or__(self, other: Expr) -> Expr:
        return Expr("or", (self, other))

    def __invert__(self) -> Expr:
        return Expr("not", (self,))

    def text(self) -> str:
        show = lambda x: x.text() if hasattr(x, "text") else repr(x)
        if self.op in ("and", "or", *_ORDER):
            return f"{show(self.args[0])} {self.op} {show(self.args[1])}"
        if self.op == "var":
            return "{{" + self.args[0] + "}}"
        return f"{self.op}({', '.join(map(show, self.args))})"


_ORDER = ("==", "!=", "<", "<=", ">", ">=")


def changes(table: str = "*", but: tuple[str, ...] = ()) -> Sel:
    return Sel("changes", table, but=but)


def inserted(table: str = "*", but: tuple[str, ...] = ()) -> Sel:
    return Sel("inserted", table, but=but)


def updated(table: str = "*", but: tuple[str, ...] = ()) -> Sel:
    return Sel("updated", table, but=but)


def deleted(table: str = "*", but: tuple[str, ...] = ()) -> Sel:
    return Sel("deleted", table, but=but)


def rows(table: str, **predicate: object) -> Sel:
    if table == "*":
        raise ValueError("rows() needs one table")
    return Sel("rows", table, tuple(predicate.items()))


def delta(sel: Sel | Col, column: str) -> Col:
    return Col(sel.sel if isinstance(sel, Col) else sel, "delta", column, isinstance(sel, Col))


class Single:
    """single(selection): its columns are of the one row that must be there."""

    def __init__(self, sel: Sel):
        self.sel = sel

    def before(self, column: str) -> Expr:
        return Expr("value", (Col(self.sel, "before", column, True),))

    def after(self, column: str) -> Expr:
        return Expr("value", (Col(self.sel, "after", column, True),))

    def delta(self, column: str) -> Expr:
        return Expr("value", (Col(self.sel, "delta", column, True),))


def single(sel: Sel) -> Single:
    return Single(sel)


def value(col: Col) -> Expr:
    return Expr("value", (col,))


def count(sel: Sel) -> Expr:
    return Expr("count", (sel,))


def any_(sel: Sel) -> Expr:
    return Expr("any", (sel,))


def is_empty(sel: Sel) -> Expr:
    return Expr("isEmpty", (sel,))


def has_write(sel: Sel) -> Expr:
    return Expr("hasWrite", (sel,))


def write_count(sel: Sel) -> Expr:
    return Expr("writeCount", (sel,))


def atomic(sel: Sel) -> Expr:
    return Expr("atomic", (sel,))


def sum_(col: Col) -> Expr:
    return Expr("sum", (col,))


def min_(col: Col) -> Expr:
    return Expr("min", (col,))


def max_(col: Col) -> Expr:
    return Expr("max", (col,))


def var(name: str) -> Expr:
    return Expr("var", (name,))


@dataclass(frozen=True)
class No:
    """Not evaluable, and why."""

    reason: str


@dataclass
class _Source:
    frame: DataFrame
    whole: bool = True
    columns: dict[str, Column] = field(default_factory=dict)
    row: dict | None = None


class Planner:
    """Plans a batch of expressions over one change set."""

    def __init__(self, cs: ChangeSet, variables: dict[str, object] | None = None, rows_cap: int | None = None, kinds: dict[str, dict[str, str]] | None = None):
        self.cs, self.variables, self.cap, self.kinds = cs, variables or {}, rows_cap, kinds or {}
        self.sources: dict[tuple, _Source] = {}
        self.picked: list[DataFrame] = []
        self.written: dict[int, tuple] = {}

    # -- guards ------------------------------------------------------------

    def tables(self, sel: Sel) -> list[str]:
        return [t for t in sorted(self.cs.changes) if t not in sel.but] if sel.table == "*" else [sel.table]

    def known(self, sel: Sel) -> No | None:
        for t in (*sel.but, *([] if sel.table == "*" else [sel.table])):
            if t not in self.cs.changes:
                near = [k for k in self.cs.changes if _close(t, k)]
                where = "no table of that name" if self.cs.scope.all_tables else "not in the watch list"
                return No(f"{t}: {where}" + (f"; did you mean {near[0]}?" if near else ""))
        for t in self.tables(sel):
            for c, _ in sel.where_:
                if c in self.cs.scope.tables[t].masked:
                    return No(f"{t}.{c} is masked")
                if (bad := self.column(t, c)) is not None:
                    return bad
        if sel.which == "rows" and self.cs.current is None:
            return No("current rows cannot be read here")
        return None

    def column(self, table: str, column: str) -> No | None:
        names = self.cs.changes[table].schema["after"].dataType.names
        if column in names:
            return None
        near = [n for n in names if _close(column, n)]
        return No(f"{table} has no column {column}" + (f"; did you mean {near[0]}?" if near else ""))

    def set_question(self, sel: Sel, detection: bool) -> No | None:
        """Whole set, then detection, then row identity: the first that fires is the reason."""
        if sel.which == "rows" and not self.source(sel, sel.table).whole:
            return No("not all rows were read")
        if detection and sel.which in ("changes", "updated") and self.cs.detection != WRITE:
            return No("needs write detection: a write that changes no value is not seen")
        if detection and sel.which in ("changes", "updated", "deleted"):
            blind = [t for t in self.tables(sel) if not self.cs.scope.tables[t].departures_observable]
            if blind and (sel.table != "*" or self.cs.scope.all_tables):
                return No(f"rows of {', '.join(blind)} have no identity: updates and departures cannot be told")
        return None

    # -- columns of the fused aggregates ------------------------------------

    def source(self, sel: Sel, table: str) -> _Source:
        key = (table, sel.where_ if sel.which == "rows" else None)
        if key not in self.sources:
            if sel.which == "rows":
                frame, whole = select.rows(self.cs, table, dict(sel.where_), self.cap)
                self.sources[key] = _Source(frame, whole)
            else:
                self.sources[key] = _Source(self.cs.changes[table])
        return self.sources[key]

    def chosen(self, sel: Sel, table: str) -> Column:
        frame = self.source(sel, table).frame
        if sel.which == "rows":
            return F.lit(True)
        return F.col("kind").isin(*select.KINDS[sel.which]) & select.matches(frame, dict(sel.where_), self.kinds.get(table))

    def ask(self, sel: Sel, what: str, make: Callable[[Column, DataFrame], Column]) -> Callable[[], list]:
        """Registers a column with each table's aggregate; the answer is read after the run."""
        refs = []
        for t in self.tables(sel):
            s = self.source(sel, t)
            name = f"m{len(s.columns)}"
            known = next((n for n, (k, _) in s.columns.items() if k == (sel, what)), None)
            if known is None:
                s.columns[name] = ((sel, what), make(self.chosen(sel, t), s.frame))
            refs.append((s, known or name))
        return lambda: [s.row[n] for s, n in refs]

    def run(self) -> None:
        for s in self.sources.values():
            if s.columns:
                s.row = s.frame.agg(*(c.alias(n) for n, (_, c) in s.columns.items())).first().asDict()
        if self.picked:  # all questions about writes are one job, a row for each
            asked = reduce(DataFrame.unionByName, self.picked).distinct()
            m = self.cs.mutations.join(asked, ["table", "key_token"]).groupBy("question")
            got = m.agg(F.count("*").alias("n"), F.count_distinct("transaction_id").alias("t"), F.count_if(F.col("transaction_id").isNull()).alias("u")).collect()
            self.written = {r["question"]: (r["n"], r["t"], r["u"]) for r in got}

    # -- expressions -----------------------------------------------------------

    def plan(self, e: object) -> Callable[[], object]:
        """A function that gives the value after the run: a number, a text, a boolean, None, or No."""
        if not isinstance(e, Expr):
            return lambda: e
        if e.op == "var":
            return lambda: self.variables.get(e.args[0], No(f"no value was captured for {e.args[0]}"))
        if e.op in ("and", "or"):
            a, b = self.plan(e.args[0]), self.plan(e.args[1])
            return lambda: _logic(e.op, a, b)
        if e.op == "not":
            a = self.plan(e.args[0])
            return lambda: x if isinstance(x := a(), No) else not _truth(x)
        if e.op in _ORDER:
            a, b = self.plan(e.args[0]), self.plan(e.args[1])
            return lambda: _compare(e.op, a(), b())
        what = e.args[0]
        sel = what.sel if isinstance(what, Col) else what
        if (bad := self.known(sel)) is not None:
            return lambda: bad
        if e.op in ("count", "any", "isEmpty", "hasWrite"):
            return self._of_rows(e.op, sel)
        if e.op in ("writeCount", "atomic"):
            return self._of_writes(e.op, sel)
        return self._of_column(e.op, what)

    def _of_rows(self, op: str, sel: Sel) -> Callable[[], object]:
        if op == "hasWrite" and self.cs.detection != WRITE:
            return lambda: No("needs write detection")
        if (bad := self.set_question(sel, True)) is not None:
            return lambda: bad
        if op == "hasWrite":
            got = self.ask(sel, op, lambda c, f: F.count_if(c & F.col("has_write")))
            return lambda: sum(got()) > 0
        got = self.ask(sel, "count", lambda c, f: F.count_if(c))
        return {"count": lambda: sum(got()), "any": lambda: sum(got()) > 0, "isEmpty": lambda: sum(got()) == 0}[op]

    def _of_writes(self, op: str, sel: Sel) -> Callable[[], object]:
        if self.cs.fidelity != TRANSACTIONAL or self.cs.mutations is None:
            return lambda: No("needs a list of writes with their transactions")
        if (bad := self.set_question(sel, False)) is not None:
            return lambda: bad
        at = len(self.picked)
        self.picked.append(reduce(DataFrame.unionByName, (self.source(sel, t).frame.where(self.chosen(sel, t) & F.col("key_token").isNotNull()).select("table", "key_token", F.lit(at).alias("question")) for t in self.tables(sel))))

        def answer() -> object:
            n, t, u = self.written.get(at, (0, 0, 0))
            if op == "writeCount":
                return n
            if not n:
                return No("no writes were recorded on these rows")
            return No("a write has no transaction") if u else t == 1

        return answer

    def _of_column(self, op: str, col: Col) -> Callable[[], object]:
        sel = col.sel
        for t in self.tables(sel):
            if (bad := self.column(t, col.column)) is not None:
                return lambda: bad
            if col.column in self.cs.scope.tables[t].masked:
                return lambda: No(f"{t}.{col.column} is masked")
        if (bad := self.set_question(sel, False)) is not None:
            return lambda: bad

        def cell(f: DataFrame) -> tuple[Column, Column]:
            """(the value as a decimal, whether the row has the image)"""
            if col.side == "delta":
                return select.delta(f, col.column), F.lit(True)
            dtype = f.schema["after"].dataType[col.column].dataType
            return exact(F.col(f"{col.side}.{col.column}"), dtype), F.col(col.side).isNotNull()

        name = f"{col.side}.{col.column}"
        n = self.ask(sel, f"n {name}", lambda c, f: F.count_if(c & cell(f)[1]))
        if op == "value":
            if col.side == "delta":
                text = self.ask(sel, f"text {name}", lambda c, f: F.max(F.when(c, cell(f)[0].cast("string"))))
            else:
                text = self.ask(sel, f"text {name}", lambda c, f: F.max(F.when(c, F.col(f"{col.side}.{col.column}").cast("string"))))

            def one() -> object:
                if sum(n()) != 1:
                    return No(f"{sum(n())} values where one is needed")
                return next((x for x in text() if x is not None), None)

            return one
        missing = self.ask(sel, f"bad {name}", lambda c, f: F.count_if(c & (cell(f)[0].isNull() | ~cell(f)[1])))
        fold = {"sum": lambda c, f: F.try_sum(F.when(c, cell(f)[0])), "min": lambda c, f: F.min(F.when(c, cell(f)[0])), "max": lambda c, f: F.max(F.when(c, cell(f)[0]))}[op]
        got = self.ask(sel, f"{op} {name}", fold)

        def folded() -> object:
            if sum(missing()):
                return No(f"{sum(missing())} rows have no number in {col.column}")
            have = [x for x in got() if x is not None]
            if op == "sum":
                if sum(n()) and not have:
                    return No("the sum has too many digits")
                return sum(have, Decimal(0))
            return {"min": min, "max": max}[op](have) if have else No("no rows")

        return folded


def _truth(x: object) -> bool:
    return x is True


def _logic(op: str, a: Callable[[], object], b: Callable[[], object]) -> object:
    x = a()
    if isinstance(x, No):
        return x
    if _truth(x) == (op == "or"):
        return _truth(x)  # the left side decides, whatever the right one is
    y = b()
    return y if isinstance(y, No) else _truth(y)


def _number(x: object) -> Decimal | None:
    if isinstance(x, bool) or x is None:
        return None
    if isinstance(x, int | Decimal):
        return Decimal(x)
    t = str(x).strip()
    return Decimal(t) if re.match(DECIMAL_TEXT, t) else None


def _compare(op: str, a: object, b: object) -> object:
    for x in (a, b):
        if isinstance(x, No):
            return x
    p, q = _number(a), _number(b)
    if op in ("==", "!="):
        if a is None or b is None:
            same = a is None and b is None
        elif p is not None and q is not None:
            same = p == q
        elif isinstance(a, bool) or isinstance(b, bool):
            same = _flag(a) == _flag(b)
        else:
            same = str(a) == str(b)
        return same == (op == "==")
    if p is None or q is None:
        return No("only numbers have an order")
    return {"<": p < q, "<=": p <= q, ">": p > q, ">=": p >= q}[op]


def _flag(x: object) -> object:
    t = str(x).strip().lower()
    return True if t in ("t", "true") else False if t in ("f", "false") else t


def show(x: object) -> str | None:
    """Scalars as text; decimals keep their scale."""
    if isinstance(x, No):
        return None
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else format(x, "f") if isinstance(x, Decimal) else str(x)


def evaluate(spark: SparkSession, cs: ChangeSet, assertions: list[Expr], variables: dict[str, object] | None = None, rows_cap: int | None = None, kinds: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """assertion_results, one row for each expression: one job for each table that is asked, whatever their number,
    and one for all questions about the list of writes."""
    p = Planner(cs, variables, rows_cap, kinds)
    plans = []
    for e in assertions:
        top = e.op in _ORDER
        left, right = (p.plan(e.args[0]), p.plan(e.args[1])) if top else (p.plan(e), lambda: True)
        plans.append((e, top, left, right))
    p.run()
    out = []
    for i, (e, top, left, right) in enumerate(plans):
        a, b = left(), right()
        r = _compare(e.op, a, b) if top else a
        if isinstance(r, No):
            out.append((i, e.text(), "unevaluable", None, None, r.reason))
        else:
            out.append((i, e.text(), "passed" if _truth(r) else "failed", show(a), show(b), None))
    return spark.createDataFrame(out, RESULT)


def features(assertions: list[tuple[str, str, Expr]]) -> list[tuple[str, str, int, str, str, str, str, str]]:
    """(suite, assertion, ordinal, question, selector_kind, table, column, use) of every place that an expression names, for the audit."""
    out = []

    def walk(suite: str, name: str, e: object, question: str) -> None:
        if isinstance(e, Expr):
            for x in e.args:
                walk(suite, name, x, e.op if e.op not in ("and", "or", "not", *_ORDER) else question)
        elif isinstance(e, Col):
            out.append((suite, name, len(out), question, e.sel.which, e.sel.table, e.column, "read"))
            walk(suite, name, e.sel, question)
        elif isinstance(e, Sel):
            out.append((suite, name, len(out), question, e.which, e.table, "*", "select"))
            out.extend((suite, name, len(out) + i, question, e.which, b, "*", "except") for i, b in enumerate(e.but))
            out.extend((suite, name, len(out) + i, question, e.which, e.table, c, "match") for i, (c, _) in enumerate(e.where_))

    for suite, name, e in assertions:
        walk(suite, name, e, "")
    return out


FEATURES = "suite string, assertion_id string, ordinal int, question string, selector_kind string, table_name string, column_name string, use_kind string"
