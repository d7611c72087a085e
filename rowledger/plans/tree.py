"""Assertions as data: a JSON tree for each, and candidates decided where they lie.

``encode`` and ``decode`` carry any expression of ``check`` to JSON text and back. Comparisons of
one question with one value, which is what promotion offers, have a flat form that Spark reads
as a struct; ``decide`` evaluates a frame of them, whatever their number, without bringing them
to the driver: candidates that ask alike (same table, same columns matched) share one aggregate of the
changes by the matched values, and meet it by a join. Only the kinds of questions are
collected, whose number depends on the columns of the tables and not on the rows.
"""

from __future__ import annotations

import json
from dataclasses import replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import BOOLEANS, JSON, NUMBERS, boolean_of, canonical_json, digits_of
from ..operators import select
from ..operators.capture import ChangeSet
from . import runs
from .check import _ORDER, Col, Expr, Sel

VALUE = "struct<kind:string,value:string>"
FLAT = f"op string, left struct<question:string,select:string,table:string,but:array<string>,where:array<struct<column:string,kind:string,value:string>>,side:string,column:string,one:boolean>, right {VALUE}"


def _spelled(x: object) -> dict:
    if isinstance(x, Expr) and x.op == "var":
        return {"kind": "var", "value": x.args[0]}
    if x is None:
        return {"kind": "null"}
    if isinstance(x, bool):
        return {"kind": "boolean", "value": "true" if x else "false"}
    if isinstance(x, int | Decimal):
        return {"kind": "number", "value": format(x, "f") if isinstance(x, Decimal) else str(x)}
    return {"kind": "text", "value": str(x)}


def _read(x: dict) -> object:
    kind, v = x["kind"], x.get("value")
    if kind == "number":
        return int(v) if v.lstrip("+-").isdigit() else Decimal(v)
    return {"var": lambda: Expr("var", (v,)), "null": lambda: None, "boolean": lambda: v == "true", "text": lambda: v}[kind]()


def _tree(e: object) -> dict:
    if not isinstance(e, Expr) or e.op == "var":
        return _spelled(e)
    if e.op in _ORDER:
        return {"op": e.op, "left": _tree(e.args[0]), "right": _tree(e.args[1])}
    if e.op in ("and", "or", "not"):
        return {"op": e.op, "args": [_tree(x) for x in e.args]}
    what = e.args[0]
    sel = what.sel if isinstance(what, Col) else what
    out = {"question": e.op, "select": sel.which, "table": sel.table, "where": [{"column": c, **_spelled(v)} for c, v in sel.where_]}
    if sel.but:
        out["but"] = list(sel.but)
    if isinstance(what, Col):
        out |= {"side": what.side, "column": what.column, "one": what.one}
    return out


def encode(e: Expr) -> str:
    """An expression as JSON text."""
    return json.dumps(_tree(e), ensure_ascii=False)


def _expression(t: dict) -> object:
    if "kind" in t:
        return _read(t)
    if "args" in t:
        return Expr(t["op"], tuple(_expression(x) for x in t["args"]))
    if "op" in t:
        return Expr(t["op"], (_expression(t["left"]), _expression(t["right"])))
    sel = Sel(t["select"], t["table"], tuple((w["column"], _read(w)) for w in t.get("where") or ()), tuple(t.get("but") or ()))
    return Expr(t["question"], (sel if t.get("column") is None else Col(sel, t["side"], t["column"], bool(t.get("one"))),))


def decode(text: str) -> Expr:
    """The expression of a JSON text that ``encode`` or promotion wrote."""
    return _expression(json.loads(text))


# -- trees that Spark writes ---------------------------------------------------------


def spelled(c: Column, variables: dict[str, str] | None = None) -> Column:
    """(kind, value) of a cell; what was captured becomes its variable."""
    s = c.cast("string")
    value = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    out = F.when(s.isNull(), value("null", F.lit(None).cast("string"))).otherwise(value("text", s))
    for name, v in (variables or {}).items():
        if name not in ("run", "now"):
            out = F.when(s == v, value("var", F.lit(name))).otherwise(out)
    return out


def matched(column: Column | str, value: Column) -> Column:
    """An entry of ``where``."""
    return F.struct((F.lit(column) if isinstance(column, str) else column).alias("column"), value["kind"].alias("kind"), value["value"].alias("value"))


def flat(question: str, which: Column | str, table: Column | str, where: list[Column] | Column, right: Column, op: str = "==", side: str | None = None, column: str | None = None, one: bool = False) -> Column:
    """The JSON text of a comparison of one question with one value (a struct of kind and value)."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    empty = F.array().cast("array<struct<column:string,kind:string,value:string>>")
    where = where if isinstance(where, Column) else F.array(*where) if where else empty
    left = [F.lit(question).alias("question"), lit(which).alias("select"), lit(table).alias("table"), where.alias("where")]
    if column is not None:
        left += [F.lit(side).alias("side"), F.lit(column).alias("column"), F.lit(one).alias("one")]
    return F.to_json(F.struct(F.lit(op).alias("op"), F.struct(*left).alias("left"), right.alias("right")))


def number(c: Column) -> Column:
    return F.struct(F.lit("number").alias("kind"), c.cast("string").alias("value"))


# -- candidates as rows -----------------------------------------------------------------


def canonical(c: Column, kind: str) -> Column:
    """A text that is equal for two values exactly if they are equal under the type's meaning; NULL is a value."""
    kind, s = kind.lower().split("(")[0], c.cast("string")
    if kind in NUMBERS:
        same = F.to_json(digits_of(s))
    elif kind in BOOLEANS:
        same = boolean_of(s).cast("string")
    elif kind in JSON:
        same = canonical_json(s)
    else:
        same = F.lower(s) if kind == "citext" else s
    return F.when(s.isNull(), "null").when(same.isNull(), F.concat(F.lit("raw "), s)).otherwise(F.concat(F.lit("is "), same))


def decide(cs: ChangeSet, candidates: DataFrame, variables: dict[str, str] | None = None, rows_cap: int | None = None, kinds: dict[str, dict[str, str]] | None = None, tree: str = "tree") -> DataFrame:
    """Adds status, actual, expected and reason to candidates, as ``check.evaluate`` would find for each of them.

    A tree that is no comparison of one question with one value is unevaluable here, and says so."""
    names, known = candidates.columns, variables or {}
    d = candidates.withColumn("_t", F.from_json(tree, FLAT))
    where = F.coalesce("_t.left.where", F.array().cast("array<struct<column:string,kind:string,value:string>>"))
    captured = F.create_map(*(F.lit(x).cast("string") for kv in known.items() for x in kv)) if known else F.lit(None).cast("map<string,string>")
    value_of = lambda v: F.when(v["kind"] == "var", F.try_element_at(captured, v["value"])).otherwise(v["value"])
    unknown = lambda v: (v["kind"] == "var") & ~F.coalesce(F.map_contains_key(captured, v["value"]), F.lit(False))
    lost = lambda name: F.when(name.isNotNull(), F.concat(F.lit("no value was captured for "), name))
    d = d.withColumn("_values", F.transform(where, value_of)).withColumn("_lost", lost(F.get(F.filter(where, unknown), F.lit(0))["value"]))
    right = F.struct(lost(F.when(unknown(F.col("_t.right")), F.col("_t.right.value"))).alias("no"), F.when(value_of(F.col("_t.right")).isNull(), "null").when(F.col("_t.right.kind") == "var", "text").otherwise(F.col("_t.right.kind")).alias("kind"), value_of(F.col("_t.right")).alias("text"))
    d = d.withColumn("_b", right)
    columns = F.transform(where, lambda w: w["column"])
    left = F.col("_t.left")
    shape = F.struct(left["question"].alias("question"), left["select"].alias("select"), left["table"].alias("table"), F.coalesce(left["but"], F.array().cast("array<string>")).alias("but"), columns.alias("columns"), left["side"].alias("side"), left["column"].alias("column"), F.coalesce(left["one"], F.lit(False)).alias("one"))
    d = d.withColumn("_shape", F.when(left["question"].isNotNull() & F.col("_t.right.kind").isNotNull() & F.col("_t.op").isin(*_ORDER), F.to_json(shape)))
    # as many as there are ways to ask about the columns of the tables
    shapes = [(r["_shape"], json.loads(r["_shape"])) for r in d.select("_shape").where("_shape IS NOT NULL").distinct().collect()]
    groups: dict[tuple, list[tuple[str, dict]]] = {}
    for text, x in sorted(shapes, key=lambda s: s[0]):
        groups.setdefault((x["table"], tuple(x["but"]), tuple(x["columns"])), []).append((text, x))
    parts = [_part(cs, d, list(asked), rows_cap, kinds or {}) for asked in groups.values()]
    odd = d.where("_shape IS NULL").withColumn("_a", runs.refusal("only comparisons of one question with one value are decided here"))
    d = reduce(DataFrame.unionByName, (x.select(*names, "_t", "_b", F.when(F.col("_lost").isNotNull(), runs.refusal(F.col("_lost"))).otherwise(F.col("_a")).alias("_a")) for x in [*parts, odd]))
    a, b, op = F.col("_a"), F.col("_b"), F.col("_t.op")
    d = d.withColumn("_p", runs.number(a)).withColumn("_q", runs.number(b))
    d = d.withColumn("_r", F.when(op.isNull(), a).otherwise(runs.compared(op, a, b, F.col("_p"), F.col("_q"))))
    no = F.col("_r.no").isNotNull()
    shown = lambda v: F.when(~no, F.when(v["kind"] == runs.NULL, "null").otherwise(v["text"]))
    holds = (F.col("_r.kind") == runs.BOOLEAN) & (F.col("_r.text") == "true")
    return d.select(*names, F.when(no, "unevaluable").when(holds, "passed").otherwise("failed").alias("status"), shown(a).alias("actual"), shown(b).alias("expected"), F.col("_r.no").alias("reason"))


def _part(cs: ChangeSet, d: DataFrame, asked: list[tuple[str, dict]], cap: int | None, kinds: dict[str, dict[str, str]]) -> DataFrame:
    """Candidates of one table and one list of matched columns, with the answer to each one's question as ``_a``."""
    x = asked[0][1]
    d = d.where(F.col("_shape").isin(*(text for text, _ in asked)))
    sel = Sel("changes", x["table"], (), tuple(x["but"]))
    planner = runs.RunPlanner(cs, d.limit(0).select(F.array().cast("array<string>").alias("_key")), "_key", cap, kinds)
    bad = planner.known(replace(sel, where_=tuple((c, None) for c in x["columns"])))
    if bad is not None:
        return d.withColumn("_a", runs.refusal(bad.reason))
    tables = planner.tables(sel)
    kind_of = lambda t, c: kinds.get(t, {}).get(c, select.type_of(cs.changes[t], c))
    key = lambda t, cell: F.array(*(canonical(cell(c), kind_of(t, c)) for c in x["columns"])).cast("array<string>")
    changes = {t: cs.changes[t].withColumn("_key", key(t, select.shown_value)) for t in tables}
    now = {t: cs.current[t].withColumn("_key", key(t, F.col)) for t in tables if t in cs.current} if cs.current is not None else None
    writes = None
    if cs.mutations is not None:
        of_key = reduce(DataFrame.unionByName, (c.select("table", "key_token", "_key") for c in changes.values())).distinct()
        writes = cs.mutations.join(of_key, ["table", "key_token"])
    # several tables are asked without columns, or their types would have to agree
    d = d.withColumn("_key", F.array(*(canonical(F.col("_values")[i], kind_of(tables[0], c)) for i, c in enumerate(x["columns"]))).cast("array<string>"))
    keyed = replace(cs, changes=cs.changes | changes, current=now, mutations=writes)
    planner = runs.RunPlanner(keyed, d.select("_key").distinct(), "_key", cap, kinds)
    answers = {}
    for text, q in asked:
        s = replace(sel, which=q["select"])
        refused = planner.known(s)
        e = Expr(q["question"], (s if q.get("column") is None else Col(s, q["side"], q["column"], q["one"]),))
        answers[text] = runs.refusal(refused.reason) if refused is not None else planner.value_of(e)
    wide = planner.wide(None).select("_key", *(a.alias(f"_a{i}") for i, a in enumerate(answers.values())))
    own = reduce(lambda c, ia: c.when(F.col("_shape") == ia[1], F.col(f"_a{ia[0]}")), enumerate(answers), F.when(F.lit(False), F.lit(None).cast("struct<no:string,kind:string,text:string>")))
    return d.join(wide, "_key").withColumn("_a", own)


def prune(candidates: DataFrame, tree: str = "tree") -> DataFrame:
    """Leaves out candidates that others imply: a second one of equal meaning (numbers by value), that a row was written where
    another says how it changed, and that some rows are none where another says that nothing was written at all.

    What is left out is found by joins on the row's table and matched values; the order of what stays is that of its input
    (``ordinal``, if there is one, decides which of two equal ones stays)."""
    t = F.from_json(tree, FLAT)
    right = F.when(t["right"]["kind"].isin("number", "text"), F.coalesce(F.to_json(digits_of(t["right"]["value"])), F.concat(F.lit("raw "), t["right"]["value"])))
    d = candidates.withColumn("_t", t).withColumn("_m", F.when(t["left"]["question"].isNotNull(), F.to_json(F.struct(t["op"], t["left"], F.coalesce(right, F.to_json(t["right"])).alias("right")))).otherwise(F.col(tree)))
    order = F.col("ordinal") if "ordinal" in candidates.columns else F.lit(0)
    text = F.col("expression") if "expression" in candidates.columns else F.col(tree)
    one = d.groupBy("_m").agg(F.min_by(F.struct(*candidates.columns, "_t"), F.struct(order, text)).alias("c")).select("c.*")
    left, op, value = F.col("_t.left"), F.col("_t.op"), F.col("_t.right.value")
    at = F.to_json(F.struct(left["table"].alias("t"), left["where"].alias("w")))
    zero = F.to_json(digits_of(value)) == F.to_json(digits_of(F.lit("0")))
    wrote = (left["question"] == "hasWrite") & (op == "==") & (value == "true") & (F.size(left["where"]) > 0)
    tells = (left["question"] == "value") & (op == "==") & ((left["select"] == "updated") | ((left["side"] == "delta") & ~F.coalesce(zero, F.lit(False))))
    nothing = (left["question"] == "hasWrite") & (left["table"] == "*") & (op == "==") & (value == "false")
    none = ((left["question"] == "count") & (op == "==") & F.coalesce(zero, F.lit(False))) | ((left["question"] == "isEmpty") & (op == "==") & (value == "true"))
    one = one.withColumns({"_at": at, "_wrote": F.coalesce(wrote, F.lit(False)), "_none": F.coalesce(none & (left["select"] != "rows"), F.lit(False))})
    told = one.where(F.coalesce(tells, F.lit(False))).select("_at").distinct().withColumn("_told", F.lit(True))
    still = one.where(F.coalesce(nothing, F.lit(False))).agg((F.count("*") > 0).alias("_still"))
    d = one.join(told, "_at", "left").crossJoin(F.broadcast(still))  # one row
    implied = (F.col("_wrote") & F.col("_told").isNotNull()) | (F.col("_none") & F.col("_still"))
    return d.where(~implied).select(*candidates.columns)
