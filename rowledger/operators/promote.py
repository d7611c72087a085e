"""Promotion: observed changes to candidate assertions, as rows (table, rule, expression, caveat, tree).

``expression`` is the text for people; ``tree`` is the same as JSON, which ``plans.tree`` reads, decides and prunes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import is_numeric, key_label
from ..plans import tree
from .capture import DELETE, INSERT, LEFT, UPDATE, VALUE
from .select import delta

SHAPE = "table string, rule string, expression string, caveat string, tree string"
#: Names of columns that tell kinds of rows apart, and what changes on every run.
DISCRIMINATORS = ("type", "status", "kind", "state", "reason", "currency", "category")
VOLATILE_NAME = r"(?i)(^|_)(created|updated|modified|deleted|inserted|expires?)(_?(at|on|time))?$|_at$|(^|_)(ts|timestamp|time|version|etag|nonce|token|uuid|touched|last_seen)$"
VOLATILE_TYPES = ("timestamp", "timestamp_ntz", "time", "interval", "xid")


def volatile(name: str, dtype: T.DataType) -> bool:
    import re

    return bool(re.search(VOLATILE_NAME, name)) or dtype.simpleString().startswith(VOLATILE_TYPES)


def spell(c: Column, variables: dict[str, str] | None = None) -> Column:
    """A value as a literal; a captured value becomes its variable; NULL if it cannot be spelled (control characters)."""
    s = c.cast("string")
    lit = F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    out = F.when(s.isNull(), "null").when(s.rlike(r"[\x00-\x1f\x7f]"), None).otherwise(lit)
    for name, value in (variables or {}).items():
        if name not in ("run", "now"):
            out = F.when(s == value, "{{" + name + "}}").otherwise(out)
    return out


def _row(table: Column | str, rule: str, expression: Column, as_tree: Column, caveat: Column | None = None) -> list[Column]:
    return [(F.col(table) if isinstance(table, str) else table).alias("table"), F.lit(rule).alias("rule"), expression.alias("expression"), (caveat if caveat is not None else F.lit(None).cast("string")).alias("caveat"), as_tree.alias("tree")]


def table_counts(changes: DataFrame) -> DataFrame:
    """count(inserted(t)) and count(deleted(t)) for each table that has such rows."""
    which = F.when(F.col("kind") == INSERT, "inserted").when(F.col("kind").isin(DELETE, LEFT), "deleted")
    d = changes.select("table", which.alias("which")).where("which is not null").groupBy("table", "which").agg(F.count("*").alias("n"))
    return d.select(*_row("table", "count", F.format_string("count(%s(%s)) == %d", "which", "table", "n"), tree.flat("count", F.col("which"), F.col("table"), [], tree.number(F.col("n")))))


def discriminator_counts(changes: DataFrame, masked: tuple[str, ...] = (), columns: tuple[str, ...] | None = None) -> DataFrame:
    """One count for each value of a telling column among inserted rows; the column is withheld if any of them is NULL or masked."""
    names = [f.name for f in changes.schema["after"].dataType.fields]
    use = [c for c in names if (c.lower() in DISCRIMINATORS if columns is None else c in columns) and c not in masked]
    if not use:
        return changes.sparkSession.createDataFrame([], SHAPE)
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"after.{c}").cast("string").alias("v")) for c in use))
    d = changes.where(F.col("kind") == INSERT).select("table", F.explode(pairs).alias("p")).groupBy("table", "p.c", "p.v").agg(F.count("*").alias("n"))
    bad = d.where("v is null").select("table", "c")
    d = d.join(bad, ["table", "c"], "left_anti").withColumn("lit", spell(F.col("v"))).where("lit is not null")
    return d.select(*_row("table", "discriminator", F.format_string("count(inserted(%s, %s = %s)) == %d", "table", "c", "lit", "n"), tree.flat("count", "inserted", F.col("table"), [tree.matched(F.col("c"), tree.spelled(F.col("v")))], tree.number(F.col("n")))))


def _update_rows(changes: DataFrame, keys: list[str]) -> DataFrame:
    return changes.where((F.col("kind") == UPDATE) & F.col("key_token").isNotNull())


def _where_key(keys: list[str], variables: dict[str, str] | None) -> Column:
    return F.concat_ws(", ", *(F.concat(F.lit(f"{k} = "), spell(F.col(f"after.{k}"), variables)) for k in keys))


def update_candidates(changes: DataFrame, keys: list[str], masked: tuple[str, ...] = (), variables: dict[str, str] | None = None) -> DataFrame:
    """For each updated row: the delta of each visible numeric column, the value of each other one; volatile and masked
    columns are passed over; a row with nothing to offer says only that it was written, and why."""
    if any(k in masked for k in keys):
        return changes.sparkSession.createDataFrame([], SHAPE)
    fields = [f for f in changes.schema["after"].dataType.fields if f.name not in keys]
    calm = [f for f in fields if f.name not in masked and not volatile(f.name, f.dataType)]
    d = _update_rows(changes, keys).withColumn("at", _where_key(keys, variables)).withColumn("_where", F.array(*(tree.matched(k, tree.spelled(F.col(f"after.{k}"), variables)) for k in keys)))
    made_of = lambda question, which, right, **of: tree.flat(question, which, F.col("table"), F.col("_where"), right, **of)
    offers = []
    for f in calm:
        if is_numeric(f.dataType):
            change = delta(changes, f.name).cast("string")
            text = F.when(change.isNotNull(), F.concat(F.lit("delta(single(rows("), "table", F.lit(", "), "at", F.lit(f")).{f.name}) == "), F.lit('"'), _plain(change), F.lit('"')))
            rule, as_tree = "delta", made_of("value", "rows", F.struct(F.lit("text").alias("kind"), _plain(change).alias("value")), side="delta", column=f.name, one=True)
        else:
            text = F.concat(F.lit("single(updated("), "table", F.lit(", "), "at", F.lit(f")).after.{f.name} == "), spell(F.col(f"after.{f.name}"), variables))
            rule, as_tree = "value", made_of("value", "updated", tree.spelled(F.col(f"after.{f.name}"), variables), side="after", column=f.name, one=True)
        offers.append(F.when(F.array_contains("visible_columns", f.name) & text.isNotNull(), F.struct(F.lit(rule).alias("rule"), text.alias("expression"), F.lit(None).cast("string").alias("caveat"), as_tree.alias("tree"))))
    kinds = {f.name: "masked" if f.name in masked else "volatile" if volatile(f.name, f.dataType) else "unspellable" for f in fields}
    why = F.array_join(F.array_distinct(F.transform("visible_columns", lambda c: reduce(lambda x, y: x.when(c == y[0], y[1]), kinds.items(), F.when(F.lit(False), "")).otherwise("ignored"))), ", ")
    only = F.struct(F.lit("write").alias("rule"), F.concat(F.lit("hasWrite(changes("), "table", F.lit(", "), "at", F.lit(")) == true")).alias("expression"), F.when(F.size("visible_columns") == 0, "no value changed").otherwise(why).alias("caveat"), made_of("hasWrite", "changes", _flag(True)).alias("tree"))
    made = F.array_compact(F.array(*offers)) if offers else F.array().cast("array<struct<rule:string,expression:string,caveat:string,tree:string>>")
    d = d.where("at is not null").select("table", F.explode(F.when(F.size(made) > 0, made).otherwise(F.array(only))).alias("o"))
    return d.select("table", "o.rule", "o.expression", "o.caveat", "o.tree")


def _flag(value: bool) -> Column:
    return F.struct(F.lit("boolean").alias("kind"), F.lit("true" if value else "false").alias("value"))


def _plain(c: Column) -> Column:
    """Without trailing zeros beyond the point: the shortest spelling of a decimal."""
    return F.when(c.contains("."), F.regexp_replace(F.regexp_replace(c, r"0+$", ""), r"\.$", "")).otherwise(c)


def invariants(changes: DataFrame, columns: list[str] | None = None, masked: tuple[str, ...] = (), keys: list[str] | None = None) -> DataFrame:
    """sum(delta(t.c)) == total for tables with two updates or more, if every one of them can be read."""
    fields = [f for f in changes.schema["after"].dataType.fields if is_numeric(f.dataType) and f.name not in masked and f.name not in (keys or []) and (columns is None or f.name in columns) and not volatile(f.name, f.dataType)]
    if not fields:
        return changes.sparkSession.createDataFrame([], SHAPE)
    up = changes.where(F.col("kind") == UPDATE)
    aggs = []
    for i, f in enumerate(fields):
        v = delta(changes, f.name)
        aggs += [F.try_sum(v).alias(f"s{i}"), F.count_if(v.isNull()).alias(f"b{i}"), F.count_if(F.array_contains("visible_columns", f.name)).alias(f"v{i}")]
    d = up.groupBy("table").agg(F.count("*").alias("n"), *aggs).where("n >= 2")
    lines = []
    for i, f in enumerate(fields):
        total = _plain(F.col(f"s{i}").cast("string"))
        as_tree = tree.flat("sum", "changes", F.col("table"), [], F.struct(F.lit("text").alias("kind"), total.alias("value")), side="delta", column=f.name)
        text = F.concat(F.lit("sum(delta("), "table", F.lit(f".{f.name})) == \""), total, F.lit('"'))
        lines.append(F.when((F.col(f"b{i}") == 0) & (F.col(f"v{i}") > 0) & F.col(f"s{i}").isNotNull(), F.struct(text.alias("expression"), as_tree.alias("tree"))))
    return d.select("table", F.explode(F.array_compact(F.array(*lines))).alias("o")).select(*_row("table", "invariant", F.col("o.expression"), F.col("o.tree"), F.lit("the total is of updates; the assertion also sees inserts and deletes")))


def nothing_changed(spark: SparkSession, changes: DataFrame, detection: str) -> DataFrame:
    caveat = F.lit("a write that changes no value would not be seen" if detection == VALUE else None)
    return changes.agg(F.count("*").alias("n")).where("n = 0").select(*_row(F.lit(None).cast("string"), "nothing", F.lit("hasWrite(changes(*)) == false"), tree.flat("hasWrite", "changes", "*", [], _flag(False)), caveat))


def response_status(responses: DataFrame, status: str = "status") -> DataFrame:
    return responses.select(*_row(F.lit(None).cast("string"), "response", F.concat(F.lit("response.status == "), F.col(status).cast("string")), F.lit(None).cast("string")))


def withheld(changes: DataFrame, keys: list[str], masked: tuple[str, ...]) -> DataFrame:
    """Rows that no candidate may name, their key being masked: (table, label), each once."""
    if not any(k in masked for k in keys):
        return changes.sparkSession.createDataFrame([], "table string, label string")
    image = F.coalesce(F.col("after"), F.col("before"))
    return changes.select("table", key_label([image[k] for k in keys], [k in masked for k in keys]).alias("label")).distinct().orderBy("table", "label")


def candidates(frames: list[DataFrame]) -> DataFrame:
    """All candidates, in the order of the frames, each expression once (the first)."""
    d = reduce(DataFrame.unionByName, (f.withColumn("_o", F.lit(i)) for i, f in enumerate(frames)))
    return d.groupBy("expression").agg(F.min_by(F.struct("table", "rule", "caveat", "tree"), "_o").alias("r"), F.min("_o").alias("ordinal")).select("r.table", "r.rule", "expression", "r.caveat", "r.tree", "ordinal")
