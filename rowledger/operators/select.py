"""Selections over a change set: by table, kind and equality; images and deltas of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import eq_typed, exact, key_token, minus
from .capture import DELETE, ENTERED, INSERT, LEFT, UNCHANGED, UPDATE, ChangeSet, canonical

KINDS = {"changes": (INSERT, UPDATE, DELETE, LEFT, ENTERED), "inserted": (INSERT, ENTERED), "updated": (UPDATE,), "deleted": (DELETE, LEFT)}


def of_kind(changes: DataFrame, which: str) -> DataFrame:
    """changes, inserted, updated or deleted rows."""
    return changes.where(F.col("kind").isin(*KINDS[which]))


def everything(cs: ChangeSet, which: str = "changes", but: tuple[str, ...] = ()) -> DataFrame:
    """Changes of all watched tables but those named, in the common shape; an unknown name is an error."""
    unknown = sorted(set(but) - set(cs.changes))
    if unknown:
        raise ValueError(f"not watched: {', '.join(unknown)}")
    return reduce(DataFrame.unionByName, (canonical(of_kind(d, which)) for t, d in sorted(cs.changes.items()) if t not in but))


def shown_value(column: str) -> Column:
    """The column in the after image, or in the before image if the row has no after image."""
    return F.when(F.col("after").isNotNull(), F.col(f"after.{column}")).otherwise(F.col(f"before.{column}"))


def type_of(changes: DataFrame, column: str) -> str:
    return changes.schema["after"].dataType[column].dataType.simpleString()


def matches(changes: DataFrame, predicate: dict[str, object], kinds: dict[str, str] | None = None) -> Column:
    """A conjunction of typed equalities; None is NULL. ``kinds`` names types that the frame's own do not tell (json, citext)."""
    terms = [eq_typed(shown_value(c), F.lit(v), (kinds or {}).get(c, type_of(changes, c))) for c, v in predicate.items()]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def where(changes: DataFrame, predicate: dict[str, object], kinds: dict[str, str] | None = None) -> DataFrame:
    return changes.where(matches(changes, predicate, kinds))


def at_step(changes: DataFrame, step: object) -> DataFrame:
    return changes.where(F.col("step_id") == F.lit(step))


def equals(frame: DataFrame, predicate: dict[str, object]) -> Column:
    """A conjunction of typed equalities over the columns of a table."""
    return reduce(lambda a, b: a & b, (eq_typed(F.col(c), F.lit(v), frame.schema[c].dataType.simpleString()) for c, v in predicate.items()), F.lit(True))


def rows(cs: ChangeSet, table: str, predicate: dict[str, object] | None = None, cap: int | None = None, by: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """(changed rows and the current rows that did not change, whether that is all of them).

    ``by`` names columns that changed and current rows have beside their images, as the run of frames of many runs: rows meet
    within them.

    Current rows stand as unchanged, before equal to after. Keyed tables leave out current rows by token; keyless ones
    leave out as many equal rows as were changed. The cap is on current rows only."""
    scope, changed = cs.scope.tables[table], cs.changes[table]
    if predicate:
        changed = where(changed, predicate)
    now = cs.current[table]
    now = now.where(scope.where) if scope.where else now
    if predicate:
        now = now.where(equals(now, predicate))
    whole = True
    if cap is not None:
        whole = now.limit(cap + 1).count() <= cap
        now = now.limit(cap)
    cols = [c for c in now.columns if c in changed.schema["after"].dataType.names]
    image = F.struct(*(F.lit(None).cast(now.schema[c].dataType).alias(c) if c in scope.masked else F.col(c) for c in cols))
    key = F.array(*(F.struct(F.lit(k).alias("column"), F.col(k).cast("string").alias("value")) for k in scope.keys)) if scope.keys else F.lit(None).cast("array<struct<column:string,value:string>>")
    token = key_token(cs.scope.salt, [F.col(k) for k in scope.keys], list(scope.keys)) if scope.keys else F.lit(None).cast("string")
    names = F.lit(None).cast("array<string>")
    unchanged = [F.lit(table).alias("table"), key.alias("key"), token.alias("key_token"), F.lit(UNCHANGED).alias("kind"), image.alias("before"), image.alias("after"), names.alias("changed_columns"), names.alias("visible_columns"), F.lit(False).alias("has_write")]
    if scope.keys:
        # one outer join, so that the changes are made once: a row of it is a changed one or, without one, a current one
        at, own = [*by, "key_token"], [c for c in changed.columns if c not in by]
        here = now.select(*by, *unchanged).select(*at, F.struct(*own).alias("_now"))
        there = changed.select(*at, F.struct(*own).alias("_changed"))
        return here.join(there, at, "full_outer").select(*by, F.coalesce("_changed", "_now").alias("_r")).select(*by, "_r.*").select(*changed.columns), whole
    beside = [c for c in cols if c not in by]
    new = changed.where(F.col("after").isNotNull()).select(*by, *(F.col(f"after.{c}") for c in beside))
    still = now.select(*by, *beside).exceptAll(new) if not scope.masked else now
    still = still.select(*by, *unchanged)
    return changed.unionByName(still), whole


def before(changes: DataFrame, column: str) -> DataFrame:
    """(table, key_token, value) from rows that have a before image; a NULL in it is a value."""
    return changes.where(F.col("before").isNotNull()).select("table", "key_token", F.col(f"before.{column}").alias("value"))


def after(changes: DataFrame, column: str) -> DataFrame:
    return changes.where(F.col("after").isNotNull()).select("table", "key_token", F.col(f"after.{column}").alias("value"))


def delta(changes: DataFrame, column: str) -> Column:
    """after - before, exactly; a missing image counts 0; NULL if a present image holds NULL or no number."""
    dtype = changes.schema["after"].dataType[column].dataType
    a, b = (exact(F.col(f"{s}.{column}"), dtype) for s in ("after", "before"))
    scale = changes.select(a.alias("x")).schema["x"].dataType.scale
    zero = F.lit(0).cast(f"decimal(38,{scale})")
    side = lambda s, v: F.when(F.col(s).isNotNull(), v).otherwise(zero)
    return minus(side("after", a), side("before", b), scale)
