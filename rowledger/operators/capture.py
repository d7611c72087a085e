"""Capture: row changes between two versions of a table, since a version, or in a log.

A changes frame has, for one table: table, key columns as ``key``, key_token, kind,
before and after (structs of the row as shown, NULL where there is no image),
changed_columns, visible_columns, has_write. Detection reads raw values; masks and
ignored columns touch only what is shown.

Every operator is one or two equi-joins on the key, so Spark may sort-merge, split
skewed keys or, for tables bucketed by key, leave out the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import comparable, key_token
from ..sources.scope import KEYLESS, Scope, TableScope, prove_keys

INSERT, UPDATE, DELETE, LEFT, ENTERED, UNCHANGED = "insert", "update", "delete", "left-scope", "entered-scope", "unchanged"
WRITE, VALUE, NET, TRANSACTIONAL = "write", "value", "net", "transactional"
#: Copies of a row that one task gives out.
SLICE = 100_000
WARNINGS = "source string, code string, table string, message string"


@dataclass
class ChangeSet:
    """What one step changed: a frame for each table, with the capabilities that guards read."""

    changes: dict[str, DataFrame]
    scope: Scope
    detection: str
    fidelity: str
    warnings: DataFrame
    mutations: DataFrame | None = None
    current: dict[str, DataFrame] | None = None


def warn(spark: SparkSession, *rows: tuple[str, str, str, str]) -> DataFrame:
    return spark.createDataFrame(list(rows), WARNINGS)


def _watched(df: DataFrame, scope: TableScope) -> DataFrame:
    return df.where(scope.where) if scope.where else df


def _shown(side: str, columns: list[str], df: DataFrame, scope: TableScope) -> Column:
    """The row as reported: masked columns are NULL of their type."""
    return F.struct(*(F.lit(None).cast(df.schema[c].dataType).alias(c) if c in scope.masked else F.col(f"{side}.{c}").alias(c) for c in columns))


def _differs(columns: list[str], df: DataFrame) -> Column:
    """Names of the columns whose raw values differ, in the table's order."""
    flags = [F.when(~comparable(F.col(f"b.{c}"), df.schema[c].dataType).eqNullSafe(comparable(F.col(f"a.{c}"), df.schema[c].dataType)), F.lit(c)) for c in columns]
    return F.array_compact(F.array(*flags))


def _row(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def _finish(d: DataFrame, kind: Column, changed: Column, written: Column, after: DataFrame, scope: TableScope, salt: str) -> DataFrame:
    """From a frame of raw structs b and a to a changes frame."""
    cols = after.columns
    keys = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")) for k in scope.keys]
    token = key_token(salt, keys, list(scope.keys)) if scope.keys else F.lit(None).cast("string")
    key = F.array(*(F.struct(F.lit(n).alias("column"), F.lit(None).cast("string").alias("value") if n in scope.masked else k.cast("string").alias("value")) for n, k in zip(scope.keys, keys, strict=True))) if scope.keys else F.lit(None).cast("array<struct<column:string,value:string>>")
    out = d.withColumn("kind", kind).withColumn("changed_columns", changed)
    return out.select(
        F.lit(scope.name).alias("table"), key.alias("key"), token.alias("key_token"), "kind",
        F.when(F.col("b").isNotNull(), _shown("b", cols, after, scope)).alias("before"), F.when(F.col("a").isNotNull(), _shown("a", cols, after, scope)).alias("after"),
        "changed_columns", F.filter("changed_columns", lambda c: ~c.isin(*scope.ignore)).alias("visible_columns") if scope.ignore else F.col("changed_columns").alias("visible_columns"), written.alias("has_write"),
    )


def _all(columns: list[str]) -> Column:
    return F.array(*map(F.lit, columns))


def snapshot_diff(before: DataFrame, after: DataFrame, scope: TableScope, salt: str = "rowledger", proven: bool = False) -> DataFrame:
    """Two versions by key: insert, update (a column differs), delete (left-scope if the table is watched by a predicate).

    NULL is a key like another, unless the key is ``proven`` to have none: then tables bucketed by it need no shuffle.

    The predicate filters both versions below the join, so a row that enters its range is an insert."""
    b, a = _watched(before, scope), _watched(after, scope)
    # the keys stand beside the images, so that the tables' own partitioning is seen
    side = lambda d, n: d.select(*(F.col(f"`{k}`").alias(f"_{n}{i}") for i, k in enumerate(scope.keys)), _row(d).alias(n))
    pairs = [(F.col(f"_b{i}"), F.col(f"_a{i}"), before.schema[k].nullable and not proven) for i, k in enumerate(scope.keys)]
    on = reduce(lambda x, y: x & y, (x.eqNullSafe(y) if null else x == y for x, y, null in pairs))
    d = side(b, "b").join(side(a, "a"), on, "full_outer")
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    differs = _differs(after.columns, after)
    d = d.withColumn("differs", F.when(both, differs)).where(~both | (F.size("differs") > 0))
    kind = F.when(F.col("b").isNull(), INSERT).when(F.col("a").isNull(), LEFT if scope.where else DELETE).otherwise(UPDATE)
    return _finish(d, kind, F.coalesce("differs", _all(after.columns)), F.lit(True), after, scope, salt)


def wide_snapshot_diff(before: DataFrame, after: DataFrame, scope: TableScope, salt: str = "rowledger") -> DataFrame:
    """The same for wide rows of which few change: keys and row hashes meet first, images are fetched for the keys whose hashes
    differ, and compared exactly."""
    keys = list(scope.keys)
    h = lambda d, n: _watched(d, scope).select(*keys, F.xxhash64(*(comparable(F.col(f"`{c}`"), d.schema[c].dataType) for c in d.columns), *(F.col(f"`{c}`").isNull() for c in d.columns)).alias(n))
    moved = h(before, "hb").join(h(after, "ha"), keys, "full_outer").where(~F.col("hb").eqNullSafe(F.col("ha"))).select(*keys)
    return snapshot_diff(before.join(moved, keys, "left_semi"), after.join(moved, keys, "left_semi"), scope, salt)


def _net_counts(before: DataFrame, after: DataFrame, scope: TableScope) -> DataFrame:
    """Whole rows that are more (or fewer) afterwards, with ``_n``, by how many."""
    census = _watched(before, scope).withColumn("_n", F.lit(-1)).unionByName(_watched(after, scope).withColumn("_n", F.lit(1)))
    return census.groupBy(*(F.col(f"`{c}`") for c in after.columns)).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)


def multiset_diff(before: DataFrame, after: DataFrame, scope: TableScope, salt: str = "rowledger") -> DataFrame:
    """Keyless versions by counts of whole rows: surplus rows are inserts, missing ones deletes, each as often as it is so.

    Counts are combined before the one shuffle. A surplus of many copies is given out in slices of ``SLICE`` by several tasks."""
    cols = after.columns
    net = _net_counts(before, after, scope)
    row = F.struct(*(F.col(f"`{c}`") for c in cols)).alias("r")
    few = net.where(F.abs("_n") <= SLICE).select(row, F.col("_n").alias("n"), F.abs("_n").alias("k"))
    many = net.where(F.abs("_n") > SLICE).select(row, F.col("_n").alias("n"), F.abs("_n").alias("all"))
    many = many.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / SLICE)))).repartition("r", "slice")
    net = few.unionByName(many.select("r", "n", F.least(F.lit(SLICE), F.col("all") - F.col("slice") * SLICE).alias("k")))
    net = net.select("r", "n", F.explode(F.array_repeat(F.lit(1), F.col("k").cast("int"))))
    d = net.select(F.when(F.col("n") < 0, F.col("r")).alias("b"), F.when(F.col("n") > 0, F.col("r")).alias("a"))
    kind = F.when(F.col("b").isNull(), INSERT).otherwise(LEFT if scope.where else DELETE)
    return _finish(d, kind, _all(cols), F.lit(True), after, TableScope(scope.name, (), KEYLESS, scope.where, scope.ignore, scope.masked), salt)


def written_rows(after: DataFrame, scope: TableScope, version: str, since: object) -> DataFrame:
    """Rows written after a version: a filter that reaches the scan."""
    return _watched(after.where(F.col(version) > F.lit(since)), scope)


def before_images(before: DataFrame, keys: DataFrame, key_columns: list[str]) -> DataFrame:
    """Old rows of the given keys, the watch predicate left aside."""
    return before.join(keys.select(*key_columns), key_columns, "left_semi")


def departed_keys(before: DataFrame, after: DataFrame, scope: TableScope) -> DataFrame:
    """Keys of old rows in the watched range that no new row in it has; only key columns (and the predicate's) are read."""
    k = list(scope.keys)
    return _watched(before, scope).select(*k).join(_watched(after, scope).select(*k), k, "left_anti")


def written_since(before: DataFrame, after: DataFrame, scope: TableScope, version: str, since: object, salt: str = "rowledger") -> DataFrame:
    """Write detection: written rows with their old images (an insert without one, else an update even if no value
    differs), and departed rows. The version column itself is not compared.

    The old table is read once; of the new one, keys are read, and rows behind a filter that reaches the scan."""
    cols = [c for c in after.columns if c != version]
    w = written_rows(after, scope, version, since)
    if not scope.keys:
        d = w.select(F.lit(None).cast(w.select(*cols).schema).alias("b"), F.struct(*cols).alias("a"))
        return _finish(d, F.lit(INSERT), _all(cols), F.lit(True), after.select(*cols), scope, salt)
    # one scan of the old table: it meets the keys that are there now, then the written rows; its own keys deal out both joins
    keyed = lambda d, n: [F.col(c).alias(f"_{n}{i}") for i, c in enumerate(scope.keys)]
    same = lambda n: reduce(lambda x, y: x & y, (F.col(f"_b{i}") == F.col(f"_{n}{i}") for i in range(len(scope.keys))))
    there = F.coalesce(F.expr(scope.where), F.lit(False)) if scope.where else F.lit(True)
    old = before.select(*keyed(before, "b"), F.struct(*cols).alias("b"), there.alias("_was"))
    now = _watched(after, scope).select(*keyed(after, "n"), F.lit(True).alias("_is"))
    d = old.join(now, same("n"), "left").join(w.select(*keyed(w, "a"), F.struct(*cols).alias("a")), same("a"), "full_outer")
    d = d.where(F.col("a").isNotNull() | (F.col("_was") & F.col("_is").isNull()))
    kind = F.when(F.col("a").isNull(), LEFT if scope.where else DELETE).when(F.col("b").isNull(), INSERT).otherwise(UPDATE)
    changed = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), _differs(cols, after)).otherwise(_all(cols))
    return _finish(d, kind, changed, F.lit(True), after.select(*cols), scope, salt)


def departure_cause(changes: DataFrame, after: DataFrame, scope: TableScope) -> DataFrame:
    """Adds ``cause`` to left-scope rows: 'moved' if the key still exists outside the range, else 'deleted'."""
    k = list(scope.keys)
    there = after.select(*(F.col(c).alias(f"_{c}") for c in k), F.lit(True).alias("_there"))
    on = reduce(lambda x, y: x & y, (F.col(f"before.{c}") == F.col(f"_{c}") for c in k))
    return changes.join(there, on & (F.col("kind") == LEFT), "left").withColumn("cause", F.when(F.col("kind") == LEFT, F.when(F.col("_there"), "moved").otherwise("deleted"))).drop("_there", *(f"_{c}" for c in k))


def capture_snapshots(spark: SparkSession, before: dict[str, DataFrame], after: dict[str, DataFrame], scope: Scope, prove: bool = True) -> ChangeSet:
    """Value detection over all tables of a scope. A key that is not one (NULL or twice) downgrades its table to
    keyless with a warning, and a table over its row cap is left out with one."""
    frames, notes, tables = {}, [], {}
    keyed = {n: t for n, t in scope.tables.items() if t.keys and prove}
    # all tables' keys in one job
    proven = prove_keys(spark, {(n, side): (_watched(x[n], t), t.keys) for n, t in keyed.items() for side, x in (("b", before), ("a", after))})
    for name, t in scope.tables.items():
        b, a = before[name], after[name]
        if t.max_rows is not None and any(x.limit(t.max_rows + 1).count() > t.max_rows for x in (_watched(b, t), _watched(a, t))):
            notes.append(("capture", "scope-truncated", name, f"more than {t.max_rows} rows"))
            continue
        if name in keyed and not (proven[name, "b"] and proven[name, "a"]):
            notes.append(("capture", "degraded-row-identity", name, f"({', '.join(t.keys)}) is not a key"))
            t = TableScope(t.name, (), KEYLESS, t.where, t.ignore, t.masked, True)
        tables[name] = t
        if t.keys:
            frames[name] = snapshot_diff(b, a, t, scope.salt, prove)
        else:
            frames[name] = multiset_diff(b, a, t, scope.salt)
            # counts of whole rows tell, without the rows that a diff gives out
            if not any(n[2] == name for n in notes) and not _net_counts(b, a, t).isEmpty():
                notes.append(("capture", "degraded-row-identity", name, "rows have no key"))
    return ChangeSet(frames, Scope(tables, scope.all_tables, scope.salt), VALUE, NET, warn(spark, *notes), None, after)


def capture_written(spark: SparkSession, before: dict[str, DataFrame], after: dict[str, DataFrame], scope: Scope, version: str, since: object) -> ChangeSet:
    """Write detection over all tables of a scope. Keyless tables always warn: their updates look like inserts."""
    frames = {n: written_since(before[n], after[n], t, version, since, scope.salt) for n, t in scope.tables.items()}
    notes = [("capture", "degraded-row-identity", n, "rows have no key; departures cannot be seen") for n, t in scope.tables.items() if not t.keys]
    return ChangeSet(frames, scope, WRITE, NET, warn(spark, *notes), None, {n: d.drop(version) for n, d in after.items()})


def canonical(changes: DataFrame) -> DataFrame:
    """The common shape of all tables' changes: images as maps of column to text."""
    names = [f.name for f in changes.schema["after"].dataType.fields]
    image = lambda s: F.when(F.col(s).isNotNull(), F.map_from_arrays(_all(names), F.array(*(F.col(f"{s}.{c}").cast("string") for c in names))))
    return changes.withColumn("before", image("before")).withColumn("after", image("after"))


def log_net_view(log: DataFrame, keys: list[str], values: list[str], sequence: str = "sequence", operation: str = "operation") -> DataFrame:
    """One row for each key of a log that carries images: first and last operation of the window, net kind, last values.

    A first insert means that no row was there before, a last delete that none is there now; both together leave
    nothing and are dropped. Folded before the shuffle, so a key that is written very often is one row from each task."""
    o = F.col(sequence)
    g = log.groupBy(*keys).agg(F.min_by(operation, o).alias("first_op"), F.max_by(operation, o).alias("last_op"), F.count("*").alias("writes"), F.max_by(F.struct(*values), o).alias("_last"))
    had, has = F.col("first_op") != "insert", F.col("last_op") != "delete"
    g = g.where(had | has).withColumn("kind", F.when(had & has, UPDATE).when(has, INSERT).otherwise(DELETE))
    return g.select(*keys, "kind", "first_op", "last_op", "writes", *(F.when(has, F.col(f"_last.{v}")).alias(v) for v in values))


def noise_tables(idle: dict[str, DataFrame]) -> DataFrame:
    """Tables that changed over an idle window, from its changes frames: (table, changes)."""
    return reduce(DataFrame.unionByName, (d.groupBy("table").agg(F.count("*").alias("changes")) for d in idle.values()))


def noise_warning(idle: dict[str, DataFrame]) -> DataFrame:
    n = noise_tables(idle)
    return n.select(F.lit("baseline").alias("source"), F.lit("concurrent-writes-detected").alias("code"), "table", F.format_string("%d rows changed while idle", "changes").alias("message"))


def attribute(changes: DataFrame, noise: DataFrame) -> DataFrame:
    """Adds maybe_foreign: the table also changes when nothing is asked of it."""
    return changes.join(noise.select("table", F.lit(True).alias("_n")), "table", "left").withColumn("maybe_foreign", F.coalesce("_n", F.lit(False))).drop("_n")


def rewritten(before_ids: DataFrame, after_ids: DataFrame) -> DataFrame:
    """Warnings for tables whose identity (path, id or schema fingerprint) changed or that are gone: (table, identity) on both sides."""
    j = before_ids.withColumnRenamed("identity", "_b").join(after_ids.withColumnRenamed("identity", "_a"), "table", "left").where(~F.col("_b").eqNullSafe(F.col("_a")))
    return j.select(F.lit("capture").alias("source"), F.lit("scope-truncated").alias("code"), "table", F.when(F.col("_a").isNull(), "the table is gone").otherwise("the table was rewritten").alias("message"))




# -- versions kept by range -----------------------------------------------------------


#: Ranges up to this number that differ are named to the scan; more are met by a join that prunes.
MOST_RANGES = 10_000


def range_of(df: DataFrame, scope: TableScope, ranges: int = 1024, width: int | None = None) -> Column:
    """The range of a row: by its key's value where ``width`` is given (one whole number as the key, so that neighbours lie together),
    else by a hash of its key, or of the whole row without one."""
    if width is not None:
        if len(scope.keys) != 1:
            raise ValueError("ranges by value need a key of one column")
        return F.floor(F.col(f"`{scope.keys[0]}`") / F.lit(width)).cast("long")
    cells = [comparable(F.col(f"`{c}`"), df.schema[c].dataType) for c in (scope.keys or df.columns)]
    return F.pmod(F.xxhash64(*cells), F.lit(ranges)).cast("long")


def digests(df: DataFrame, columns: list[str], by: str = "_range") -> DataFrame:
    """(range, rows, h0, h1): the number of rows and two sums of their hashes. Sums add up: see ``merge_digests``."""
    cells = [c for n in columns for c in (comparable(F.col(f"`{n}`"), df.schema[n].dataType), F.col(f"`{n}`").isNull())]
    h = lambda i: F.xxhash64(F.lit(i), *cells).cast("decimal(38,0)")
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.sum(h(0)).alias("h0"), F.sum(h(1)).alias("h1"))


def merge_digests(*parts: DataFrame, by: str = "_range") -> DataFrame:
    """The digests of rows that lie in several tables."""
    return reduce(DataFrame.unionByName, parts).groupBy(by).agg(F.sum("rows").alias("rows"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1"))


def write_version(df: DataFrame, path: str, scope: TableScope, ranges: int = 1024, width: int | None = None) -> None:
    """Store a version of a table by range, with the digests of its ranges."""
    d = df.withColumn("_range", range_of(df, scope, ranges, width))
    keys = [F.col(f"`{c}`") for c in scope.keys] or [F.xxhash64(*(comparable(F.col(f"`{c}`"), df.schema[c].dataType) for c in df.columns))]
    d.repartitionByRange(F.col("_range"), *keys).write.partitionBy("_range").parquet(f"{path}/rows")
    stored = read_version(df.sparkSession, path)
    digests(stored, df.columns).write.parquet(f"{path}/digests")


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """A stored version, with its ``_range``."""
    d = spark.read.parquet(f"{path}/rows")
    return d.withColumn("_range", F.col("_range").cast("long"))


def changed_ranges(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(range): those of two stored versions that differ, told from the digests alone. A range of rows without a key value is always among them."""
    d = [spark.read.parquet(f"{p}/digests") for p in (old, new)]
    both = d[0].select("_range", F.struct("rows", "h0", "h1").alias("b")).join(d[1].select("_range", F.struct("rows", "h0", "h1").alias("a")), "_range", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("_range")


def diff_versions(spark: SparkSession, old: str, new: str, scope: TableScope, salt: str = "rowledger") -> DataFrame:
    """The diff of two versions stored with the same ranges: only files of ranges that differ are read and shuffled.

    Equal to ``snapshot_diff`` (``multiset_diff`` without a key), but for versions of a range whose rows differ while their number and 128
    bits of their hashes' sums do not."""
    moved = changed_ranges(spark, old, new)
    few = [r["_range"] for r in moved.limit(MOST_RANGES + 1).collect()]
    sides = []
    for path in (old, new):
        d = spark.read.parquet(f"{path}/rows")
        # the column as it is stored, so that the filter names folders
        named = F.col("_range").isin([r for r in few if r is not None]) | (F.col("_range").isNull() if None in few else F.lit(False))
        d = d.where(named) if len(few) <= MOST_RANGES else d.join(moved.select(F.col("_range").alias("_r")), F.col("_range").eqNullSafe(F.col("_r")), "left_semi")
        sides.append(d.drop("_range"))
    return snapshot_diff(*sides, scope, salt) if scope.keys else multiset_diff(*sides, scope, salt)
