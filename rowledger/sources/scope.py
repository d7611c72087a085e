"""Scopes: which tables are watched, by which key, with what left out of sight."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import close_name, loose_limit, typing_distance

PRIMARY, UNIQUE, KEYLESS = "primary-key", "unique-index", "full-row-multiset"


@dataclass(frozen=True)
class TableScope:
    name: str
    keys: tuple[str, ...] = ()
    strategy: str = KEYLESS
    where: str | None = None
    ignore: tuple[str, ...] = ()
    masked: tuple[str, ...] = ()
    departures_observable: bool = True
    max_rows: int | None = None


@dataclass(frozen=True)
class Scope:
    tables: dict[str, TableScope]
    all_tables: bool = True
    salt: str = "rowledger"

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, t.where, list(t.ignore), list(t.masked), list(t.keys), t.strategy, t.departures_observable, self.all_tables) for t in self.tables.values()]
        return spark.createDataFrame(rows, "table string, where_expr string, ignore_columns array<string>, masked_columns array<string>, key_columns array<string>, key_strategy string, departures_observable boolean, all_tables boolean")


@dataclass
class Catalog:
    """Given tables and what is known of them."""

    tables: dict[str, DataFrame]
    declared: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign: tuple[str, ...] = ()
    parents: tuple[str, ...] = ()
    schemas: dict[str, str] = field(default_factory=dict)


def full_scope(catalog: Catalog, write_detection: bool = False, masked: tuple[str, ...] = (), ignore: tuple[str, ...] = (), salt: str = "rowledger") -> Scope:
    """All tables whose name does not begin with an underscore, in order. Keyless tables hide departures under write detection."""
    out = {}
    for name in sorted(catalog.tables):
        if name.startswith("_") or name in catalog.foreign:
            continue
        keys = catalog.declared.get(name, ())
        cols = catalog.tables[name].columns
        out[name] = TableScope(name, keys, PRIMARY if keys else KEYLESS, None, tuple(c for c in ignore if c in cols), tuple(c for c in masked if c in cols), bool(keys) or not write_detection)
    return Scope(out, True, salt)


def narrowed_scope(scope: Scope, watch: dict[str, dict]) -> Scope:
    """Only the listed tables, each with its own predicate and ignored columns; an unknown name is an error."""
    unknown = sorted(set(watch) - set(scope.tables))
    if unknown:
        raise ValueError(f"not in the catalog: {', '.join(unknown)}")
    out = {n: replace(scope.tables[n], where=w.get("where"), ignore=tuple(dict.fromkeys((*scope.tables[n].ignore, *w.get("ignore", ()))))) for n, w in watch.items()}
    return replace(scope, tables=out, all_tables=False)


def prove_key(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: rows, distinct keys, rows with a NULL in the key, and whether the columns are a key. One aggregation by key, combined before the shuffle."""
    null = F.exists(F.array(*(F.col(c).isNull() for c in columns)), lambda x: x)
    per = df.groupBy(*columns).agg(F.count("*").alias("n")).select("n", null.alias("null"))
    s = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys"), F.coalesce(F.sum(F.when(F.col("null"), F.col("n"))), F.lit(0)).alias("null_keys"))
    return s.withColumn("is_key", (F.col("rows") == F.col("distinct_keys")) & (F.col("null_keys") == 0))


def prove_keys(spark: SparkSession, tables: dict[object, tuple[DataFrame, tuple[str, ...]]]) -> dict[object, bool]:
    """``prove_key`` of many tables as one job: whether the columns are a key, by the names given."""
    if not tables:
        return {}
    each = [prove_key(d, k).select(F.lit(i).alias("i"), "is_key") for i, (d, k) in enumerate(tables.values())]
    found = {r["i"]: r["is_key"] for r in reduce(DataFrame.unionByName, each).collect()}  # a row for each table
    return {name: found[i] for i, name in enumerate(tables)}


#: Error of the estimates, and how many sets of columns one job estimates.
_ERROR, _SETS = 0.03, 1000


def estimate_distinct(df: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """Roughly how many distinct values each set of columns has. A row gives a hash for each set, which sketches count by set: they merge,
    so what is shuffled is a sketch for each set and task, and the plan does not grow with the sets."""
    out = {}
    for at in range(0, len(sets), _SETS):
        part = sets[at : at + _SETS]
        hashes = df.select(F.posexplode(F.array(*(F.xxhash64(*(F.col(f"`{c}`") for c in s), *(F.col(f"`{c}`").isNull() for c in s)) for s in part))).alias("i", "h"))
        got = {r["i"]: r["d"] for r in hashes.groupBy("i").agg(F.approx_count_distinct("h", _ERROR).alias("d")).collect()}  # a row for each set
        out |= {s: got.get(i, 0) for i, s in enumerate(part)}
    return out


def minimal_keys(df: DataFrame, most: int = 4, columns: list[str] | None = None, first_level_only: bool = False) -> list[tuple[str, ...]]:
    """All minimal keys of up to ``most`` columns: sets without NULL whose values are all distinct, none holding another one.

    Level by level: sets of k columns are made of sets of k - 1 that are no keys, so no set holds a key, and whatever is part of a set
    that is known to repeat is not looked at again. If all columns together repeat, there is no key and no search. A set whose columns
    have too few values among them is left out unseen; the others of a level are estimated by one job, and those that may be keys
    proven. ``first_level_only`` stops at the narrowest keys."""
    names = columns or df.columns
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"z{i}") for i, c in enumerate(names))).first()
    rows, names = facts["rows"], [c for i, c in enumerate(names) if not facts[f"z{i}"]]
    if not names or (rows and not prove_key(df, tuple(names)).first()["is_key"]):
        return []
    keys: list[tuple[str, ...]] = []
    values: dict[tuple[str, ...], int] = {}
    level = [(c,) for c in names]
    for size in range(1, min(most, len(names)) + 1):
        # at most as many values as the parts have together
        bound = lambda s: values[s[:-1]] * values[s[-1:]] if len(s) > 1 else rows
        enough = [s for s in level if bound(s) * (1 + 3 * _ERROR) ** 2 >= rows]
        values |= {s: min(bound(s), rows) for s in level} | (estimate_distinct(df, enough) if enough else {})
        found = [s for s in enough if values[s] >= (1 - 3 * _ERROR) * rows and prove_key(df, s).first()["is_key"]]
        keys += found
        if found and first_level_only:
            break
        rest = set(level) - set(found)
        place = {c: i for i, c in enumerate(names)}
        level = [(*s, c) for s in sorted(rest, key=lambda s: [place[x] for x in s]) for c in names[place[s[-1]] + 1 :] if all(tuple(x for x in (*s, c) if x != left) in rest for left in (*s, c))]
        if not level:
            break
    return keys


def infer_key(df: DataFrame, declared: tuple[str, ...] | None = None, candidates: list[tuple[str, ...]] | None = None, most: int = 3) -> tuple[tuple[str, ...], str]:
    """A declared key if it is one; else the narrowest candidate that is proven; else keyless. Without candidates, the narrowest of
    the keys of up to ``most`` columns (see ``minimal_keys``), the first in the order of the columns."""
    if declared and prove_key(df, declared).first()["is_key"]:
        return declared, PRIMARY
    if candidates is None:
        found = minimal_keys(df, most, first_level_only=True)
        return (found[0], UNIQUE) if found else ((), KEYLESS)
    if not candidates:
        return (), KEYLESS
    tries = sorted((tuple(c) for c in candidates), key=len)
    rows, seen = df.count(), estimate_distinct(df, tries)
    for c in tries:
        if seen[c] >= (1 - 3 * _ERROR) * rows and prove_key(df, c).first()["is_key"]:
            return c, UNIQUE
    return (), KEYLESS


def catalog_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, ordinal, column, type) of all tables; only schemas are read."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, d in sorted(tables.items()) for i, f in enumerate(d.schema.fields)]
    return spark.createDataFrame(rows, "table string, ordinal int, column string, type string")


def scope_report(spark: SparkSession, catalog: Catalog, scope: Scope) -> DataFrame:
    """(kind, table): watched, hidden by an underscore, in another schema, partitioned parent, foreign, keyless."""
    rows = [("watched", t) for t in scope.tables] + [("keyless", t) for t, s in scope.tables.items() if s.strategy == KEYLESS]
    rows += [("underscore", t) for t in catalog.tables if t.startswith("_")] + [("foreign", t) for t in catalog.foreign]
    rows += [("partitioned-parent", t) for t in catalog.parents] + [("other-schema", f"{s}.{t}") for t, s in catalog.schemas.items()]
    return spark.createDataFrame(sorted(rows), "kind string, table string")


def describe(columns: DataFrame, scope: DataFrame) -> DataFrame:
    """catalog_columns of watched tables with what applies to each: key, ignored, masked, the table's strategy."""
    j = columns.join(scope, "table")
    has = lambda c: F.array_contains(c, F.col("column"))
    return j.select("table", "ordinal", "column", "type", has("key_columns").alias("is_key"), has("ignore_columns").alias("ignored"), has("masked_columns").alias("masked"), "key_strategy", "departures_observable").orderBy("table", "ordinal")


def unresolved_names(spark: SparkSession, names: list[str] | DataFrame, columns: DataFrame) -> DataFrame:
    """Names to mask or ignore (a list, or a frame with ``name``) that are no column of a watched table."""
    given = names.select("name").distinct() if isinstance(names, DataFrame) else spark.createDataFrame([(n,) for n in names], "name string")
    return given.join(columns.select(F.col("column").alias("name")).distinct(), "name", "left_anti")


def _without_one(t: Column) -> Column:
    """The texts that are one letter shorter."""
    return F.transform(F.slice(F.sequence(F.lit(1), F.length(t) + 1), F.lit(1), F.length(t)), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))


def _neighbourhood(name: Column, most: int) -> Column:
    """The name and all texts that are up to ``most`` letters shorter."""
    found = level = F.array(F.lower(name))
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, _without_one)))
        found = F.array_union(found, level)
    return found


def _pieces(name: Column) -> Column:
    """(key, place): a long written name in as many pieces as it may have edits. Two names of no more edits have a piece with one
    edit at most, at places that differ by no more than the edits; each piece stands as it is and without one letter."""
    n, t = F.length(name), loose_limit(name)
    start = lambda i: F.floor(i * n / t).cast("int")
    piece = lambda i: F.substr(F.lower(name), start(i) + 1, start(i + 1) - start(i))
    keys = lambda i: F.transform(F.array_union(F.array(piece(i)), _without_one(piece(i))), lambda k: F.struct(k.alias("key"), start(i).alias("place")))
    return F.flatten(F.transform(F.sequence(F.lit(0), t - 1), keys))


def _parts(name: Column) -> Column:
    """(key, place): the parts of two to five letters of a known name, as they are and without one letter."""
    low = F.lower(name)
    of = lambda size: F.transform(F.slice(F.sequence(F.lit(0), F.greatest(F.length(low) - size + 1, F.lit(1))), F.lit(1), F.greatest(F.length(low) - size + 1, F.lit(0))), lambda i: F.struct(F.substr(low, i + 1, F.lit(size)).alias("key"), i.alias("place")))
    whole = F.concat(*(of(k) for k in (2, 3, 4)))
    less = F.flatten(F.transform(F.concat(*(of(k) for k in (3, 4, 5))), lambda p: F.transform(_without_one(p["key"]), lambda k: F.struct(k.alias("key"), p["place"].alias("place")))))
    return F.array_distinct(F.concat(whole, less))


#: Places that one key of the index of parts covers.
_STRETCH = 8


def suggest(unknown: DataFrame, known: DataFrame, name: str = "name", loose: bool = False) -> DataFrame:
    """Adds ``suggestion``: the first known name one slip away; with ``loose``, the nearest one within a third of the name's length.

    Names meet by an index and not in pairs: two names are one slip apart only if they agree when each loses one letter at
    most, so names are joined on what they are without any one letter. The looser rule takes two letters for names of up to eight;
    longer ones are cut into pieces of which one has at most one edit, joined with the parts of known names near its place."""
    k = known.select(F.col(name).alias("known")).where("known is not null").distinct()
    u = unknown.select(F.col(name)).where(F.col(name).isNotNull()).distinct()
    by = lambda d, c, n: d.withColumn("_k", F.explode(_neighbourhood(F.col(c), n)))
    if not loose:
        met = by(u, name, 1).join(by(k, "known", 1), "_k").select(name, "known").distinct().where(close_name(F.col(name), F.col("known")))
        return unknown.join(met.groupBy(name).agg(F.min("known").alias("suggestion")), name, "left")
    limit, size = loose_limit(F.col(name)), F.length(name)
    short = by(u.where(size < 9), name, 2).join(by(k.where(F.length("known") < 12), "known", 2), "_k").select(name, "known")
    near = lambda d, c, cells, reach: d.withColumn("_p", F.explode(cells(F.col(c)))).select(c, "_p.key", F.explode(F.sequence(F.floor((F.col("_p.place") - reach) / _STRETCH), F.floor((F.col("_p.place") + reach) / _STRETCH))).alias("_s"))
    long = near(u.where(size >= 9), name, _pieces, limit).join(near(k.where(F.length("known") > 5), "known", _parts, F.lit(0)), ["key", "_s"]).select(name, "known")
    pairs = short.unionByName(long).where(F.abs(size - F.length("known")) <= limit).distinct()
    pairs = pairs.where(F.levenshtein(F.lower(name), F.lower("known")) <= 2 * limit).withColumn("_d", typing_distance(F.col(name), F.col("known"))).where(F.col("_d") <= limit)
    return unknown.join(pairs.groupBy(name).agg(F.min(F.struct("_d", "known")).alias("_b")).select(name, F.col("_b.known").alias("suggestion")), name, "left")
