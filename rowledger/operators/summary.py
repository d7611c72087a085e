"""Summaries of changes and of write order, first rows, and comparing captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .capture import DELETE, ENTERED, INSERT, LEFT, UNCHANGED, UPDATE, VALUE


def change_summary(changes: DataFrame) -> DataFrame:
    """(table, inserted, updated, deleted, written_no_visible_change), by table."""
    k = F.col("kind")
    return (
        changes.where(k != UNCHANGED)
        .groupBy("table")
        .agg(
            F.count_if(k.isin(INSERT, ENTERED)).alias("inserted"), F.count_if(k == UPDATE).alias("updated"), F.count_if(k.isin(DELETE, LEFT)).alias("deleted"),
            F.count_if((k == UPDATE) & (F.size("visible_columns") == 0)).alias("written_no_visible_change"),
        )
        .orderBy("table")
    )


def ghost_writes(mutations: DataFrame, changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Writes whose row is not in the net view."""
    on = keys or ["table", "key_token"]
    return mutations.join(changes.select(*on).distinct(), on, "left_anti")


def repeated_writes(mutations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows written more than once, with how often."""
    return mutations.groupBy(*(keys or ["table", "key_token"])).agg(F.count("*").alias("writes")).where("writes > 1")


def write_order_summary(mutations: DataFrame, changes: DataFrame, keys: list[str] | None = None, txn: str = "transaction_id") -> DataFrame:
    """One row: total writes, transactions, writes without net change, rows written repeatedly, and the class of the story."""
    on = keys or ["table", "key_token"]
    m = mutations.join(changes.select(*on, F.lit(True).alias("_net")).distinct(), on, "left")
    per = m.groupBy(*on).agg(F.count("*").alias("n"), F.first("_net").alias("net"))
    rows = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("net").isNull(), F.col("n"))), F.lit(0)).alias("without_net_change"), F.count_if(F.col("n") > 1).alias("repeated"))
    d = rows.crossJoin(mutations.agg(F.count_distinct(txn).alias("transactions")))  # one row beside one row
    return d.withColumn("story", narrative(F.col("transactions"), F.col("repeated"), F.col("without_net_change")))


def narrative(transactions: Column, repeated: Column, ghosts: Column) -> Column:
    parts = F.array_compact(F.array(F.when(transactions != 1, F.concat(transactions.cast("string"), F.lit(" transactions"))), F.when(repeated > 0, F.concat(repeated.cast("string"), F.lit(" rows written more than once"))), F.when(ghosts > 0, F.concat(ghosts.cast("string"), F.lit(" writes without net change")))))
    return F.when(F.size(parts) == 0, "one transaction, each row once").otherwise(F.array_join(parts, "; "))


def transaction_labels(mutations: DataFrame, order: str = "sequence", txn: str = "transaction_id") -> DataFrame:
    """(transaction, label): 1..n in the order of first appearance. One row for each transaction is ordered, not the log."""
    first = mutations.groupBy(txn).agg(F.min(order).alias("_first"))
    return first.select(txn, F.row_number().over(Window.orderBy("_first")).alias("label"))


def nothing_happened(changes: DataFrame, warnings: DataFrame, detection: str) -> DataFrame:
    """One row: what can be said of an empty change set, or NULL if it is not empty."""
    blind = warnings.agg(F.count_if(F.col("code").isin("scope-truncated", "reduced-fidelity")).alias("blind"))
    said = "no values differ" if detection == VALUE else "nothing written"
    d = changes.agg(F.count("*").alias("n")).crossJoin(blind)
    return d.select(F.when(F.col("n") == 0, F.when(F.col("blind") > 0, "could not read everything").otherwise(said)).alias("statement"))


def top_rows(changes: DataFrame, order: list[Column | str], rows: int = 3, tables: int = 6, by: str = "table") -> DataFrame:
    """The first rows of the first tables, with how many more a table has (``more_rows``) and how many more tables there are.

    Spark stops each task's sort at the limit for ``row_number() <= n``, so a table of any size sends a few rows."""
    counts = changes.groupBy(by).agg(F.count("*").alias("_n"))
    ranked = counts.select(by, "_n", F.row_number().over(Window.orderBy(by)).alias("_t"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("_all"))
    first = changes.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= rows)
    d = first.join(ranked.where(F.col("_t") <= tables), by)
    return d.withColumn("more_rows", F.greatest(F.col("_n") - rows, F.lit(0))).withColumn("more_tables", F.greatest(F.col("_all") - tables, F.lit(0))).drop("_n", "_t", "_all")


def ranked_columns(names: Column, mentioned: list[str], keys: list[str], texts: Column, ignored: list[str], most: int | None = None) -> Column:
    """Columns of a row in the order to show: mentioned in assertions, keys, those with text, the rest; by name in each."""
    rank = lambda n: F.when(n.isin(*mentioned), 0).when(n.isin(*keys), 1).when(F.array_contains(texts, n), 2).otherwise(3)
    kept = F.filter(names, lambda n: ~n.isin(*ignored)) if ignored else names
    out = F.transform(F.array_sort(F.transform(kept, lambda n: F.struct(rank(n).alias("r"), n.alias("n")))), lambda s: s["n"])
    return out if most is None else F.slice(out, 1, most)


def first_columns(names: Column, most: int = 8) -> Column:
    """The first names as one text, and how many more there are."""
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, F.concat(F.lit(" +"), (F.size(names) - most).cast("string"), F.lit(" more"))).otherwise(""))


def shape(changes: DataFrame) -> DataFrame:
    """(row, columns): table:kind:key and the sorted changed columns, to compare captures by."""
    key = F.coalesce(F.array_join(F.transform("key", lambda k: F.coalesce(k["value"], F.lit("NULL"))), "|"), F.lit("(unkeyed)"))
    return changes.select("table", F.concat_ws(":", "table", "kind", key).alias("row"), F.array_join(F.array_sort("changed_columns"), ",").alias("columns"))


def reconcile(a: DataFrame, b: DataFrame, explained: DataFrame | None = None) -> DataFrame:
    """Rows of two shapes that do not agree: (row, columns_a, columns_b), as often as they occur; less those explained (row)."""
    x = a.groupBy("row", F.col("columns").alias("columns_a")).agg(F.count("*").alias("n_a"))
    y = b.groupBy("row", F.col("columns").alias("columns_b")).agg(F.count("*").alias("n_b"))
    d = x.join(y, "row", "full_outer").where(~F.col("columns_a").eqNullSafe(F.col("columns_b")) | ~F.col("n_a").eqNullSafe(F.col("n_b")))
    d = d.select("row", "columns_a", "columns_b")
    return d if explained is None else d.join(explained.select("row"), "row", "left_anti")


def expected_answers(claims: DataFrame, detection: str, fidelity: str, identity: bool) -> tuple[DataFrame, DataFrame]:
    """(assertion, expected) for a capture's capabilities, NULL in a claim meaning any; and the assertions claimed twice with different answers."""
    fits = lambda c, v: F.col(c).isNull() | (F.col(c) == F.lit(v))
    d = claims.where(fits("detection", detection) & fits("fidelity", fidelity) & fits("row_identity", identity)).select("assertion", "expected").distinct()
    twice = d.groupBy("assertion").agg(F.count("*").alias("n")).where("n > 1").select("assertion")
    return d.join(twice, "assertion", "left_anti"), twice
