"""Static audit: what assertions name against what there is, as joins, for any number of suites at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scope import suggest
from .capture import TRANSACTIONAL, WRITE

PROBLEM = ["assertion_id", "problem", "name", "suggestion"]


def _problem(d: DataFrame, problem: str, name: str) -> DataFrame:
    return d.select("assertion_id", F.lit(problem).alias("problem"), F.col(name).alias("name"))


def unknown_tables(features: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables named anywhere that the catalog lacks; in an except list they are problems of their own kind."""
    known = columns.select(F.col("table").alias("table_name")).distinct()
    d = features.where("table_name <> '*'").join(known, "table_name", "left_anti")
    d = d.select("assertion_id", F.when(F.col("use_kind") == "except", "except-names-nothing").otherwise("unknown-table").alias("problem"), F.col("table_name").alias("name")).distinct()
    return suggest(d, known.select(F.col("table_name").alias("name")))


def unknown_columns(features: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns matched or read that their (known) table lacks, once for each assertion; whole-scope selectors are passed over."""
    known = columns.select(F.col("table").alias("table_name"), F.col("column").alias("column_name"))
    f = features.where("table_name <> '*' and column_name <> '*'").join(known.select("table_name").distinct(), "table_name", "left_semi")
    d = f.join(known, ["table_name", "column_name"], "left_anti")
    d = d.select("assertion_id", F.concat(F.lit("unknown-column-"), "use_kind").alias("problem"), F.concat("table_name", F.lit("."), "column_name").alias("name")).distinct()
    return suggest(d, known.select(F.concat("table_name", F.lit("."), "column_name").alias("name")))


def not_watched(features: DataFrame, columns: DataFrame, watched: DataFrame) -> DataFrame:
    """Tables and except names that exist and are not in the watch list (table)."""
    known = columns.select(F.col("table").alias("table_name")).distinct()
    d = features.where("table_name <> '*'").join(known, "table_name", "left_semi").join(watched.select(F.col("table").alias("table_name")), "table_name", "left_anti")
    return _problem(d, "not-watched", "table_name").distinct()


def cannot_answer(features: DataFrame, scope: DataFrame, detection: str, fidelity: str) -> DataFrame:
    """The first reason, in the order of evaluation, why a capture of these capabilities cannot answer an assertion."""
    f = features.join(scope.select(F.col("table").alias("table_name"), "departures_observable"), "table_name", "left")
    kinds = F.col("selector_kind").isin("changes", "updated")
    need_write = (F.col("question") == "hasWrite") | (F.col("question").isin("count", "any", "isEmpty") & kinds)
    blind = F.col("question").isin("count", "any", "isEmpty", "hasWrite") & F.col("selector_kind").isin("changes", "updated", "deleted") & ~F.coalesce("departures_observable", F.lit(True))
    why = F.when(need_write & F.lit(detection != WRITE), "needs-write-detection").when(F.col("question").isin("atomic", "writeCount") & F.lit(fidelity != TRANSACTIONAL), "needs-transactions").when(blind, "rows-have-no-identity")
    d = f.withColumn("problem", why).where("problem is not null")
    first = Window.partitionBy("assertion_id").orderBy("ordinal")
    return d.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("assertion_id", "problem", F.col("table_name").alias("name"))


def masked_reads(features: DataFrame, masks: DataFrame, columns: DataFrame) -> DataFrame:
    """Masked columns (column) that an assertion reads or matches, wherever a table has them."""
    there = columns.select(F.col("table").alias("table_name"), F.col("column").alias("column_name")).join(masks.select(F.col("column").alias("column_name")), "column_name", "left_semi")
    d = features.where("use_kind in ('read', 'match')").join(there, ["table_name", "column_name"], "left_semi")
    return d.select("assertion_id", F.lit("masked-column").alias("problem"), F.concat("table_name", F.lit("."), "column_name").alias("name")).distinct()


def steps_without_assertions(steps: DataFrame, assertions: DataFrame, by: list[str]) -> DataFrame:
    return steps.join(assertions.select(*by), by, "left_anti").select(*by, F.lit("checks-nothing").alias("problem"))


def nothing_asserted(assertions: DataFrame) -> DataFrame:
    """One row if there is no assertion at all."""
    return assertions.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("nothing-asserted").alias("problem"))


def variable_producers(needs: DataFrame, captures: DataFrame, by: list[str], name: str = "name", order: str = "step_no") -> DataFrame:
    """For each variable that a step needs: state built-in, captured (``producer``: the last step before it), later (the first one after) or nowhere."""
    got = captures.select(*by, name, F.col(order).alias("_at")).distinct()
    d = needs.join(got, [*by, name], "left").groupBy(*by, name, order).agg(F.max(F.when(F.col("_at") < F.col(order), F.col("_at"))).alias("_before"), F.min(F.when(F.col("_at") >= F.col(order), F.col("_at"))).alias("_after"))
    state = F.when(F.col(name).isin("run", "now"), "built-in").when(F.col("_before").isNotNull(), "captured").when(F.col("_after").isNotNull(), "later").otherwise("nowhere")
    return d.select(*by, name, order, state.alias("state"), F.coalesce("_before", "_after").alias("producer"))


def audit(features: DataFrame, columns: DataFrame, watched: DataFrame | None = None, masks: DataFrame | None = None) -> DataFrame:
    """All problems of names: (assertion_id, problem, name, suggestion)."""
    out = [unknown_tables(features, columns), unknown_columns(features, columns)]
    none = F.lit(None).cast("string").alias("suggestion")
    if watched is not None:
        out.append(not_watched(features, columns, watched).withColumn("suggestion", none))
    if masks is not None:
        out.append(masked_reads(features, masks, columns).withColumn("suggestion", none))
    return reduce(DataFrame.unionByName, (d.select(*PROBLEM) for d in out))


def panel_audit(sources: DataFrame, columns: DataFrame) -> DataFrame:
    """The same over the sources of panels: a feature frame whose assertion_id names the series."""
    return audit(sources, columns)
