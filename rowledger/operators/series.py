"""Per-step series: one value for each step, carried over steps that say nothing.

A series is kept as intervals, whose number follows its observations; who wants a value for each step reads them at steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import decimal_of


def intervals(values: DataFrame, by: list[str], step: str = "step_no", value: str = "v") -> DataFrame:
    """Series as run-length intervals, made of observations alone: (by…, after, at, before, state, value, since).

    ``values`` are the rows that a step gave a series: one non-null value is observed, several are unevaluable; one NULL says
    nothing. Such a step is a point (``at``); between two points, before the first and behind the last lies an interval (steps beyond
    ``after`` and below ``before``, NULL for no bound), in which the last observed value is carried, or nothing was observed yet.
    Rows grow with the observations and not with the steps. Observations of a step are combined before the series are sorted."""
    n, v, at = F.col("_n"), F.col("_v"), F.col("at")
    per = values.groupBy(*by, F.col(step).alias("at")).agg(F.count("*").alias("_n"), F.max(value).alias("_v"))
    speaks = at.isNotNull() & ((n > 1) | v.isNotNull())
    w = Window.partitionBy(*by).orderBy("at")
    own = F.when(n == 1, v)
    d = per.where(speaks).withColumns({"_own": own, "_next": F.lead("at").over(w)})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_last": F.last("_own", ignorenulls=True).over(upto), "_since": F.last(F.when(F.col("_own").isNotNull(), at), ignorenulls=True).over(upto)})
    none = F.lit(None)
    row = lambda a, p, b, state, x, since: F.struct(a.alias("after"), p.alias("at"), b.alias("before"), state.alias("state"), x.alias("value"), since.alias("since"))
    point = row(none.cast(values.schema[step].dataType), at, none.cast(values.schema[step].dataType), F.when(n > 1, "unevaluable").otherwise("observed"), F.col("_own"), F.when(F.col("_own").isNotNull(), at))
    gap = row(at, none.cast(values.schema[step].dataType), F.col("_next"), F.when(F.col("_last").isNotNull(), "carried").otherwise("unobserved"), F.col("_last"), F.col("_since"))
    said = d.select(*by, F.explode(F.array(point, gap)).alias("r")).select(*by, "r.*")
    head = per.groupBy(*by).agg(F.min(F.when(speaks, at)).alias("before"))
    types = said.schema
    nothing = {c: none.cast(types[c].dataType) for c in ("after", "at", "value", "since")}
    return said.unionByName(head.withColumns(nothing).withColumn("state", F.lit("unobserved")))


def at_steps(found: DataFrame, steps: DataFrame, by: list[str], step: str = "step_no") -> DataFrame:
    """(by…, step, state, value, since) of intervals at the given steps: what a reader asks for, every series at every one of them.

    Steps are numbered, one row for each; ends of intervals find their numbers by joins on the step, and an interval becomes the
    numbers that it covers, so work is that of the result."""
    listed = steps.select(F.col(step).alias("at")).where(F.col("at").isNotNull()).distinct().withColumn("_asked", F.lit(1))
    ends = [c for c in ("after", "at", "before")]
    named = found.select(F.explode(F.array(*ends)).alias("at")).where(F.col("at").isNotNull()).distinct().withColumn("_asked", F.lit(0))
    every = listed.unionByName(named).groupBy("at").agg(F.max("_asked").alias("_asked"))
    w = Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = every.withColumn("_upto", F.sum("_asked").over(w))  # asked steps up to this one
    total = F.coalesce(numbered.agg(F.max("_upto").alias("n")).scalar(), F.lit(0).cast("long"))
    d = found.withColumn("_row", F.struct("state", "value", "since")).select(*by, *ends, "_row")
    for e in ends:
        d = d.join(numbered.select(F.col("at").alias(e), F.col("_upto").alias(f"_u_{e}"), F.col("_asked").alias(f"_q_{e}")), e, "left")
    point = F.col("at").isNotNull()
    first = F.when(point, F.col("_u_at")).otherwise(F.coalesce("_u_after", F.lit(0)) + 1)
    last = F.when(point, F.when(F.col("_q_at") == 1, F.col("_u_at")).otherwise(0)).otherwise(F.when(F.col("before").isNull(), total).otherwise(F.col("_u_before") - F.col("_q_before")))
    d = d.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    d = d.select(*by, F.explode(F.sequence("_first", "_last")).alias("_upto"), "_row")
    return d.join(numbered.where("_asked = 1").select(F.col("at").alias(step), "_upto"), "_upto").select(*by, step, "_row.state", "_row.value", "_row.since")


def observe(steps: DataFrame, values: DataFrame, by: list[str], step: str = "step_no", value: str = "v") -> DataFrame:
    """(by…, step, state, value, since) for every series and step: ``intervals`` read at all ``steps``.

    One non-null value is observed, several are unevaluable, none (or a NULL) is carried from the last observed step, or
    unobserved before the first."""
    return at_steps(intervals(values, by, step, value), steps, by, step)


def panel(series: dict[str, DataFrame], problems: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Several named series as one frame, and their problems: a bad source costs its own line, one that never saw a row says so."""
    out = None
    for name, d in series.items():
        d = d.withColumn("series", F.lit(name))
        out = d if out is None else out.unionByName(d)
    silent = out.groupBy("series").agg(F.bool_and(F.col("state") == "unobserved").alias("never")).where("never").select("series", F.lit("matched no row").alias("problem"))
    bad = out.sparkSession.createDataFrame(list((problems or {}).items()), "series string, problem string")
    return out, silent.unionByName(bad)


def segments(series: DataFrame, by: list[str], step: str = "step_no") -> DataFrame:
    """(by…, segment, state, step, value): runs of points to draw as one line.

    A new segment begins wherever the state changes and repeats the point before, so lines meet; points that are neither
    observed nor carried, or hold no number, are gaps; segments of one point are dropped."""
    w = Window.partitionBy(*by).orderBy(step)
    d = series.withColumn("_y", decimal_of(F.col("value").cast("string")))
    d = d.withColumn("_s", F.when(F.col("state").isin("observed", "carried") & F.col("_y").isNotNull(), F.col("state")).otherwise("gap"))
    d = d.withColumn("_before", F.lag("_s").over(w)).withColumn("_begins", F.when(F.col("_before").isNull() | (F.col("_before") != F.col("_s")), 1).otherwise(0))
    d = d.withColumn("_seg", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    repeated = d.withColumn("_prev", F.lag(F.struct(step, "_y")).over(w)).where((F.col("_begins") == 1) & (F.col("_s") != "gap") & (F.col("_before") != "gap"))
    keep = [*by, F.col("_seg").alias("segment"), F.col("_s").alias("state")]
    pts = d.where("_s <> 'gap'").select(*keep, F.col(step), F.col("_y").alias("value")).unionByName(repeated.select(*keep, F.col("_prev")[step].alias(step), F.col("_prev._y").alias("value")))
    n = F.count("*").over(Window.partitionBy(*by, "segment"))
    return pts.withColumn("_n", n).where("_n > 1").drop("_n")


def extent(series: DataFrame, by: list[str]) -> DataFrame:
    """(by…, lo, hi) over numeric observed and carried points or intervals; a flat line is padded by half of its size (1 at zero)."""
    y = F.when(F.col("state").isin("observed", "carried"), decimal_of(F.col("value").cast("string")))
    d = series.groupBy(*by).agg(F.min(y).cast("double").alias("lo"), F.max(y).cast("double").alias("hi")).where("lo is not null")
    pad: Column = F.when(F.col("lo") == F.col("hi"), F.when(F.col("lo") == 0, 1.0).otherwise(F.abs("lo") / 2)).otherwise(0.0)
    return d.select(*by, (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))
