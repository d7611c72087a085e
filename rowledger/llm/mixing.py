"""Mixing sources to target weights, natively: Pareto order sampling.

Targets: the total size is shared by weight; a source may reach ``ceiling`` times
its own size, and what is above goes to the others by weight, again and again
until none is above. As the order in which sources reach their ceiling is that of
ceiling * size / weight, one ordered pass over the sources finds the level; no loop.

Documents: a document is due ``min(ceiling, level * x)`` copies, where x, its measure, is
the number of binary digits of its size, so that longer texts are due more; the level of a
source makes the words that are due meet its target, and is found as the targets are, over
the few measures that a source has. The whole part is allocated for certain. The fraction p
is the document's inclusion probability: it is ranked by random odds u / (1 - u) divided by
its inclusion odds p / (1 - p), and the source takes the first documents in that order, a
sample of fixed size in words: up to the place where the words taken come nearest to the target.

The random number is a digest of the id and the text, so reruns agree. The running
sum over a source, which may hold a third of all rows, needs no window over it: sums
over ranges of the rank show in which range the target is reached; in that range
sums over equal ids of one part of the table show at which of them, and only those rows
are put in order. The number of ranges is the root of the source's rows, so
neither the ranges nor the rows of one grow fast. What is kept of a mix is one row
for each source and measure; documents are then marked in one pass without a shuffle.

Defined results: null text has size 0 and no words to take; documents of no words
are taken as their copies say; null sources form a source of their own, the last;
repeated rows are documents of their own, taken one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Up to so many sources, the row for each is sent to all tasks; beyond, Spark joins on the source.
FEW_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    t = F.btrim(F.translate(text, "\t\n\u000b\f\r", "     "))
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(t, " +"))).cast("long")


def draw(id_: Column, text: Column) -> Column:
    """A number between 0 and 1 from the first 48 bits of a digest of the id and the text."""
    digest = F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def measured(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(id, source, size, u, x, row): what a mix needs to know of each document; x: binary digits of the size, row: tells equal
    documents apart. With ``whole``, the document itself too, as doc."""
    doc = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] * whole
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw(F.col(id_col), F.col(text_col)).alias("u"), F.monotonically_increasing_id().alias("row"), *doc)
    return d.withColumn("x", F.length(F.bin("size")))


def targets(sources: DataFrame, weights: tuple[float, ...], ceiling: float, share: float = 1.0) -> DataFrame:
    """Adds target to (source, source_size, ...): weights in the order of the sources, repeating, null last. One row for each source."""
    alone = Window.partitionBy(F.lit(1))
    d = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(alone.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("double"))
    cap = F.col("source_size") * F.lit(float(ceiling))
    before = alone.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(alone) * share - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    d = d.withColumn("level", left / (F.sum("w").over(alone) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the level rises with each source that reaches its ceiling and falls after the last of them
    return d.withColumn("target", F.least(cap, F.max("level").over(alone) * F.col("w"))).drop("w", "level")


def _rank(u: Column, p: Column) -> Column:
    return (u / (1 - u)) / (p / (1 - p))


def due(sums: DataFrame, weights: tuple[float, ...], ceiling: float) -> DataFrame:
    """Whole copies and fraction p for each source and measure. ``sums``: (source, x, words, n)."""
    own = Window.partitionBy("source")
    s = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ceiling)
    c = _join(sums, s)
    cap, weight, before = F.col("words") * F.lit(float(ceiling)), (F.col("x") * F.col("words")).cast("double"), own.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(weight).over(own) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    c = c.withColumn("level", F.when(left > 0, (F.col("target") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / left))
    c = c.withColumn("due", F.least(F.lit(float(ceiling)), F.coalesce(F.max("level").over(own), F.lit(0.0)) * F.col("x")))
    c = c.withColumn("whole", F.floor("due")).withColumn("p", F.col("due") - F.col("whole"))
    mean = F.sum(F.col("p") * F.col("n")).over(own) / F.sum("n").over(own)
    c = c.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(own)).withColumn("ranges", F.ceil(2 * F.sqrt(F.sum("n").over(own)))).withColumn("middle", mean / (1 - mean))
    return c.drop("words", "n", "level", "due")


def _range() -> Column:
    """The range of a document's rank; ranks near those of the source's mean inclusion odds are spread evenly."""
    r = F.col("rank") * F.col("middle")
    return F.least(F.floor(r / (1 + r) * F.col("ranges")), F.col("ranges") - 1)


def mix_plan(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), ceiling: float = 3.0) -> DataFrame:
    """One row for each source and measure of ``rows`` (see measured): source_size, target, whole copies, fraction p, and
    where its source's order is cut: all ranges before ``cut_range`` and, in it, ranks up to ``cut``."""
    sums = rows.groupBy("source", "x").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    plan = table(due(table(sums, "sources"), weights, ceiling), "targets")
    ranked = lambda s: _with_plan(rows, s).where("p > 0").withColumn("rank", _rank(F.col("u"), F.col("p"))).withColumn("rng", _range())

    def reached(d: DataFrame, keys: list[str]) -> DataFrame:
        """(source, keys, before): the last group in order that begins within the rest. ``d`` has the words before its first group."""
        d = d.groupBy("source", *keys).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("first"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) + F.col("first")
        d = d.withColumn("before", upto - F.col("words")).where("before <= rest")
        return d.groupBy("source").agg(F.max(F.struct(*keys, "before")).alias("at")).select("source", "at.*")

    part = F.shiftright("row", 33)
    at = reached(ranked(plan).select("source", "rng", "size", "rest", F.lit(0).cast("long").alias("before")), ["rng"])
    s = table(_join(plan, at.withColumnRenamed("rng", "cut_range")), "ranges")
    inside = ranked(s).where("rng = cut_range").withColumn("part", part)
    at = reached(inside, ["rank", "id", "part"])
    at = table(at.select("source", F.col("rank").alias("cut_rank"), F.col("id").alias("cut_id"), F.col("part").alias("cut_part"), F.col("before").alias("first")), "ends")
    last = _join(inside.drop("before"), at).where("rank = cut_rank and id <=> cut_id and part = cut_part")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) + F.col("first")
    taken = last.withColumn("upto", upto).where("upto - size / 2 <= rest").groupBy("source").agg(F.max("row").alias("cut_row"))
    return table(_join(_join(s.drop("before"), at), taken), "mix")


def _join(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.withColumnRenamed("source", "its")
    return a.join(b, F.col("source").eqNullSafe(F.col("its")), "left").drop("its")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.withColumnRenamed("source", "its").withColumnRenamed("x", "measure")
    few = plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    return rows.join(F.broadcast(p) if few else p, F.col("source").eqNullSafe(F.col("its")) & (F.col("x") == F.col("measure"))).drop("its", "measure")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds copies: how often the mix takes a document."""
    d = _with_plan(rows, plan).withColumn("rank", F.when(F.col("p") > 0, _rank(F.col("u"), F.col("p")))).withColumn("rng", _range())
    key, cut = F.struct("rank", "id", F.shiftright("row", 33).alias("part")), F.struct(F.col("cut_rank").alias("rank"), F.col("cut_id").alias("id"), F.col("cut_part").alias("part"))
    inside = (key < cut) | ((key == cut) & (F.col("row") <= F.col("cut_row")))
    taken = (F.col("p") > 0) & ((F.col("rng") < F.col("cut_range")) | ((F.col("rng") == F.col("cut_range")) & F.coalesce(inside, F.lit(False))))
    return d.withColumn("copies", (F.col("whole") + F.coalesce(taken, F.lit(False)).cast("int")).cast("int"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), ceiling: float = 3.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken), a row for each document."""
    rows = table(measured(docs, id_col, source_col, text_col), "measured")
    out = with_copies(rows, mix_plan(rows, weights, ceiling))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), ceiling: float = 3.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents themselves, with all their columns, each as often as the mix takes it. They are stored once, with what
    ``measured`` gives, and marked without a shuffle."""
    facts = measured(docs, id_col, source_col, text_col, whole=True)
    rows = table(facts, "measured")
    d = with_copies(rows, mix_plan(rows.drop("doc"), weights, ceiling)).where("copies > 0")
    return d.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("doc.*")
