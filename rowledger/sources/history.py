"""Stored runs: sinks, the newest of them, what can be read, and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the major version of the stored shape.
SCHEMA_MAJOR = 1


def write_changes(changes: DataFrame, path: str, partition: str = "run_id") -> None:
    """Stores rows of changes (common shape) by run; a run that is written again replaces itself only."""
    changes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_run(run: DataFrame, path: str, keep: int = 50) -> None:
    """Stores runs, each as a partition that appears at once when the job commits, then prunes to the newest ``keep`` (0: none are removed).
    Of more runs than that, those that pruning would remove at once are not written: a folder for each takes longer than all else."""
    if keep:
        ids = newest_ids(run, keep)
        run = run.join(F.broadcast(ids), run["run_id"].cast("string").eqNullSafe(ids["id"]), "left_semi")
    run.withColumn("schema_major", F.lit(SCHEMA_MAJOR)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    if keep:
        prune(run.sparkSession, path, keep)


def newest_ids(run: DataFrame, keep: int) -> DataFrame:
    """(id): names of the runs that may be among the newest ``keep`` of a store. Names of folders are read back as numbers where all are
    numbers, else as texts or dates, which sort as texts do: either order counts. A run without a name is never pruned."""
    ids = run.select(F.col("run_id").cast("string").alias("id")).distinct()
    number = F.struct(F.col("id").try_cast("double"), F.col("id").try_cast("decimal(38,6)"))  # long ones may be equal as doubles
    tops = [ids.where("id <> ''").orderBy(F.desc(order)).limit(keep) for order in (F.col("id"), number)]
    return tops[0].union(tops[1]).union(ids.where("id is null or id = ''")).distinct()


def gate(runs: DataFrame, major: str = "schema_major") -> tuple[DataFrame, DataFrame]:
    """(readable runs, refused runs with a reason)."""
    m = F.col(major)
    why = F.when(m.isNull(), "the stored run names no version").when(m > SCHEMA_MAJOR, "written by a newer version").when(m < SCHEMA_MAJOR, "written by an older version")
    d = runs.withColumn("reason", why)
    return d.where("reason is null").drop("reason"), d.where("reason is not null")


def latest(runs: DataFrame, by: list[str], id_col: str = "run_id", only: Column | None = None) -> DataFrame:
    """The newest run of each group, of those that ``only`` admits."""
    d = runs if only is None else runs.where(only)
    newest = d.groupBy(*by).agg(F.max(id_col).alias(id_col))
    return d.join(newest, [*by, id_col], "left_semi")


def newest(runs: DataFrame, n: int, id_col: str = "run_id") -> DataFrame:
    return gate(runs)[0].orderBy(F.desc(id_col)).limit(n)


def ranked(runs: DataFrame, by: list[str], id_col: str = "run_id") -> DataFrame:
    """Adds age: 1 for the newest run of its group."""
    ids = runs.select(*by, id_col).distinct()
    return ids.withColumn("age", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(id_col))))


def prune_plan(runs: DataFrame, keep: int, by: list[str] | None = None, id_col: str = "run_id") -> DataFrame:
    """Ids beyond the newest ``keep`` (of each group); 0 keeps all."""
    by = by or []
    if not keep:
        return runs.select(*by, id_col).limit(0)
    if by:
        return ranked(runs, by, id_col).where(F.col("age") > keep).select(*by, id_col)
    ids = runs.select(id_col).distinct()
    return ids.join(ids.orderBy(F.desc(id_col)).limit(keep), id_col, "left_anti")


def prune(spark: SparkSession, path: str, keep: int) -> None:
    """Removes the partitions of runs beyond the newest ``keep`` from the store's file system."""
    old = [r[0] for r in prune_plan(spark.read.parquet(path), keep).collect()]
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for run in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/run_id={run}"), True)
