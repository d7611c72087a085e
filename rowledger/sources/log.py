"""Change logs: text and structured records to mutations, windows of whole transactions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import key_label, key_token
from .scope import Scope

#: The structured record.
RECORD = "sequence bigint, transaction_id string, lsn string, table_name string, operation string, key map<string,string>, ts timestamp"
#: The shapes of the log's lines.
HEADER = r"^table (\"(?:[^\"]|\"\")+\"|[^.\"]+)\.(\"(?:[^\"]|\"\")+\"|[^:\"]+): (INSERT|UPDATE|DELETE):"
TRUNCATE = r"^table (.+): TRUNCATE:"
COLUMN = r"(\"(?:[^\"]|\"\")+\"|\w+)\[((?:[^\[\]]|\[\])+)\]:((?:[BEX]?'(?:[^']|'')*')|[^\s]+)"


def read_records(spark, path: str, fmt: str = "json", streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.format(fmt).schema(RECORD).load(path)


def _unquoted(c: Column) -> Column:
    """A name without its quotes; a doubled quote inside stands for one."""
    return F.when(c.startswith('"'), F.replace(F.regexp_extract(c, '^"(.*)"$', 1), F.lit('""'), F.lit('"'))).otherwise(c)


def normal_value(type_: Column, text: Column) -> Column:
    """A value as the log spells it -> as the table does; NULL for null and for what the log does not carry."""
    body = F.replace(F.regexp_replace(text, r"^[BEX]?'([\s\S]*)'$", "$1"), F.lit("''"), F.lit("'"))
    flag = F.when(text == "true", "t").when(text == "false", "f").otherwise(text)
    return F.when(text.isin("null", "unchanged-toast-datum"), None).when(type_.isin("boolean", "bool"), flag).when(text.rlike("^[BEX]?'"), body).otherwise(text)


def decode(lines: DataFrame, line: str = "line") -> DataFrame:
    """Text lines -> adds schema_name, table_name, operation, columns (name -> value), unreadable (names the log does not
    carry), problem. BEGIN and COMMIT lines have these operations; a TRUNCATE line becomes a row for each table; a line of
    no known shape is kept with ``problem`` set."""
    c = F.col(line)
    d = lines.withColumn("_t", F.regexp_extract(c, TRUNCATE, 1))
    d = d.withColumn("_name", F.explode(F.when(F.col("_t") != "", F.split("_t", ", ")).otherwise(F.array(F.lit("")))))
    row = c.rlike(HEADER)
    # of an update with its old key, the new tuple is what follows last
    body = F.regexp_replace(F.regexp_replace(c, HEADER, ""), r"^ old-key:.* new-tuple:", "")
    cols = F.regexp_extract_all(body, F.lit(COLUMN), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, "^" + COLUMN + "$", i)
    entries = F.transform(cols, lambda x: F.struct(_unquoted(part(x, 1)).alias("name"), normal_value(part(x, 2), part(x, 3)).alias("value")))
    lost = F.transform(F.filter(cols, lambda x: part(x, 3) == "unchanged-toast-datum"), lambda x: _unquoted(part(x, 1)))
    trunc = F.col("_t") != ""
    op = F.when(row, F.lower(F.regexp_extract(c, HEADER, 3))).when(trunc, "truncate").when(c.startswith("BEGIN"), "begin").when(c.startswith("COMMIT"), "commit")
    name = F.when(row, _unquoted(F.regexp_extract(c, HEADER, 2))).when(trunc, _unquoted(F.regexp_extract("_name", r"([^.]+)$", 1)))
    schema = F.when(row, _unquoted(F.regexp_extract(c, HEADER, 1))).when(trunc, _unquoted(F.regexp_extract("_name", r"^([^.]+)\.", 1)))
    d = d.withColumns({"schema_name": schema, "table_name": name, "operation": op, "columns": F.when(row, F.map_from_entries(entries)), "unreadable": F.when(row, lost)})
    return d.withColumn("problem", F.when(F.col("operation").isNull(), c)).drop("_t", "_name")


def problem_warning(decoded: DataFrame, order: str = "sequence") -> DataFrame:
    """One reduced-fidelity row if lines could not be read: their number and the first of them."""
    p = decoded.where("problem is not null").agg(F.count("*").alias("n"), F.min_by("problem", order).alias("first")).where("n > 0")
    return p.select(F.lit("log").alias("source"), F.lit("reduced-fidelity").alias("code"), F.lit(None).cast("string").alias("table"), F.concat(F.col("n"), F.lit(" lines could not be read, first: "), F.col("first")).alias("message"))


def position(text: Column) -> Column:
    """A log position 'A/B' in hex as one number."""
    hi, lo = F.split(text, "/")[0], F.split(text, "/")[1]
    return F.conv(hi, 16, 10).cast("decimal(20,0)") * 4294967296 + F.conv(lo, 16, 10).cast("decimal(20,0)")


def _place(d: DataFrame, lsn: str) -> tuple[Column, Callable[[object], Column]]:
    """The position column as a number, and how to read a mark: texts 'A/B' are compared as positions, numbers as they are."""
    if d.schema[lsn].dataType.typeName() == "string":
        return position(F.col(lsn)), lambda v: position(F.lit(v))
    return F.col(lsn), F.lit


def commit_fence(log: DataFrame, opened: object, closed: object | None = None, lsn: str = "lsn", txn: str = "transaction_id", is_commit: str = "is_commit") -> DataFrame:
    """Whole transactions of a window: those whose COMMIT stands at or after ``opened``, and those without one; records
    beyond ``closed`` are left out first. Only the old transactions are looked for (combined before the shuffle) and taken away."""
    at, mark = _place(log, lsn)
    d = log if closed is None else log.where(at <= mark(closed))
    old = d.where(F.col(is_commit)).groupBy(txn).agg(F.max(at).alias("_c")).where(F.col("_c") < mark(opened)).select(txn)
    return d.join(old, txn, "left_anti")


def late_log_warning(log: DataFrame, mark: object, lsn: str = "lsn") -> DataFrame:
    """A scope-truncated row if the log does not reach the mark that closed the window."""
    at, read = _place(log, lsn)
    m = log.agg(F.max(at).alias("m")).where(F.col("m").isNull() | (F.col("m") < read(mark)))
    return m.select(F.lit("log").alias("source"), F.lit("scope-truncated").alias("code"), F.lit(None).cast("string").alias("table"), F.lit("the log ends before the window does").alias("message"))


def mutation_list(records: DataFrame, scope: Scope, keys: dict[str, list[str]], order: str = "sequence", columns: str = "columns", per_range: int = 100_000) -> DataFrame:
    """Ordered writes of the watched tables, numbered from 0 without gaps: (sequence, transaction_id, table, operation, key_token, key).

    The token is made of the raw key, as in the net view; masked key values are not shown; a key the log does not carry is NULL.
    The numbers come from counts of ranges of the old sequence and places inside them, so no task sorts the whole log."""
    d = records.where(F.col("table_name").isin(*scope.tables))
    token, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for t, ks in keys.items():
        parts = [F.col(columns)[k] for k in ks]
        there = F.col("table_name") == t
        for k in ks:
            there = there & F.map_contains_key(columns, k)
        token = F.when(there, key_token(scope.salt, parts, ks)).otherwise(token)
        label = F.when(there, key_label(parts, [k in scope.tables[t].masked for k in ks])).otherwise(label)
    d = d.withColumns({"_range": F.floor(F.col(order) / per_range), "key_token": token, "key": label})
    counts = d.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    out = d.join(before, "_range").withColumn("_s", (F.col("_before") + place).cast("long"))
    return out.select(F.col("_s").alias("sequence"), "transaction_id", F.col("table_name").alias("table"), "operation", "key_token", "key")


def cross_check(mutations: DataFrame, changes: DataFrame) -> DataFrame:
    """Warnings for tables that the log writes and the net view does not show; truncations aside."""
    t = mutations.where("operation <> 'truncate'").select("table").distinct().join(changes.select("table").distinct(), "table", "left_anti")
    return t.select(F.lit("log").alias("source"), F.lit("reduced-fidelity").alias("code"), "table", F.lit("written in the log, absent from the net view").alias("message"))
