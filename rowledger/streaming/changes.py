"""Change logs as streams: whole transactions, net views of windows, late writes, carried values.

Sources are the structured record or decoded text lines (``sources.log``); every sink
goes through ``foreachBatch`` with the batch's operators, so results of a stream equal
those of its log as a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def intake(records: DataFrame, time: str = "ts", late: str = "10 minutes", identity: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """A record stream with its watermark, each record once."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark(list(identity))


def _rocks(spark: SparkSession) -> None:
    """Lists, maps and timers of state need this store; it also appends to a list without reading it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class _Fence(StatefulProcessor):
    """Keeps a transaction's records as a list; a batch appends to it, and only the COMMIT, or the timer, reads it."""

    def __init__(self, place: str, wait_ms: int):
        self.place, self.wait_ms = place, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"place {self.place}, record string")
        self.last = handle.getValueState("last", "deadline long")

    def release(self, records: list[tuple], complete: bool) -> Iterator[Row]:
        self.held.clear()
        self.last.clear()
        for _, record in sorted(records, key=lambda x: (x[0] is not None, x[0])):
            yield Row(record=record, complete=complete)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - names of the interface
        new, time, commit = [], 0, False
        for r in rows:
            new.append((r["place"], r["record"]))
            time, commit = max(time, r["time"] or 0), commit or bool(r["commit"])
        before = self.last.get()[0] if self.last.exists() else None
        if commit:
            if before is not None:
                self.handle.deleteTimer(before)
                new += [tuple(x) for x in self.held.get()]
            yield from self.release(new, True)
            return
        self.held.appendList(new)
        deadline = max(before or 0, max(time, timerValues.getCurrentWatermarkInMs()) + self.wait_ms)
        if deadline != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(deadline)
            self.last.update((deadline,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self.release([tuple(x) for x in self.held.get()], False)

    def close(self) -> None:
        pass


def transaction_fence(records: DataFrame, txn: str = "transaction_id", is_commit: str = "is_commit", order: str = "sequence", time: str = "ts", wait: str = "10 minutes") -> DataFrame:
    """Holds a transaction's records until its COMMIT is seen, then releases them in order with complete = true. A
    transaction whose COMMIT does not come within ``wait`` of its last record, by the stream's watermark (see ``intake``), is released with complete = false: a reduced-fidelity
    warning, as in a batch, where such transactions are kept.

    State: a list of the records of each open transaction, appended to by each batch and read once; one transaction is released by one
    task, as it must be. Records of no transaction (NULL) are held together."""
    _rocks(records.sparkSession)
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    sent = records.select(F.col(txn).alias("txn"), F.col(order).alias("place"), F.coalesce(is_commit, F.lit(False)).alias("commit"), F.unix_millis(F.col(time).cast("timestamp")).alias("time"), F.to_json(F.struct(*records.columns), _JSON).alias("record"))
    place = records.schema[order].dataType.simpleString()
    held = sent.groupBy("txn").transformWithState(_Fence(place, wait_ms), "record string, complete boolean", "append", "EventTime")
    return held.select(F.from_json("record", records.schema, _JSON).alias("r"), "complete").select("r.*", "complete")


def window_net_view(records: DataFrame, keys: list[str], values: list[str], length: str, time: str = "ts", sequence: str = "sequence", operation: str = "operation") -> DataFrame:
    """The log fold of each window of commit time, in append mode: a window is given out when the watermark has passed it."""
    o = F.col(sequence)
    g = records.groupBy(F.window(time, length), *keys).agg(F.min_by(operation, o).alias("first_op"), F.max_by(operation, o).alias("last_op"), F.count("*").alias("writes"), F.max_by(F.struct(*values), o).alias("_last"))
    had, has = F.col("first_op") != "insert", F.col("last_op") != "delete"
    kind = F.when(had & has, "update").when(has, "insert").otherwise("delete")
    return g.where(had | has).select(F.col("window.start").alias("window_start"), *keys, kind.alias("kind"), "first_op", "last_op", "writes", *(F.when(has, F.col(f"_last.{v}")).alias(v) for v in values))


class _NetView(StatefulProcessor):
    """The log fold of one key in one window, and the writes that come when the window is over."""

    def __init__(self, sequence: str):
        self.sequence = sequence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        s = self.sequence
        self.net = handle.getValueState("net", f"first_seq {s}, first_op string, last_seq {s}, last_op string, writes long, record string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        end, now = key[0], timerValues.getCurrentWatermarkInMs()
        if end <= now:
            for r in rows:
                yield Row(_start=key[1], late=True, first_op=r["operation"], last_op=r["operation"], writes=1, last_seq=r["place"], record=r["record"])
            return
        known = self.net.get() if self.net.exists() else None
        if known is None:
            self.handle.registerTimer(end)
        for r in rows:
            p, op = r["place"], r["operation"]
            if known is None:
                known = (p, op, p, op, 1, r["record"])
                continue
            fs, fo, ls, lo, n, rec = known
            if p < fs:
                fs, fo = p, op
            if p >= ls:
                ls, lo, rec = p, op, r["record"]
            known = (fs, fo, ls, lo, n + 1, rec)
        self.net.update(tuple(known))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        _, fo, ls, lo, n, rec = self.net.get()
        self.net.clear()
        if fo != "insert" or lo != "delete":
            yield Row(_start=key[1], late=False, first_op=fo, last_op=lo, writes=n, last_seq=ls, record=rec)

    def close(self) -> None:
        pass


def window_net_view_with_late(records: DataFrame, keys: list[str], values: list[str], length: str, time: str = "ts", sequence: str = "sequence", operation: str = "operation") -> DataFrame:
    """``window_net_view`` with a second output: writes whose window the watermark has passed come out as they are, ``late`` = true.

    ``records`` has a watermark (``withWatermark``) and each record once. State: for each key of each open window its first and last write; a
    batch's rows of a key are folded before the state is touched. Every write ends in one of the two outputs, or in a window that is still open."""
    _rocks(records.sparkSession)
    at = F.window(F.col(time), length)
    # the time goes on as a number: Spark itself would drop late rows before the operator sees them
    sent = records.select(F.unix_millis(at["end"]).alias("_end"), F.unix_millis(at["start"]).alias("_start"), *keys, F.col(sequence).alias("place"), F.col(operation).alias("operation"), F.to_json(F.struct(*keys, *values), _JSON).alias("record"))
    place, shape = records.schema[sequence].dataType.simpleString(), records.select(*keys, *values).schema
    out = sent.groupBy("_end", "_start", *keys).transformWithState(_NetView(place), f"_start long, late boolean, first_op string, last_op string, writes long, last_seq {place}, record string", "append", "EventTime")
    had, has = F.col("first_op") != "insert", F.col("last_op") != "delete"
    kind = F.when(F.col("late"), F.lit(None).cast("string")).when(had & has, "update").when(has, "insert").otherwise("delete")
    r = F.from_json("record", shape, _JSON)
    return out.select(F.timestamp_millis("_start").alias("window_start"), *(r[k].alias(k) for k in keys), "late", kind.alias("kind"), "first_op", "last_op", "writes", F.col("last_seq").alias(sequence), *(F.when(has, r[v]).alias(v) for v in values))


def late_writes(written: DataFrame, by: list[str], n: str = "writes") -> DataFrame:
    """Warnings for what came after the watermark, from the rows that ``window_net_view_with_late`` marks."""
    d = written.where("late").groupBy(*by).agg(F.sum(n).alias("_late"))
    return d.select(F.lit("stream").alias("source"), F.lit("scope-truncated").alias("code"), *by, F.concat(F.col("_late").cast("string"), F.lit(" writes came too late")).alias("message"))


def fence_warnings(released: DataFrame, txn: str = "transaction_id") -> DataFrame:
    """One reduced-fidelity row for each transaction that was released without its COMMIT."""
    return released.where(~F.col("complete")).groupBy(txn).agg(F.count("*").alias("n")).select(F.lit("stream").alias("source"), F.lit("reduced-fidelity").alias("code"), F.lit(None).cast("string").alias("table"), F.concat(F.lit("no COMMIT for "), F.col(txn).cast("string")).alias("message"))


def evaluate_each_batch(changes: DataFrame, answer: Callable[[DataFrame, int], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Evaluates assertions over every micro-batch and stores the results by batch; a batch that is repeated replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        answer(batch, number).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_each_batch(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The streaming sink of changes: one partition for each micro-batch, replaced if it is repeated."""
    return evaluate_each_batch(changes, lambda batch, _: batch, path, checkpoint)


class _Carried(StatefulProcessor):
    """The steps of one series, each with its number of rows and its value."""

    def __init__(self, step: str):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getMapState("steps", f"step {self.step}", "n long, value string")
        self.revision = handle.getValueState("revision", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        came: dict = {}
        for r in rows:
            n, v = came.get(r["step"], (0, None))
            came[r["step"]] = n + 1, v if r["value"] is None else r["value"]
        known = {k[0]: tuple(v) for k, v in self.steps.iterator()} if self.revision.exists() else {}
        for s, (n, v) in came.items():
            m, w = known.get(s, (0, None))
            known[s] = n + m, w if v is None else v
            self.steps.updateValue((s,), known[s])
        revision = self.revision.get()[0] + 1 if self.revision.exists() else 1
        self.revision.update((revision,))
        last = since = None
        touched = False
        for s in sorted(known):
            n, v = known[s]
            if n > 1:
                found = ("unevaluable", None, None)
            elif v is not None:
                last, since = v, s
                found = ("observed", v, s)
            else:
                found = ("carried", last, since) if since is not None else ("unobserved", None, None)
            # what a row changes ends at the next observed step
            touched = s in came or (touched and found[0] != "observed")
            if touched:
                yield Row(**{f"k{i}": k for i, k in enumerate(key)}, step=s, state=found[0], value=found[1], since=found[2], revision=revision)

    def close(self) -> None:
        pass


def carried(observations: DataFrame, by: list[str], step: str = "step_no", value: str = "value") -> DataFrame:
    """(by…, step, state, value, since, revision): a series' last observed value fills the steps that report none (NULL), across batches.

    As in ``series.observe``: a step with one value observes it, one with several rows is unevaluable, whatever they hold. Rows
    may come in any order and over any batches: one that comes late corrects its step and those that carry from it, with
    a higher revision; ``settled`` reads the last one of each step. The state is a map from step to its rows' number and value; a batch
    goes through the steps of the series that it has rows of. Rows without a step are left out."""
    _rocks(observations.sparkSession)
    schema = observations.schema
    kind = schema[step].dataType.simpleString()
    out = ", ".join([*(f"k{i} {schema[c].dataType.simpleString()}" for i, c in enumerate(by)), f"step {kind}", "state string", "value string", f"since {kind}", "revision long"])
    sent = observations.where(F.col(step).isNotNull()).select(*by, F.col(step).alias("step"), F.col(value).cast("string").alias("value"))
    d = sent.groupBy(*by).transformWithState(_Carried(kind), out, "append", "None")
    return d.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(by)), F.col("step").alias(step), "state", "value", "since", "revision")


def settled(corrections: DataFrame, by: list[str], step: str = "step_no") -> DataFrame:
    """The last word on each step of what ``carried`` has given out."""
    d = corrections.groupBy(*by, step).agg(F.max_by(F.struct("state", "value", "since"), "revision").alias("r"))
    return d.select(*by, step, "r.*")


def read_parquet_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, with the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
