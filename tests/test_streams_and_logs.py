from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from rowledger.operators import series, summary, verdict
from rowledger.sources import history, log, responses
from rowledger.streaming import changes as streaming


def test_log_lines(spark):
    lines = [
        "BEGIN 1", "table public.t: INSERT: id[integer]:1 ok[boolean]:true mask[bit]:B'1010' note[text]:'it''s: a' n[text]:null arr[text[]]:'{a,b}'", 'table public."Odd t": UPDATE: old-key: id[integer]:1 new-tuple: id[integer]:2 big[text]:unchanged-toast-datum',
        "table public.t: DELETE: id[integer]:3", "table public.t, public.u: TRUNCATE: (no-flags)", "COMMIT 1", "???",
    ]
    d = log.decode(spark.createDataFrame(list(enumerate(lines)), "sequence int, line string"))
    got = {(r["sequence"], r["table_name"]): r for r in d.collect()}
    assert got[1, "t"]["columns"] == {"id": "1", "ok": "t", "mask": "1010", "note": "it's: a", "n": None, "arr": "{a,b}"}
    assert got[2, "Odd t"]["columns"] == {"id": "2", "big": None} and got[2, "Odd t"]["unreadable"] == ["big"]
    assert {t for s, t in got if s == 4} == {"t", "u"} and got[0, None]["operation"] == "begin" and got[5, None]["operation"] == "commit"
    assert log.problem_warning(d).first()["message"].endswith("???")
    assert spark.range(1).select(log.position(F.lit("1/A"))).first()[0] == 4294967306


def test_whole_transactions(spark, tmp_path):
    ts = datetime(2024, 1, 1)
    rows = [(1, 10, False, ts, "1.50"), (2, 20, False, ts, "2.00"), (3, 10, True, ts, "3.00"), (4, 30, False, ts, None)]
    shape = "sequence long, transaction_id long, is_commit boolean, ts timestamp, amount string"
    spark.createDataFrame(rows, shape).withColumn("amount", F.col("amount").cast("decimal(10,2)")).coalesce(1).write.parquet(f"{tmp_path}/in")
    held = streaming.transaction_fence(streaming.intake(streaming.read_parquet_stream(spark, f"{tmp_path}/in")), wait="1 hour")
    q = held.writeStream.format("memory").queryName("fence").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.table("fence").collect()
    assert sorted((r["sequence"], str(r["amount"]), r["complete"]) for r in got) == [(1, "1.50", True), (3, "3.00", True)] and got[0]["ts"] == ts


def batches(spark, path, shape, *frames):
    """One file, and so one batch, for each frame, in order."""
    for rows in frames:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(path))
    return streaming.read_parquet_stream(spark, str(path), 1)


def collected(spark, frame, tmp_path, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.table(name)


def test_transactions_over_batches(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m, 0, 123456)
    shape = "sequence long, transaction_id string, is_commit boolean, ts timestamp, amount decimal(20,4), raw binary"
    r = lambda s, t, c, m: (s, t, c, at(m), Decimal(s) / 8, bytes([s, 255]))
    src = batches(spark, tmp_path / "in", shape, [r(2, "a", None, 1), r(1, "a", False, 1), r(3, "b", False, 1)], [r(4, "a", False, 2), r(5, None, False, 2)], [r(6, "a", True, 3), r(7, "c", True, 3)], [r(8, "d", False, 50)], [r(9, "d", True, 51)])
    got = collected(spark, streaming.transaction_fence(src.withWatermark("ts", "1 minute"), wait="10 minutes"), tmp_path, "over")
    assert [f.dataType for f in got.schema][:6] == [f.dataType for f in src.schema]
    rows = got.collect()
    assert {(x["sequence"], x["complete"]) for x in rows} == {(1, True), (2, True), (4, True), (6, True), (7, True), (3, False), (5, False), (8, True), (9, True)} and len(rows) == 9
    assert [x["sequence"] for x in rows if x["transaction_id"] == "a"] == [1, 2, 4, 6]  # in order, together
    x = next(x for x in rows if x["sequence"] == 4)
    assert (x["ts"], x["amount"], bytes(x["raw"])) == (at(2), Decimal("0.5000"), bytes([4, 255]))
    assert {w["message"] for w in streaming.fence_warnings(got).collect()} == {"no COMMIT for b", None}


def test_long_transaction_is_appended(spark, tmp_path):
    """A batch leaves what is held alone: its reads of the list do not grow with it."""
    ts = datetime(2024, 1, 1)
    parts = [[(b * 2000 + i, 1, False, ts) for i in range(2000)] for b in range(6)] + [[(99999, 1, True, ts)]]
    src = batches(spark, tmp_path / "in", "sequence long, transaction_id long, is_commit boolean, ts timestamp", *parts)
    got = collected(spark, streaming.transaction_fence(src.withWatermark("ts", "1 minute")), tmp_path, "long")
    assert [r["sequence"] for r in got.collect()] == [*range(12000), 99999]


def test_carried_values(spark, tmp_path):
    rows = [("x", 1, None), ("x", 2, "5"), ("x", 3, None), ("x", 4, "6"), ("x", 4, "7"), ("x", 5, None), ("y", 1, None)]
    src = batches(spark, tmp_path / "in", "s string, step_no long, value string", rows)
    got = streaming.settled(collected(spark, streaming.carried(src, ["s"]), tmp_path, "carried"), ["s"])
    got = [(r["step_no"], r["state"], r["value"], r["since"]) for r in got.where("s = 'x'").orderBy("step_no").collect()]
    assert got == [(1, "unobserved", None, None), (2, "observed", "5", 2), (3, "carried", "5", 2), (4, "unevaluable", None, None), (5, "carried", "5", 2)]


def test_carried_in_any_order(spark, tmp_path):
    r = random.Random(7)
    rows = [(r.choice("ab"), step, r.choice([None, None, "1", "2"])) for step in r.choices(range(12), k=40)] + [("a", None, "1")]
    shape = "s string, step_no long, value string"
    src = batches(spark, tmp_path / "in", shape, *(rows[i::4] for i in range(4)))
    out = collected(spark, streaming.carried(src, ["s"]), tmp_path, "mixed")
    got = {tuple(x) for x in streaming.settled(out, ["s"]).collect()}
    every = spark.createDataFrame(rows, shape).where("step_no IS NOT NULL")
    want = {tuple(x) for x in series.observe(every, every, ["s"], "step_no", "value").join(every.select("s", "step_no").distinct(), ["s", "step_no"]).select("s", "step_no", "state", "value", "since").collect()}
    assert got == want
    # a batch speaks of what it changes alone
    assert out.groupBy("s", "step_no", "revision").count().where("count > 1").count() == 0


def test_late_writes(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    shape = "sequence long, id string, operation string, amount decimal(10,2), ts timestamp"
    w = lambda s, k, op, h, a=1: (s, k, op, Decimal(a), at(h))
    parts = [[w(2, "a", "update", 1, 7), w(1, "a", "insert", 0), w(3, "b", "insert", 2), w(4, "b", "delete", 3)], [w(5, "a", "update", 4, 9)], [w(6, "c", "update", 30)], [w(7, "a", "update", 5), w(8, "a", "delete", 6), w(9, "c", "update", 31, 3)], [w(10, "z", "insert", 60)], [w(11, "z", "insert", 61)]]
    src = batches(spark, tmp_path / "in", shape, *parts).withWatermark("ts", "1 hour")
    got = collected(spark, streaming.window_net_view_with_late(src, ["id"], ["amount"], "24 hours"), tmp_path, "late")
    net = {(x["id"], x["kind"], x["first_op"], x["last_op"], x["writes"], x["sequence"], str(x["amount"])) for x in got.where("not late").collect()}
    assert net == {("a", "insert", "insert", "update", 3, 5, "9.00"), ("c", "update", "update", "update", 2, 9, "3.00")}
    assert {(x["id"], x["sequence"], x["window_start"]) for x in got.where("late").collect()} == {("a", 7, at(0)), ("a", 8, at(0))}
    assert [(r["id"], r["message"]) for r in streaming.late_writes(got, ["id"]).collect()] == [("a", "2 writes came too late")]


def test_paths(spark):
    d = spark.createDataFrame([(1, '{"a": {"b": 1, "c": {"x": [1]}}, "n": null}'), (2, "no json")], "i int, body string")
    at = lambda p: {r["i"]: (r["v"]["state"], r["v"]["value"]) for r in d.select("i", responses.read_path(F.col("body"), p).alias("v")).collect()}
    assert at("a.b") == {1: ("value", "1"), 2: ("unevaluable", None)}
    assert at("a.c")[1] == ("value", '{"x":[1]}') and at("a.z")[1] == ("null", None) and at("n")[1] == ("null", None) and at("z.y")[1] == ("unevaluable", None)
    assert spark.range(1).select(responses.header(F.create_map(F.lit("ETag"), F.lit("x")), "etag")).first()[0] == "x"


def test_history(spark, tmp_path):
    p = f"{tmp_path}/runs"
    for i in range(4):
        history.write_run(spark.createDataFrame([(i, "s", "clean")], "run_id int, scenario string, outcome string"), p, 3)
    assert sorted(r["run_id"] for r in spark.read.parquet(p).collect()) == [1, 2, 3]
    history.write_run(spark.createDataFrame([(3, "s", "failed")], "run_id int, scenario string, outcome string"), p, 0)
    d = spark.read.parquet(p)
    assert history.latest(d, ["scenario"]).first()["outcome"] == "failed" and history.newest(d, 2).count() == 2
    assert history.latest(d, ["scenario"], only=F.col("outcome") == "clean").first()["run_id"] == 2


def test_history_of_many_runs_at_once(spark, tmp_path, monkeypatch):
    """No more folders than are kept are written; the newest by the order in which their names are read back stay."""
    shape = "run_id string, id int"
    many = [(str(k), k) for k in range(120)]  # numbers sort otherwise than their texts
    for given, most, kept in ((many, 7, {str(k) for k in range(117, 120)}), ([*many, ("run 7", 0)], 7, {"run 7", "99", "98"}), ([*many, (None, -1)], 8, {None, *(str(k) for k in range(117, 120))})):
        path = f"{tmp_path}/{len(given)}-{most}"
        with monkeypatch.context() as m:
            m.setattr(history, "prune", lambda *_: None)
            history.write_run(spark.createDataFrame(given, shape).repartition(4, "run_id"), path, 3)
            assert 3 <= len(list((tmp_path / path).glob("run_id=*"))) <= most
        history.prune(spark, path, 3)
        stored = spark.read.parquet(path)
        assert {None if r["run_id"] is None else str(r["run_id"]) for r in stored.collect()} == kept and stored.columns == ["id", "schema_major", "run_id"]
    # older ones of the store go, whatever is written; all stay if all are asked for
    history.write_run(spark.createDataFrame([(k, k) for k in range(118, 300)], "run_id int, id int"), f"{tmp_path}/120-7", 3)
    assert {r["run_id"] for r in spark.read.parquet(f"{tmp_path}/120-7").collect()} == {297, 298, 299}
    history.write_run(spark.createDataFrame([(k, k) for k in range(20)], "run_id int, id int"), f"{tmp_path}/all", 0)
    assert spark.read.parquet(f"{tmp_path}/all").count() == 20


def test_unknown_states_and_exit_codes(spark):
    d = spark.createDataFrame([("r", "weird"), ("r", "passed")], "run string, status string")
    assert verdict.assertion_counts(d, ["run"]).first()["unevaluable"] == 1
    o = spark.createDataFrame([(x,) for x in verdict.EXIT_CODES], "o string").select("o", verdict.exit_code(F.col("o")).alias("c"), verdict.exit_code(F.col("o"), True).alias("z"))
    assert {r["o"]: (r["c"], r["z"]) for r in o.collect()} == {"clean": (0, 0), "failed": (1, 0), "errored": (2, 2), "undecided": (3, 0)}


def test_flat_lines_are_padded(spark):
    s = spark.createDataFrame([("a", "observed", "4"), ("b", "observed", "0"), ("c", "observed", "x")], "s string, state string, value string")
    assert {(r["s"], r["lo"], r["hi"]) for r in series.extent(s, ["s"]).collect()} == {("a", 2.0, 6.0), ("b", -1.0, 1.0)}


def test_expected_answers_by_capability(spark):
    claims = [("a", "2", "write", None, None), ("a", "1", "value", None, None), ("b", "5", None, None, True), ("c", "1", None, None, None), ("c", "2", "write", None, None)]
    f = spark.createDataFrame(claims, "assertion string, expected string, detection string, fidelity string, row_identity boolean")
    one, twice = summary.expected_answers(f, "write", "net", True)
    assert sorted(tuple(r) for r in one.collect()) == [("a", "2"), ("b", "5")] and [r["assertion"] for r in twice.collect()] == ["c"]
