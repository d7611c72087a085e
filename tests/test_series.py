"""Series as intervals, read at steps, against a plain walk over the grid."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from rowledger.operators import series


def walk(steps, rows):
    """(series, step, state, value, since) by going through every series and step."""
    at = {}
    for s, step, v in rows:
        at.setdefault(s, {}).setdefault(step, []).append(v)
    out = []
    for s, seen in at.items():
        last = since = None
        for step in sorted({*steps, *(x for x in seen if x is not None)}):
            got = seen.get(step, [])
            if len(got) > 1:
                found = ("unevaluable", None, None)
            elif got and got[0] is not None:
                last, since = got[0], step
                found = ("observed", last, since)
            else:
                found = ("carried", last, since) if since is not None else ("unobserved", None, None)
            if step in steps:
                out.append((s, step, *found))
    return sorted(out, key=str)


def rows_of(seed, n, number):
    r = random.Random(seed)
    rows = [(r.choice("abc"), number(r.randrange(30)), r.choice([None, 1, 2, 3])) for _ in range(n)]
    return [*rows, ("quiet", number(4), None), ("quiet", number(5), None), ("twice", number(3), None), ("twice", number(3), None), ("lost", None, 5)]


@pytest.mark.parametrize(("kind", "number"), [("long", lambda i: i * 3), ("date", lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)), ("string", lambda i: f"s{i:02}")])
def test_grid_of_intervals(spark, kind, number):
    rows = rows_of(1, 60, number)
    steps = [number(i) for i in (0, 1, 2, 5, 8, 9, 10, 17, 28, 29, 40)]  # some that nobody saw; not all that were seen
    values = spark.createDataFrame([(*x, "x") for x in rows], f"s string, step {kind}, v int, state string")
    asked = spark.createDataFrame([(x,) for x in [*steps, steps[0], None]], f"step {kind}")
    got = series.observe(asked, values, ["s"], "step", "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert sorted((tuple(r) for r in got.collect()), key=str) == walk(steps, rows)
    assert series.observe(asked.limit(0), values, ["s"], "step", "v").collect() == []
    assert series.observe(asked, values.limit(0), ["s"], "step", "v").collect() == []


def test_intervals_follow_observations(spark):
    values = spark.createDataFrame([("a", 5, 1), ("a", 1_000_000_000, 2), ("b", 7, None)], "s string, step long, v int")
    got = {tuple(r) for r in series.intervals(values, ["s"], "step", "v").collect()}
    far = 1_000_000_000
    assert got == {
        ("a", None, None, 5, "unobserved", None, None), ("a", None, 5, None, "observed", 1, 5), ("a", 5, None, far, "carried", 1, 5),
        ("a", None, far, None, "observed", 2, far), ("a", far, None, None, "carried", 2, far), ("b", None, None, None, "unobserved", None, None),
    }
