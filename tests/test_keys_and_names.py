"""Keys by levels and names by an index, against going through all of them."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rowledger.functions import values
from rowledger.sources import scope


def all_minimal(rows, names, most):
    found = []
    for k in range(1, most + 1):
        for s in combinations(range(len(names)), k):
            cells = [tuple(r[i] for i in s) for r in rows]
            if not any(None in c for c in cells) and len(set(cells)) == len(rows) and not any(set(f) <= set(s) for f in found):
                found.append(s)
    return sorted(tuple(names[i] for i in s) for s in found)


@pytest.mark.parametrize("seed", range(3))
def test_minimal_keys(spark, seed):
    r = random.Random(seed)
    rows = [(i % 6, i // 6 % 6, i // 36, i % 2, r.randrange(3), None if i == 7 else i, str(i % 36)) for i in range(200)]
    names = ["a", "b", "c", "d e", "f", "g", "h"]
    d = spark.createDataFrame(rows, "a int, b int, c int, `d e` int, f int, g int, h string")
    assert sorted(scope.minimal_keys(d, 4)) == all_minimal(rows, names, 4)
    assert scope.infer_key(d) == (("c", "h"), scope.UNIQUE)
    assert scope.infer_key(d.drop("h")) == (("a", "b", "c"), scope.UNIQUE)  # three columns
    assert scope.minimal_keys(d.unionByName(d.limit(1))) == [] and scope.infer_key(d.drop("c", "g")) == ((), scope.KEYLESS)
    assert scope.minimal_keys(d.limit(0), 2) == [("a",), ("b",), ("c",), ("d e",), ("f",), ("g",), ("h",)]


def test_wide_table_is_searched_without_all_pairs(spark):
    d = spark.range(3000).select(*(((F.col("id") * (i + 1)) % 7).alias(f"c{i}") for i in range(60)), (F.col("id") % 60).alias("x"), (F.col("id") / 60).cast("int").alias("y"))
    seen = []
    estimate = scope.estimate_distinct
    scope.estimate_distinct = lambda df, sets: seen.extend(sets) or estimate(df, sets)
    try:
        assert scope.minimal_keys(d, 2) == [("x", "y")]
    finally:
        scope.estimate_distinct = estimate
    assert [s for s in seen if len(s) == 2] == [("x", "y")]  # the others have too few values to be a key


def distance(a, b):
    a, b = a.lower(), b.lower()
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def names(seed, n, longest):
    r = random.Random(seed)
    return sorted({"".join(r.choice("abCde_") for _ in range(r.randint(0, longest))) for _ in range(n)})


def slips(r, name, k):
    for _ in range(k):
        i = r.randrange(len(name) + 1)
        name = r.choice([name[:i] + r.choice("abcde_") + name[i:], name[:i] + name[i + 1 :], name[:i] + r.choice("abcde_") + name[i + 1 :], name[:i] + name[i + 1 : i + 2] + name[i : i + 1] + name[i + 2 :]])
    return name


@pytest.mark.parametrize(("loose", "longest"), [(False, 8), (True, 8), (True, 20)])
def test_suggestions_are_those_of_all_pairs(spark, loose, longest):
    r = random.Random(longest)
    known = [*names(1, 120, longest), "order_line_items", "ordre", "Order"]
    written = sorted({slips(r, r.choice(known), r.randint(0, 5)) for _ in range(250)} | set(names(2, 40, longest)))
    rows = [*((w,) for w in written), (written[0],), (None,)]
    got = scope.suggest(spark.createDataFrame(rows, "name string"), spark.createDataFrame([*((k,) for k in known), (None,)], "name string"), loose=loose)
    limit = lambda w: max(1, len(w) // 3) if loose else 1
    best = lambda w: min(((distance(w, k) if loose else 0, k) for k in known if distance(w, k) <= limit(w)), default=(0, None))[1]
    found = got.collect()
    assert len(found) == len(rows)
    assert {x["name"]: x["suggestion"] for x in found if x["name"] is not None} == {w: best(w) for w in written}


def test_typing_distance(spark):
    pairs = [("titel", "title"), ("wehre", "where"), ("nmae", "name"), ("", "abc"), ("abc", ""), ("CA", "abc"), ("x", None), ("kitten", "Sitting"), ("a\U0001f642b", "ab")]
    got = [r["d"] for r in spark.createDataFrame(pairs, "a string, b string").select(values.typing_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [None if b is None else distance(a, b) for a, b in pairs]
