"""Embeddings and images against brute force, components, and the pipeline's stages."""

from __future__ import annotations

import math
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowledger.llm import common, embedding_join, image_copies


def roots(ids, pairs):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    ids = list(range(200))
    pairs = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(r.randrange(140, 200), r.randrange(140, 200)) for _ in range(30)]
    e = spark.createDataFrame([*pairs, (5, None), (7, 7)], "src long, dst long")
    got = {x["id"]: x["component"] for x in common.components(spark.createDataFrame([(i,) for i in ids], "id long"), e).collect()}
    assert got == roots(ids, pairs)
    none = spark.createDataFrame([], "src long, dst long")
    assert common.components(spark.createDataFrame([(3,)], "id long"), none).collect() == [(3, 3)]


def vectors():
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 8))
    rows = []
    for i in range(240):
        v = base[i % 12] * r.uniform(0.5, 2) + r.normal(0, [0.02, 0.2, 0.6][i % 3], 8)
        rows.append((i, v.astype(float).tolist(), int(i % 4)))
    rows += [(240, None, 1), (241, [0.0] * 8, 1), (242, [math.nan] * 8, 1), (243, [None, *[1.0] * 7], 1), (244, [1.0] * 8, None), (245, [1.0, 2.0], 1), (246, [2.0, 4.0], 1), (247, [], 2), (248, [math.inf] * 8, 0)]
    rows += [(250 + k, rows[0][1], 0) for k in range(30)]  # copies
    rows += [(290 + k, (np.array(rows[1][1]) + r.normal(0, 1e-3, 8)).tolist(), 1) for k in range(100)]  # one tight group
    return rows


@pytest.mark.parametrize("cosine", [0.93, 0.5])
def test_embedding_join_is_brute_force(spark, cosine):
    rows = vectors()
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, unit int")
    ok = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0 and lab is not None}
    pairs = [(i, j) for i, (a, p) in ok.items() for j, (b, q) in ok.items() if i < j and p == q and len(a) == len(b) and a @ b >= cosine]
    n = {i: sum(i in p for p in pairs) for i, *_ in rows}
    comp = roots([i for i, *_ in rows], pairs)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_join.linked(d, cosine, sample=60).collect()}
    assert got == {i: (n[i], comp[i], comp[i] == i) for i, *_ in rows}
    assert embedding_join.linked(d.limit(0)).count() == 0


def test_traversal_counts_as_brute_force():
    r = np.random.default_rng(5)
    for spread in (0.02, 0.3, 2.0):
        x = r.normal(size=8) + r.normal(0, spread, (300, 8))
        x /= np.linalg.norm(x, axis=1)[:, None]
        w = r.integers(1, 4, 300)
        for same in (True, False):
            a, b = (x, x) if same else (x[:120], x[120:])
            wa, wb = (w, w) if same else (w[:120], w[120:])
            links, root, _ = embedding_join.block_links(a, wa, b, wb, 0.9, same)
            hit = a @ b.T >= 0.9
            if same:
                np.fill_diagonal(hit, False)
                assert links.tolist() == (hit @ wb).tolist()
            else:
                assert links.tolist() == [*(hit @ wb), *(hit.T @ wa)]
            pairs = [(int(i), int(j) + (0 if same else 120)) for i, j in np.argwhere(hit)]
            assert root.tolist() == list(roots(range(len(root)), pairs).values())


def picture(seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    g = np.full((120, 96), 255, np.uint8)
    for _ in range(60):
        y, x, h, w = r.integers(0, 110), r.integers(0, 86), r.integers(4, 20), r.integers(4, 20)
        g[y : y + h, x : x + w] = r.integers(0, 230)
    return g


def test_image_copies(spark):
    made = {i: picture(i) for i in range(8)}
    made[10] = made[0][17:100, 9:90]  # cropped
    edited = made[1].copy()
    edited[40:60, 30:60] = 10
    made[11] = edited
    made[12] = np.rot90(made[2]).copy()
    made[13] = made[3]
    rows = [(i, g.shape[1], g.shape[0], g.tobytes()) for i, g in made.items()] + [(20, 0, 0, b""), (21, 5, 5, b"abc"), (22, None, None, None), (None, 96, 120, made[0].tobytes()), (7, 96, 120, made[7].tobytes())]
    d = spark.createDataFrame([(*r, "x") for r in rows], "id long, width int, height int, pixels binary, key string")
    out = image_copies.copies(d)
    got = [(r["id"], r["component_id"], r["kept"]) for r in out.collect()]
    comp = {i: c for i, c, _ in got}
    assert {k: comp[k] for k in (10, 11, 12, 13)} == {10: 0, 11: 1, 12: 2, 13: 3}
    assert all(comp[i] == i for i in (*range(8), 20, 21, 22)) and comp[None] is None and len(got) == len(rows)
    assert image_copies.copies(d.limit(0)).count() == 0


def test_image_copies_behind_a_common_first(spark):
    """Pairs whose shared entries all have a third image first, byte-equal images with few corners, and flipped bits."""
    logo = picture(50)[:60]
    made = {k: np.vstack([logo[:, :96], picture(60 + k), picture(80 + k)]) for k in range(6)}
    for k in range(6):
        edited = made[k].copy()
        edited[200:215, 30:60] = 90
        made[10 + k] = edited
    made[30], made[31] = np.full((9, 9), 255, np.uint8), np.full((9, 9), 255, np.uint8)
    d = spark.createDataFrame([(i, g.shape[1], g.shape[0], g.tobytes()) for i, g in made.items()] + [(40, 96, 60, logo.tobytes())], "id long, width int, height int, pixels binary")
    comp = {r["id"]: r["component_id"] for r in image_copies.copies(d.where("id <> 40")).collect()}
    assert comp == {**{k: k for k in range(6)}, **{10 + k: k for k in range(6)}, 30: 30, 31: 30}
    # an image that is a part of all of them links them all
    assert {r["component_id"] for r in image_copies.copies(d.where("id < 30 or id = 40")).collect()} == {0}


def test_image_votes_allow_flipped_bits():
    c = np.zeros(8, image_copies.CORNER)
    r = np.random.default_rng(2)
    c["bits"], c["y"], c["x"] = r.integers(0, 1 << 63, (8, 2)), r.integers(0, 90, 8), r.integers(0, 90, 8)
    other = c.copy()
    other["bits"] ^= np.uint64(1 << 40 | 1 << 3)  # one bit of each quarter: no equal half
    other["y"] += 12
    assert image_copies.agreed(c, other) == image_copies.agreed(other, c) == 8


def test_images_described_together_and_alone():
    r = np.random.default_rng(5)
    made = [r.integers(0, 256, (int(h), int(w)), np.uint8) for h, w in r.integers(1, 60, (40, 2))] + [picture(1), picture(2), np.full((30, 40), 255, np.uint8)]
    together = image_copies.describe(made)
    assert [c.tobytes() for c in together] == [image_copies.describe([g])[0].tobytes() for g in made] and sum(map(len, together)) > 100


def test_image_candidates_meet_several_times(spark):
    """A pair that meets in one corner alone is no candidate; every pair with as many as a link needs is one, also by another table."""
    r = np.random.default_rng(4)
    made = [np.zeros(20, image_copies.CORNER) for _ in range(6)]
    for c in made:
        c["bits"] = r.integers(0, 1 << 63, (20, 2))
    made[1]["bits"][7] = made[0]["bits"][3]  # one corner in common
    made[3]["bits"][:8] = made[2]["bits"][12:]  # as many as needed
    made[5]["bits"][:8] = made[4]["bits"][12:] ^ np.array([0x100000001, 0], np.uint64)  # in the last two tables alone
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = [(k, 20, c.tobytes(), np.packbits(image_copies.brought(c, np.array([20]), none, 5, 0.4)).tobytes(), k) for k, c in enumerate(made)]
    d = spark.createDataFrame(rows, "picture long, n long, corners binary, brought binary, component long").repartition(3)
    found = {}
    for band in range(4):
        for part in range(image_copies.PARTS):
            for x in image_copies.met(d, band, part).collect():
                found[x["a"], x["b"]] = found.get((x["a"], x["b"]), 0) + x["common"]
    assert {k for k, n in found.items() if n >= image_copies.meeting(5)} == {(2, 3), (4, 5)} and found[0, 1] == 1


def image_family() -> list[np.ndarray]:
    """Pictures with crops, edits, turns, halves and repeated parts."""
    made = [picture(100 + k) for k in range(10)]
    made += [made[0][10:90, 5:80], made[1][:70], np.rot90(made[2]).copy(), made[3][::2, ::2].copy(), np.vstack([made[4], made[5]]), np.vstack([made[6][:60]] * 4)]
    for k in range(7, 10):
        edited = made[k].copy()
        edited[20 * (k - 6) : 20 * (k - 6) + 30, 10:70] = 40
        made += [edited, edited[:80]]
    return made


def image_block(c: list[np.ndarray]) -> image_copies.Block:
    ids = sorted(range(len(c)), key=lambda k: len(c[k]))
    return image_copies.Block(np.array(ids), np.array(ids), np.array([len(c[k]) for k in ids]), b"".join(c[k].tobytes() for k in ids))


def test_image_transforms_in_a_block_count_as_alone():
    """Every transform that a match votes for, looked at in the block, gives the number that all matches of the two pictures give."""
    c = image_copies.describe(image_family())
    block, seen = image_block(c), []
    for p in range(len(c)):
        for there, q in enumerate(block.picture.tolist()):
            apart = np.bitwise_count(c[p]["bits"][:, None] ^ c[q]["bits"][None]).sum(2, dtype=int)
            i, j = np.nonzero(apart <= image_copies.BITS_APART)
            t = np.unique(image_copies.packed(image_copies.transforms(c[p][i], c[q][j])))
            assert (image_copies.packed(image_copies.unpacked(t)) == t).all()
            most = image_copies.under(block, c[p], np.array([len(c[p])]), np.full(len(t), there), t).max(initial=0)
            assert most == image_copies.agreed(c[p], c[q])
            seen.append(most)
    assert sum(5 <= x < 30 for x in seen) > 10


def test_image_candidates_do_not_depend_on_what_is_held(monkeypatch):
    c = image_copies.describe(image_family())
    block, n = image_block(c), np.array([len(x) for x in c])
    ids, of, every = np.arange(len(c)), np.repeat(np.arange(len(c)), n), np.ones(n.sum(), bool)
    look = lambda: sorted(zip(*(x.tolist() for x in image_copies.candidates(block, ids, ids, n, np.concatenate(c), of, every, 2)), strict=True))
    usual = look()
    monkeypatch.setattr(image_copies, "COUNTED", 50)
    monkeypatch.setattr(image_copies, "HITS", 7)
    assert look() == usual and len(usual) > 10


def test_image_components_are_those_of_all_pairs(spark, monkeypatch):
    """By several blocks, in few jobs however many tables and rounds the hits would have taken."""
    made = image_family()
    c = image_copies.describe(made)
    need = lambda a, b: max(5, math.ceil(0.4 * min(len(a), len(b))))
    order = sorted(range(len(c)), key=lambda k: (len(c[k]), k))
    linked = [(a, b) for x, a in enumerate(order) for b in order[x + 1 :] if len(c[a]) >= 5 and image_copies.agreed(c[a], c[b], need(c[a], c[b])) >= need(c[a], c[b])]
    d = spark.createDataFrame([(i, g.shape[1], g.shape[0], g.tobytes()) for i, g in enumerate(made)], "id long, width int, height int, pixels binary")
    monkeypatch.setattr(image_copies, "BLOCK", sum(map(len, c)) // 5, raising=False)
    spark.sparkContext.setJobGroup("images", "images")
    got = {r["id"]: r["component_id"] for r in image_copies.copies(d).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("images"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == roots(range(len(made)), linked) and 6 < len(set(got.values())) < len(made) - 5
    assert jobs < 140


def test_page_images(spark):
    d = spark.createDataFrame([(1, "<p>one two</p><script>x</script><p>three</p>"), (2, None), (3, "")], "page_id long, html string")
    got = {r["id"]: (r["width"], r["height"], len(r["pixels"])) for r in image_copies.page_images(d).collect()}
    assert got == {1: (64, 4, 256), 2: (64, 0, 0), 3: (64, 0, 0)}


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, common.table(stage(spark, docs, SF), f"test-{name}")
        if i < 3:
            assert docs.columns == columns
        if name == "toxicity":
            toxic = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").join(before, "doc_id")
            assert toxic.join(docs, "doc_id", "left_anti").count() <= 0.02 * toxic.count()
        if name == "ngram_jaccard_join":
            assert docs.groupBy("doc_id").count().where("count > 1").count() == 0 and docs.count() < before.count()
        if name == "mixing_sources":
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")
def test_oracle_texts(spark):
    import duckdb

    from rowledger.llm import queries

    c = duckdb.connect()
    for f in sorted(Path(SF).glob("*.parquet")):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF).toPandas(), c.sql(sql).df()
        cols = sorted(got.columns)
        cell = lambda v: "" if pd.isna(v) else v if isinstance(v, str) else str(round(float(v), 6))
        plain = lambda f, cell=cell, cols=cols: sorted(tuple(map(cell, row)) for row in f[cols].values.tolist())
        assert cols == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")
def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null and empty texts, null and repeated ids, equal rows, a very long text, and columns named as those inside the stages."""
    import corpus_pipeline

    given = spark.read.parquet(f"{SF}/documents.parquet")
    shape = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in given.schema)}"
    usual = "the committee met on tuesday to look at the new bridge over the river and its cost for the town"
    odd = [
        (900001, None, "en", "a", 0), (900001, None, "en", "a", 0), (900002, "", "en", None, 0), (None, "a text of its own that has no id and shares no words in a row with any other one of these", "en", None, 9), (None, usual + " without an id", "en", None, 9), (None, None, None, None, None), (900003, usual, "en", "b", 9), (900004, usual, "en", "b", 9), (900004, usual, "en", "b", 9),
        (900005, " \n\t ", "en", "b", 3), (900006, " ".join(f"word{i} of a long text" for i in range(9000)), "en", "b", 9),
    ]
    docs = given.limit(120).unionByName(spark.createDataFrame(odd, shape))
    beside = {"id": F.lit("x"), "row": F.lit(1), "component": F.lit(2.5), "size": F.lit("s"), "words": F.array(F.lit(1)), "u": F.lit(None).cast("int"), "tree": F.lit(True)}
    docs.withColumns(beside).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").withColumn("text", F.lit("clash")).write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.table(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        if i < 3:
            assert docs.columns == columns
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        seen.append({k: ids.count(k) for k in (None, *range(900001, 900007))})
    assert seen[0] == {None: 3, 900001: 2, 900002: 1, 900003: 1, 900004: 2, 900005: 1, 900006: 1}
    # the third row without an id is a near copy of 900003
    assert seen[1] == {None: 2, 900001: 1, 900002: 1, 900003: 1, 900004: 0, 900005: 1, 900006: 1}
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert docs.where("doc_id = 900006").count() == 0 or docs.where("doc_id = 900006").agg(F.sum("length")).first()[0] > 9000
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == docs.count()
    # an empty table
    given.limit(0).withColumns(beside).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    empty = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert empty.collect() == [] and empty.columns == whole.columns
