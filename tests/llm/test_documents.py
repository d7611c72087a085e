"""Operators on documents against the libraries and brute force, on a fixture of odd rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowledger.llm import common, license_scan, lm_scoring, mixing, ngram_join, packing, token_counts, token_files, toxicity
from rowledger.llm.queries import vocabulary

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id long, n_tokens string, size string, node string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts() -> list[str | None]:
    r = random.Random(5)
    long = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(3000)]
    base = [r.choice(WORDS) + str(r.randrange(99)) for _ in range(120)]
    near = [list(base) for _ in range(6)]
    for i, w in enumerate(near):
        for j in range(i):
            w[17 * j + 3] = f"edit{i}"
    out: list[str | None] = [None, "", " ", "\n\t", "one", "One two", "ONE two three", "one  two\x0bthree", "x " * 40, "<|endoftext|> a <|endoftext|>", "é ́a  İ ß ﬁ 日本語", "a\x1cb \x85c\xa0d"]
    out += [" ".join(long), " ".join(long), " ".join(long[:2900] + ["tail"]), *(" ".join(w) for w in near), " ".join(base), "Released under the MIT License.", "We say: released under the MIT license"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 5}", None, 9, "x", "y", "z") for i, t in enumerate(texts())]
    rows += [rows[12], (None, "no id here at all", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def library(name: str) -> list[list[int]]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts()], add_special_tokens=False)]


def test_memo_is_the_library():
    from tokenizers import Tokenizer

    r = random.Random(3)
    odd = ["".join(r.choice(" \n\tabAÉ²½ª'.1é_ ́Σ<|İß\x85\xa0\x1c") for _ in range(r.randint(0, 14))) for _ in range(3000)] + [t or "" for t in texts()]
    for kind, name in ((common.ByteBpe, "byte_bpe_50k.json"), (common.WordBpe, "word_bpe_49k.json")):
        t, m = Tokenizer.from_file(vocabulary(name)), kind(vocabulary(name), token_files.pack_ids, b"", 50)
        for x, e in zip(odd, t.encode_batch(odd, add_special_tokens=False), strict=True):
            assert b"".join(m.values(x)) == token_files.pack_ids(e.ids), ascii(x)


def test_a_word_before_a_stop_is_encoded_once(monkeypatch):
    for kind, name in ((common.ByteBpe, "byte_bpe_50k.json"), (common.WordBpe, "word_bpe_49k.json")):
        m, seen = kind(vocabulary(name), token_files.pack_ids, b""), []
        real = m.piece_value
        monkeypatch.setattr(m, "piece_value", lambda piece: seen.append(piece) or real(piece))
        for text in ("0 seul été. été seul, seul! seul", "0 seul. été, seul"):
            assert b"".join(m.values(text)) == token_files.pack_ids(m.ids(text))
        assert sum("seul" in piece for piece in seen) == 1, seen


def test_words_that_differ_by_case_are_encoded_once(monkeypatch):
    m, seen = common.WordBpe(vocabulary("word_bpe_49k.json"), token_files.pack_ids, b""), []
    real = m.piece_value
    monkeypatch.setattr(m, "piece_value", lambda piece: seen.append(piece) or real(piece))
    text = "The the THE. thE, tHe!"
    assert b"".join(m.values(text)) == token_files.pack_ids(m.ids(text))
    assert seen.count("the") == 1, seen


def test_a_solution_is_valued_once(monkeypatch):
    r = random.Random(4)
    island = packing.Island([r.randint(1, 700) for _ in range(60)], 1024, 5)
    people, seen, real = [island.start(0.15 * j) for j in range(3)], [], island.value
    monkeypatch.setattr(island, "value", lambda bins: seen.append(1) or real(bins))
    monkeypatch.setattr(island, "lengths", [*island.lengths, -(10**6)])  # no solution is ever the last one possible
    assert len(island.evolve(people, 8)) == 3 and len(seen) == 11


def test_counts_at_every_prefix():
    m = token_counts.PrefixTables(vocabulary("byte_bpe_50k.json"))
    r = random.Random(1)
    some = ["foo\n bar", "don't we'll 'r", "a\n\n b  c", "x<|endoftext|> y<|endo", "\x1c a\x1c\x1d b", "日本é"] + ["".join(r.choice(" \n\tabthe'rl.1é日") for _ in range(r.randint(0, 20))) for _ in range(100)]
    for t in some:
        want = [len(m.ids(t[:i])) for i in range(len(t) + 1)]
        assert m.table(t).tolist() == want, ascii(t)
        for budget in (0, 1, 3, 5):
            assert m.cut(m.counts(t), budget) == max(i for i, c in enumerate(want) if c <= budget)


def test_a_word_before_a_stop_has_one_table(monkeypatch):
    m, seen = token_counts.PrefixTables(vocabulary("byte_bpe_50k.json")), []
    real = m.piece
    monkeypatch.setattr(m, "piece", lambda text: seen.append(text) or real(text))
    text = "0 seul été. été seul, seul! seul"
    got = m.counts(text).tolist()
    assert seen.count(" seul") == 1 and seen.count(" été") == 1, seen
    assert got == [len(m.ids(text[:i])) for i in range(len(text) + 1)]


def test_stored_counts_are_the_tables():
    m = token_counts.PrefixTables(vocabulary("byte_bpe_50k.json"))
    r = random.Random(8)
    some = [t or "" for t in texts()[:-12]] + ["a  b", " a\n\n b  c ", "  \n x", "\u3000 y z", "don't  'll"] + ["".join(r.choice(" \n\tabthe'rl.1é日<|") for _ in range(r.randint(0, 30))) for _ in range(300)]
    for t in some:
        assert m.counts(t).tolist() == m.table(t).tolist(), ascii(t)


def test_counts_come_from_the_tables_alone(monkeypatch):
    m = token_counts.PrefixTables(vocabulary("byte_bpe_50k.json"))
    want = [len(m.ids(t or "")) for t in texts()]
    monkeypatch.setattr(m, "tokenizer", None)  # no whole text is encoded
    assert [int(m.counts(t or "")[-1]) for t in texts()] == want


def test_token_counts_query_stores_every_prefix(spark, tmp_path):
    from rowledger.llm.queries import op2_token_counts

    spark.createDataFrame([(1, "one two  three"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op2_token_counts(spark, str(tmp_path)).collect()}
    m = token_counts.PrefixTables(vocabulary("byte_bpe_50k.json"))
    assert got[1]["prefix_tokens"] == [len(m.ids("one two  three"[:i])) for i in range(15)] and got[2]["prefix_tokens"] == [0]


def test_token_counts(docs, empty):
    path = vocabulary("byte_bpe_50k.json")
    out = token_counts.within_budget(token_counts.prefix_counts(docs, path, (512,), with_table=True), 512)
    got = {r["doc_id"]: r for r in out.collect()}
    for i, (t, ids) in enumerate(zip(texts(), library("byte_bpe_50k.json"), strict=True)):
        r = got[i]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), len(ids), len(ids) > 512) and len(r["prefix_tokens"]) == len(t or "") + 1
    assert out.count() == docs.count() and token_counts.prefix_counts(empty, path).count() == 0
    cut = token_counts.truncate(docs.where("doc_id = 12").distinct(), path, 512).first()["text"]
    assert 0 < len(cut) < len(texts()[12])


def test_truncated_rows_stay_what_they_are(spark):
    path = vocabulary("byte_bpe_50k.json")
    rows = [(1, "one two three four five", "a"), (1, "un deux", "b"), (None, "no id here at all, but a text", "c"), (2, None, None), (3, "", "d"), (1, "one two three four five", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    m = token_counts.PrefixTables(path)
    longest = lambda t: next(t[:n] for n in range(len(t), -1, -1) if len(m.ids(t[:n])) <= 3)
    want = sorted(((i, None if t is None else longest(t), x) for i, t, x in rows), key=str)
    got = token_counts.truncate(d, path, 3)
    assert got.columns == d.columns and sorted((tuple(r) for r in got.collect()), key=str) == want
    assert token_counts.truncate(d.limit(0), path, 3).collect() == []


def test_token_files(spark, docs, empty, tmp_path):
    path = vocabulary("word_bpe_49k.json")
    token_files.write(docs, f"{tmp_path}/t", path, 1)
    back = token_files.read(spark, f"{tmp_path}/t")
    got = token_files.checksums(back).collect()
    want = {i: [*ids, 1] for i, ids in enumerate(library("word_bpe_49k.json"))}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_tokens"], r["ids_crc32"]) == (len(want[r["doc_id"]]), zlib.crc32(token_files.pack_ids(want[r["doc_id"]])))
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in ordered].index(False) == 1 and [r["doc_id"] for r in ordered[1:]] == sorted(r["doc_id"] for r in ordered[1:])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()
    token_files.write(empty, f"{tmp_path}/e", path, 1)
    assert token_files.checksums(token_files.read(spark, f"{tmp_path}/e")).count() == 0
    plan = back.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan.replace("n_tokens", "")


def test_packing(docs, empty):
    path = vocabulary("byte_bpe_50k.json")
    got = packing.pack_documents(docs.where("doc_id is not null").distinct(), path, group_size=10, epochs=2).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in enumerate(library("byte_bpe_50k.json")):
        ids, at = [*ids, 2], 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(token_files.pack_ids(ids[at : at + r["length"]])) and (k == 0 or r["length"] == 1024)
            at += r["length"]
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(empty, path).count() == 0 and packing.pack_documents(docs, path).select("doc_id").where("doc_id = 12").count() > len(by[12])


def test_genetic_packing_is_close_to_the_bound():
    r = random.Random(2)
    n = [r.randint(10, 700) for _ in range(400)]
    isle = packing.Island(n, 1024, 1)
    first = isle.start(0.15)
    best = isle.evolve([first, isle.start(0.1), isle.start(0)], 20)[0]
    assert sorted(i for b in best for i in b) == list(range(400)) and all(sum(n[i] for i in b) <= 1024 for b in best)
    assert len(best) <= len(first) and len(best) <= 1.02 * -(-sum(n) // 1024) + 1


def sets(width: int = 4) -> dict[int, set]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in enumerate(texts()):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("num", [85, 60])
def test_ngram_join_is_brute_force(docs, empty, num):
    s = sets()
    parent = {i: i for i in s}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in s:
        for j in s:
            if i < j and s[i] and 100 * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = ngram_join.classes(docs, num, 100, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert {i: got[i] for i in s} == {i: (len(s[i]), root(i)) for i in s} and got[None][1] is None
    assert out.count() == docs.count() and ngram_join.classes(empty).count() == 0
    kept = {r["doc_id"] for r in ngram_join.representatives(docs, num, 100, 4).collect()}
    assert kept == {i for i in s if root(i) == i} | {None}


def test_ngram_join_of_a_large_group_near_the_threshold(spark, monkeypatch):
    """Many copies with a few edits each, most pairs of which just miss the threshold, and texts that share one passage."""
    monkeypatch.setattr(ngram_join, "ROWS", 16)
    r = random.Random(2)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(110):
        w = list(base)
        for k in r.sample(range(4, 86), r.choice((1, 1, 2, 2, 3))):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join([*base[:30], *(f"p{i}q{k}" for k in range(20))])) for i in range(60)]
    parent, s = {i: i for i, _ in rows}, {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in s:
        for j in s:
            if i < j and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in s} and 2 < len(set(map(root, range(110)))) < 100


def test_prefix_tables_know_every_entry_and_small_memos_change_nothing():
    path = vocabulary("byte_bpe_50k.json")
    full, small = token_counts.PrefixTables(path), token_counts.PrefixTables(path, 20)
    assert all(len(t) in full.lengths.get(t[-4:] if len(t) > 3 else "", token_counts.SHORT) for t in full.vocab)
    r = random.Random(4)
    for _ in range(40):
        text = " ".join("".join(r.choices("abcdeinorstéß'.-1 \n", k=r.randrange(1, 24))) for _ in range(30))
        assert full.counts(text).tolist() == small.counts(text).tolist() == full.table(text).tolist()
        assert int(full.counts(text)[-1]) == len(full.ids(text))
        piece = "".join(r.choices("abcdeinorst", k=20))
        assert list(full.piece(piece)) == [len(full.ids(piece[:k])) for k in range(21)]


def test_long_entries_are_dealt_once_and_lose_no_pair(spark, monkeypatch):
    """A node is at home in one block; only what lies outside of the largest component visits the others."""
    monkeypatch.setattr(ngram_join, "ROWS", 16)
    r = np.random.default_rng(3)
    nodes = [int(x) for x in r.permutation(10_000)[:600]]
    component = {x: min(nodes) if k < 560 else x for k, x in enumerate(nodes)}
    one = bytes(64)  # sketches that exclude nothing
    d = spark.createDataFrame([(1, x, 600, 100, one, component[x], component[x] == x) for x in nodes], "entry long, node long, size long, n long, sketch binary, component long, visits boolean")
    blocks = 600 // 16 + 1
    visitors = sum(component[x] == x for x in nodes)
    assert ngram_join.dealt(d).count() == 600 + visitors * (blocks - 1)
    assert ngram_join.dealt(d.withColumn("visits", F.lit(False))).count() == 600
    got = {(x["a"], x["b"]) for x in ngram_join.blocks(d, ngram_join.Threshold(85, 100), 1000).collect()}
    assert got == {(a, b) for a in nodes for b in nodes if a > b and component[a] != component[b]}


def test_sets_that_link_share_a_rarest_shingle(spark):
    r, limit = np.random.default_rng(5), ngram_join.Threshold(85, 100)
    common = r.integers(0, 2**63, 40, np.uint64)
    made = []
    for _ in range(60):
        base = np.concatenate([common[: r.integers(0, 40)], r.integers(0, 2**63, r.integers(1, 60), np.uint64)])
        made += [np.unique(np.where(r.random(len(base)) < 0.06, r.integers(0, 2**63, len(base), np.uint64), base)) for _ in range(3)]
    d = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(made)], "node long, shingles binary")
    keys = {}
    for x in ngram_join.rarest(d, limit).collect():
        keys.setdefault(x["node"], set()).add(x["entry"])
    linked = [(i, j) for i in range(len(made)) for j in range(i) if limit.linked(len(np.intersect1d(made[i], made[j])), len(made[i]), len(made[j]))]
    assert len(linked) > 20 and all(keys[i] & keys[j] for i, j in linked)


@pytest.mark.parametrize("deal", [1, 2, 50])
def test_blocks_lose_no_pair_between_components(deal):
    r = np.random.default_rng(4)
    i, j = np.nonzero(np.triu(r.random((40, 40)) < 0.4, 1))
    far, names = r.integers(0, 9, len(i)), r.integers(0, 5, 40)
    label = np.arange(40)
    for k in ngram_join.forest(i, j, far, 40):
        assert label[i[k]] != label[j[k]]
        label[label == label[j[k]]] = label[i[k]]
    assert len(set(label)) == 1 and len(ngram_join.forest(i, j, far, 40)) == 39
    at, more = ngram_join.nearest(i, j, far, names, deal)
    cross = set(np.flatnonzero(names[i] != names[j]))
    assert set(at) <= cross and more == (set(at) != cross)
    for node in range(40):
        for other in set(names) - {names[node]}:
            mine = sorted(int(far[k]) for k in cross if node in (i[k], j[k]) and names[i[k] if j[k] == node else j[k]] == other)
            assert sorted(int(far[k]) for k in at if node in (i[k], j[k]) and names[i[k] if j[k] == node else j[k]] == other)[: min(deal, len(mine))] == mine[:deal]


def test_ngram_join_indexes_rows_with_ids(spark):
    w = [f"w{k}" for k in range(120)]
    a, b, c = " ".join(w), " ".join([*w[:-1], "tail"]), " ".join(["head", *w[1:]])
    d = spark.createDataFrame([(None, a), (4, a), (2, b), (9, c), (None, "quite alone")], "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["component_id"]) for r in ngram_join.classes(d).collect()]
    assert sorted(got, key=str) == sorted([(None, None), (4, 2), (2, 2), (9, 2), (None, None)], key=str)


def test_near_duplicates_keep_one_row(spark):
    import corpus_pipeline

    w = [f"w{k}" for k in range(120)]
    text, near, mid = " ".join(w), " ".join([*w[:-1], "tail"]), " ".join([*w[:80], "edit", "edit2", *w[82:100], *w[102:]])
    a, b = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (text, mid))
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    rows = [(None, text), (5, text), (5, text), (7, near), (7, "one of its own"), (8, mid), (None, "alone here"), (None, "alone here"), (3, ""), (3, ""), (None, None), (None, None)]
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(got, key=str) == sorted([(5, text), (7, "one of its own"), (None, "alone here"), (3, ""), (None, None), (None, None)], key=str)


def test_ngram_join_finds_every_link():
    r = random.Random(9)
    limit = ngram_join.Threshold(85, 100)
    plan = ngram_join.allocate(limit, {b: 10**7 for b in range(64)})
    for size in (1, 2, 5, 6, 7, 11, 12, 20, 33, 60, 150, 700):
        for _ in range(20):
            a = {r.getrandbits(64) for _ in range(size)}
            b = set(a)
            for _ in range(r.randint(0, max(1, size // 6))):
                x = r.random()
                if x < 0.6 and len(b) > 1:
                    b.discard(r.choice(sorted(b)))
                if x > 0.4:
                    b.add(r.getrandbits(64))
            x, y = np.array(sorted(a), np.uint64), np.array(sorted(b), np.uint64)
            both = len(a & b)
            assert ngram_join.apart(ngram_join.sketch(x), ngram_join.sketch(y)) <= len(a ^ b)
            if limit.linked(both, len(a), len(b)) and a != b:
                ex = {e for k in limit.schemes(len(a)) for e in ngram_join.entries(x, k, *plan[k][:2])}
                ey = {e for k in limit.schemes(len(b)) for e in ngram_join.entries(y, k, *plan[k][:2])}
                assert ex & ey


def test_mixing(spark, docs, empty):
    out = mixing.mix(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert [r["taken"] for r in sorted(rows, key=str)] == [r["taken"] for r in sorted(mixing.mix(docs).collect(), key=str)]
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    import re

    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts())}
    for r in rows:
        assert r["doc_id"] is None or r["size"] == words[r["doc_id"]]
        assert r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
    names = sorted(k for k in size if k is not None) + [None]
    w = {n: i % 3 + 1 for i, n in enumerate(names)}
    want, open_, total = {}, set(names), sum(size.values())
    while True:  # shared again and again until none is above
        level = (total - sum(want.values())) / max(1e-9, sum(w[n] for n in open_))
        over = {n for n in open_ if level * w[n] > 3 * size[n]}
        if not over:
            break
        want |= {n: 3.0 * size[n] for n in over}
        open_ -= over
    want |= {n: level * w[n] for n in open_}
    for n in names:
        assert target[n] == pytest.approx(want[n])
        assert abs(taken[n] - target[n]) <= max(r["size"] for r in rows if r["source"] == n)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {r["doc_id"]: r["copies"] for r in rows if r["copies"] and r["doc_id"] != 12} == {k: v for k, v in copies.items() if k != 12}


def test_mixing_takes_equal_rows_one_by_one(spark):
    text = " ".join(["w"] * 10)
    rows = [(1, text, "a")] * 50 + [(None, text, None)] * 40 + [(k, " ".join(["x"] * 7), "b") for k in range(30)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), (1.0, 2.0, 1.0)).collect()
    for name in ("a", "b", None):
        own = [r for r in out if r["source"] == name]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= own[0]["size"] / 2 and max(r["copies"] for r in own) <= 3


def test_mixing_ranks_by_pareto(spark):
    """Inclusion probabilities grow with the size, so the order is not that of the random numbers alone."""
    r = random.Random(6)
    rows = [(k, " ".join(["w"] * r.choice((1, 3, 9, 40, 200, 1000))), "ab"[k % 2]) for k in range(600)]
    d = mixing.measured(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    plan = mixing.mix_plan(d, (1.0, 3.0))
    got = [x.asDict() for x in mixing.with_copies(d, plan).collect()]
    for name in "ab":
        own = [x for x in got if x["source"] == name]
        p = {x["x"]: x["whole"] + x["p"] for x in own}
        assert sorted(p.values()) == [p[k] for k in sorted(p)] and len(set(p.values())) > 3
        assert sum(p[x["x"]] * x["size"] for x in own) == pytest.approx(own[0]["target"])
        open_ = [x for x in own if x["p"] > 0]
        order = sorted(open_, key=lambda x: (x["u"] / (1 - x["u"]) / (x["p"] / (1 - x["p"])), x["id"]))
        at, taken = 0, set()
        for x in order:
            if at + x["size"] / 2 <= x["rest"]:
                taken.add(x["id"])
            at += x["size"]
        assert {x["id"] for x in open_ if x["copies"] > x["whole"]} == taken
        assert taken != {x["id"] for x in sorted(open_, key=lambda x: x["u"])[: len(taken)]}


def test_license_scan(spark, docs, empty):
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(docs).collect()}
    assert got == {(22, "MIT"), (23, "MIT")} and license_scan.scan(empty).count() == 0 and license_scan.scan(docs, {}).count() == 0
    t = license_scan.TEMPLATES["MIT-text"].split()
    edited = " ".join(["intro"] * 30 + t[:40] + ["really"] + t[43:] + ["outro"] * 30)
    r = license_scan.scan(spark.createDataFrame([(1, edited)], "doc_id long, text string")).collect()
    assert [(x["license"], x["first_word"], x["last_word"]) for x in r] == [("MIT-text", 30, 30 + len(t) - 3)] and 0.9 < r[0]["coverage"] < 1
    memo = license_scan.WordHashes()
    a, b = (license_scan.words(" ".join(x), memo)[0] for x in (t, edited.split()))
    assert len(license_scan.chain(license_scan.meetings(b, a, 30))) == len(a) - 3  # brute force: three words of the template are gone


def test_alignment_is_a_longest_common_subsequence():
    """Against the plain table, for all templates: edited copies at several places, within the band."""
    r, memo = random.Random(4), license_scan.WordHashes()
    for text in license_scan.TEMPLATES.values():
        t = license_scan.words(text, memo)[0]
        doc = [f"x{k}" for k in range(r.randrange(9))]
        for w in text.split():
            x = r.random()
            doc += [w] if x < 0.9 else [w, "extra"] if x < 0.93 else ["other"] if x < 0.96 else []
        h = license_scan.words(" ".join([*doc, "the", "end"]), memo)[0]
        d = len(doc) - len(text.split()) - 2
        c = license_scan.chain(license_scan.meetings(h, t, d))
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:], strict=False)) and all(h[j] == t[i] and abs(j - i - d) <= license_scan.band(t) for i, j in c)
        best = np.zeros((len(t) + 1, len(h) + 1), int)
        for i in range(len(t)):
            for j in range(len(h)):
                hit = h[j] == t[i] and abs(j - i - d) <= license_scan.band(t)
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + 1 if hit else 0)
        assert len(c) == best[-1, -1]


def test_license_scan_loses_no_match(spark):
    mit, short = license_scan.TEMPLATES["MIT-text"].split(), license_scan.TEMPLATES["CC-BY-NC-4.0"]
    cases = {
        1: " ".join([short] * 20), 2: " ".join([*mit[:60], *(f"put{k}" for k in range(12)), *mit[60:]]), 3: " ".join([*mit[:50], *mit[62:]]), 4: " ".join(["far"] * 5000 + mit + ["away"] * 5000), 5: " ".join(mit + ["between"] * 3 + mit),
        6: " ".join([*mit[:80], *(f"gap{k}" for k in range(400)), *mit[80:]]), 7: " ".join([*mit[:40], "one", *(f"a{k}" for k in range(20)), *mit[40:90], *(f"b{k}" for k in range(20)), *mit[90:]]),
    }
    got = defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame([*cases.items(), (1, cases[1]), (None, short)], "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["license"], r["matched"], r["first_word"], r["last_word"]))
    n = len(mit)
    assert sorted(got[1]) == sorted([("CC-BY-NC-4.0", 5, 5 * k, 5 * k + 4) for k in range(20)] * 2) and got[None] == [("CC-BY-NC-4.0", 5, 0, 4)]
    assert got[2] == [("MIT-text", n, 0, n + 11)] and got[3] == [("MIT-text", n - 12, 0, n - 13)] and got[4] == [("MIT-text", n, 5000, 4999 + n)]
    assert sorted(got[5]) == [("MIT-text", n, 0, n - 1), ("MIT-text", n, n + 3, 2 * n + 2)] and got[6] == [("MIT-text", n, 0, n + 399)] and got[7] == [("MIT-text", n, 0, n + 40)]


def test_license_scan_joins_far_pieces(spark):
    """Pieces however far apart count together, what lies between stays free, and many matches take no time for each other."""
    mit, isc, unlicense = (license_scan.TEMPLATES[k].split() for k in ("MIT-text", "ISC", "Unlicense"))
    n, far = len(mit), [f"f{k}" for k in range(3000)]
    cases = {
        1: [*mit[:60], *far, *mit[60:110], *far, *mit[110:]], 2: [*mit[:80], *far[:200], *isc, *far[:200], *mit[80:]], 3: [*mit[80:], *far, *mit[:80]], 4: [*mit[: n // 2], *far, "end"],
        5: [*mit[:80], *far[:100], *mit[80:], *far, *mit[:80], *far[:100], *mit[80:]], 6: [*(w for k in range(400) for w in (*license_scan.TEMPLATES["MIT"].split(), f"x{k}"))], 7: [*mit[:70], *far[:90], *unlicense, *mit[70:]],
    }
    rows = [(k, " ".join(v)) for k, v in cases.items()]
    got = defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["license"], r["matched"], r["first_word"], r["last_word"], r["pieces"]))
    assert got[1] == [("MIT-text", n, 0, n + 5999, 3)]
    assert sorted(got[2]) == [("ISC", len(isc), 280, 279 + len(isc), 1), ("MIT-text", n, 0, n + 399 + len(isc), 2)]
    assert got[3] == [] and got[4] == []  # out of order; half of it
    assert sorted(got[5]) == [("MIT-text", n, 0, n + 99, 2), ("MIT-text", n, n + 3100, 2 * n + 3199, 2)]
    assert len(got[6]) == 400
    assert sorted(x[0] for x in got[7]) == ["MIT-text", "Unlicense"]


def test_license_scan_names_whole_texts(spark):
    names = ["MIT-text", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-3.0-notice", "AGPL-3.0-notice", "LGPL-3.0-notice", "Unlicense"]
    ends = ["dealings in the software", "such damage", "such damage", "performance of this software", "licenses", "licenses", "licenses", "unlicense.org"]
    for k, e in zip(names, ends, strict=True):
        assert e in license_scan.TEMPLATES[k][-60:].lower()
    rows = [(i, "intro here " + license_scan.TEMPLATES[k] + " and an outro") for i, k in enumerate(names)]
    got = sorted((r["doc_id"], r["license"], r["coverage"], r["first_word"], r["last_word"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(i, k, 1.0, 2, 1 + len(license_scan.TEMPLATES[k].split())) for i, k in enumerate(names)]


def test_toxicity(spark, docs, empty):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        w = [r.choice(WORDS) + str(r.randrange(20)) for _ in range(60)]
        bad, low = i % 5 == 0, i % 4 == 0
        w[7:7] = [["nasty", "vileword", "vilethings"][i % 3]] * bad + ["junk!!"] * low
        rows.append((i, " ".join(w)))
        labels.append((i, int(not low), int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels[:800], (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    flags, names = toxicity.graded(lab)
    chain = toxicity.train(d, flags, names)
    limit = next(x for x in chain if x.name == "toxic")
    held = toxicity.score(d.where("doc_id >= 800"), chain).collect()
    wrong = sum((x["p_toxic"] >= limit.threshold) != (x["doc_id"] % 5 == 0) for x in held)
    assert len(held) == 400 and wrong <= 4 and len(chain[2].chain) == 2
    kept = toxicity.reject(docs, chain)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.score(empty, chain).count() == 0 and toxicity.reject(empty, chain).count() == 0
    none = toxicity.train(empty, flags.limit(0), names)
    assert toxicity.score(docs, none).count() == docs.count()
    clash = toxicity.score(docs.withColumn("p_toxic", F.lit("mine")), chain, carry=("doc_id", "p_toxic"))
    assert clash.columns == ["doc_id", "p_toxic", "p_low_quality", "_p_toxic", "p_toxic_low_quality"]


def test_chain_uses_out_of_fold_predictions():
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 1 << toxicity.BITS, 30)) for _ in range(300)]  # nothing to learn from
    y = {"a": (r.random(300) < 0.4).astype(float), "b": (r.random(300) < 0.4).astype(float)}
    _, held = toxicity.fit_chain(rows, y, np.arange(300) % 3)
    assert abs(np.corrcoef(held["a"], y["a"])[0, 1]) < 0.3  # predictions in the fold would follow the labels


def test_chain_uses_the_labels_that_are_there(spark):
    rows = [(i, "plain words here " + ("nasty " if i % 3 == 0 else "") + WORDS[i % 20]) for i in range(300)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string")
    lab = spark.createDataFrame([(i, None, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, *toxicity.graded(lab))
    got = toxicity.score(docs, chain).collect()
    limit = chain[1].threshold
    assert len(got) == 350 and all((r["p_toxic"] >= limit) == (r["doc_id"] % 3 == 0) for r in got)
    # brute force: each score from the model's own numbers
    memo, texts_ = toxicity.Features(), dict(rows)
    for r in got[::37]:
        f, odds = memo.of(texts_[r["doc_id"]]), []
        for link in chain:
            z = link.bias + sum(link.weights.get(x, 0.0) for x in f) + sum(c * o for c, o in zip(link.chain, odds, strict=True))
            p = 1 / (1 + np.exp(-z))
            assert r[f"p_{link.name}"] == pytest.approx(p)
            odds.append(np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4))))


def test_genetic_packing_beats_its_own_start():
    """Of groups that best fit packs into more bins than their sum needs, breeding packs some into fewer, and none into more."""
    better = 0
    for seed in range(20):
        r = random.Random(seed)
        lengths = [r.choice((501, 260, 250, 249, 241, 380, 120)) for _ in range(150)]
        isle = packing.Island(lengths, 1000, seed)
        folk = [isle.start(0.15 * j) for j in range(3)]
        best = min(map(len, folk))
        got = isle.evolve(folk, 60)[0]
        assert sorted(i for b in got for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 1000 for b in got)
        assert len(got) <= best
        better += len(got) < best
    assert better


def test_lm_scores(spark, docs, empty):
    r = random.Random(6)
    pairs = [("hot", "sun"), ("cold", "snow"), ("wet", "rain")]
    rows = [(i, " ".join(f"{a} the {b}" for a, b in (r.choice(pairs) for _ in range(40)))) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    model = lm_scoring.train(d, rounds=(2, 1))
    test = spark.createDataFrame([(1, "hot the sun cold the snow wet the rain " * 5), (2, "sun the cold rain the hot the snow wet " * 5), (3, None), (4, "")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in lm_scoring.score(test, model).collect()}
    assert got[1]["mean_log_likelihood"] > got[2]["mean_log_likelihood"] + 0.2 and got[3]["mean_log_likelihood"] is None and got[4]["pseudo_log_likelihood"] == 0
    assert lm_scoring.score(docs, model).count() == docs.count() and lm_scoring.score(empty, model).count() == 0
    assert lm_scoring.score(docs, lm_scoring.train(empty)).count() == docs.count()


def test_lm_masks_every_document():
    lengths = [3, 0, 1, 40, 16, 17, 2]
    for k in range(3):
        for every in (16, 6, 1):
            at, ends = lm_scoring.masked(lengths, every, k), np.cumsum(lengths)
            for i, n in enumerate(lengths):
                mine = at[(at >= ends[i] - n) & (at < ends[i])]
                assert len(mine) >= n // every and (len(mine) > 0) == (n > 0) and len(mine) <= n // every + 1


def test_lm_vocabulary_and_scores_are_brute_force(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(lm_scoring, "OTHERS", lm_scoring.WORDS - 50)
    r = random.Random(3)
    rows = [(i, " ".join(f"w{int(r.expovariate(0.02))}" for _ in range(60))) for i in range(80)] + [(80, None), (81, "")]
    rows.append((82, rows[7][1]))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = lm_scoring.vocabulary(d)
    c = Counter(w for _, t in rows for w in (t or "").encode().split())
    assert names == [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:50]]
    monkeypatch.undo()  # tasks have the module as it is
    net = lm_scoring.new_network(5)
    got = {x["doc_id"]: x for x in lm_scoring.score(d, (names, lm_scoring.flat(net))).collect()}
    vocab = lm_scoring.Vocabulary(names)
    for i in (0, 7, 33):
        ids, total = [vocab[w] for w in rows[i][1].encode().split()], 0.0
        for at, word in enumerate(ids):
            h = sum(net["vectors"][ids[at + s] if 0 <= at + s < len(ids) else lm_scoring.WORDS] * net["sides"][k] for k, s in enumerate(lm_scoring.SIDES))
            h = np.tanh(h)
            z = net["kind"] @ h + net["kind_bias"]
            c_, w_ = word % lm_scoring.CLASSES, word // lm_scoring.CLASSES
            y = net["inner"][c_] @ h + net["inner_bias"][c_]
            total += z[c_] - np.log(np.exp(z).sum()) + y[w_] - np.log(np.exp(y).sum())
        assert got[i]["pseudo_log_likelihood"] == pytest.approx(total, rel=1e-4)
    assert got[7]["pseudo_log_likelihood"] == pytest.approx(got[82]["pseudo_log_likelihood"]) and got[80]["pseudo_log_likelihood"] == 0 and got[81]["mean_log_likelihood"] is None


def test_lm_words_within_their_places(spark, monkeypatch):
    """Words without a name get their share of the place, by counts that are sent and counts that are joined."""
    from collections import Counter

    r = random.Random(8)
    rows = [(i, " ".join(f"w{int(r.expovariate(0.0002))}" for _ in range(60))) for i in range(300)] + [(300, None), (301, "w3 w3 neverseen"), (302, "")]
    rows += [(303, " ".join(f"once{k}" for k in range(30)))] + [(i, " ".join(f"twice{k}" for k in range(30))) for i in (304, 305, None)]
    d = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, word int").repartition(3)
    seen = d.where("doc_id is null or doc_id <> 301")
    monkeypatch.setattr(lm_scoring, "KNOWN", 100)
    names, rates = lm_scoring.rated(lm_scoring.word_counts(seen))
    monkeypatch.undo()
    assert len(names) == lm_scoring.WORDS - lm_scoring.OTHERS and len(rates.known) == 100
    c = Counter(w for i, t in rows if i != 301 for w in (t or "").encode().split())
    total = Counter()
    for w, n in c.items():
        if w not in set(names):
            total[lm_scoring.place(w)] += n
    state = lm_scoring.flat(lm_scoring.new_network(5))
    key = lambda i: -1 if i is None else i
    ranked = lambda f: sorted((key(x["doc_id"]), x["pseudo_log_likelihood"]) for x in f.collect())
    plain, full = ranked(lm_scoring.score(d, (names, state))), ranked(lm_scoring.score(d, (names, state, rates)))
    text = {key(i): t for i, t in rows}
    for (i, without), (same, score) in zip(plain, full, strict=True):
        words = [w for w in (text[i] or "").encode().split() if w not in set(names)]
        assert i == same and score - without == pytest.approx(sum(math.log(max(c[w], 1) / (total[lm_scoring.place(w)] + 1)) for w in words), abs=1e-6)
    got = {x["doc_id"]: x["mean_log_likelihood"] for x in lm_scoring.scored(seen).collect()}
    assert len(got) == seen.count() and got[300] is None and got[304] == pytest.approx(got[305]) and got[304] > got[303]


def test_lm_gradient():
    net = lm_scoring.new_network()
    r = np.random.default_rng(0)
    c, t = r.integers(0, lm_scoring.WORDS, (50, 4)), r.integers(0, lm_scoring.WORDS, 50)
    grad = {k: np.zeros(v.shape) for k, v in net.items()}
    lm_scoring.forward(net, c, t, grad)
    for name, at in (("vectors", (c[0, 0], 3)), ("sides", (1, 2)), ("kind", (t[0] % 64, 1)), ("inner", (t[0] % 64, t[0] // 64, 5)), ("kind_bias", (t[0] % 64,))):
        up, down = ({k: v.astype(np.float64) for k, v in net.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        slope = (lm_scoring.forward(up, c, t).sum() - lm_scoring.forward(down, c, t).sum()) / 2e-4
        assert slope == pytest.approx(grad[name][at], rel=2e-2, abs=1e-3)


def test_lm_places_and_large_logits(spark):
    """Spark finds a word's place as Python does; logits too large for a plain exponential give the probabilities of a softmax."""
    d = spark.createDataFrame([("a b üü zz",), ("a a x9",), (None,)], "text string")
    got = {bytes(x["word"]): (x["place"], x["count"]) for x in lm_scoring.word_counts(d).collect()}
    assert got == {w: (zlib.crc32(w) % lm_scoring.OTHERS, n) for w, n in {b"a": 3, b"b": 1, "üü".encode(): 1, b"zz": 1, b"x9": 1}.items()}
    assert all(p == lm_scoring.place(w) for w, (p, _) in got.items())
    r = np.random.default_rng(1)
    c, t = r.integers(0, lm_scoring.WORDS, (40, 4)), r.integers(0, lm_scoring.WORDS, 40)
    net = {k: v.astype(np.float64) for k, v in lm_scoring.new_network().items()}
    net["kind"] *= 50
    net["inner_bias"] += np.linspace(-500, 900, 64)[:, None] + np.linspace(0, 300, 64)
    h = np.tanh(sum(net["vectors"][c[:, s]] * net["sides"][s] for s in range(4)))
    kind, inner = t % 64, t // 64
    x, y = h @ net["kind"].T + net["kind_bias"], np.einsum("nk,nwk->nw", h, net["inner"][kind]) + net["inner_bias"][kind]
    log = lambda z, at: z[range(40), at] - z.max(1) - np.log(np.exp(z - z.max(1)[:, None]).sum(1))
    assert np.allclose(lm_scoring.forward(net, c, t), log(x, kind) + log(y, inner))
