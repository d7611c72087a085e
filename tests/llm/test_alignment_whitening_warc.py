"""Token alignment, whitening and archives against the libraries, numpy and exact round trips."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowledger.llm import common, token_alignment, warc, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts(n, seed=3):
    r = random.Random(seed)
    signs = ["a", "the", "Straße", " ", "  ", "\n", "\n\n", "\t", "▁", "é", "é", "日本", "<|endoftext|>", "<s>", "'s", "17", "_", "　", "\xa0", "\x1c", "\x00", "ﬁ", "🙂", "don't", "\r\n", "    "]
    return ["".join(r.choice(signs) for _ in range(r.randint(1, 30))) for _ in range(n)]


def both(text):
    """Ids and ends of either library, whole texts; none where the bytes are not given back."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(both, "a"):
        both.a, both.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        both.a.encode_special_tokens = True
        letters = {c: i for i, c in enumerate(common.byte_letters())}
        both.bytes = {}
        for i in range(both.a.get_vocab_size()):
            name = both.a.id_to_token(i)
            both.bytes["a", i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        for i in range(both.b.get_piece_size()):
            p = both.b.id_to_piece(i)
            both.bytes["b", i] = bytes([int(p[3:5], 16)]) if both.b.is_byte(i) else p.replace("▁", " ").encode()
    if not text:
        return [], []
    found = {"a": both.a.encode(" " + text, add_special_tokens=False).ids, "b": both.b.encode(text)}
    out = []
    for k, ids in found.items():
        parts = [both.bytes[k, i] for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return [], []
        out.append(list(zip(ids, np.cumsum([len(p) for p in parts]).tolist(), strict=True)))
    return out


def plain_alignment(rows):
    """doc_id, text -> the contract's columns, by sets of ends."""
    links, out = {}, {}
    for i, text in rows:
        a, b = both(text)
        common_ends = sorted({e for _, e in a} & {e for _, e in b})
        at = {e: k for k, e in enumerate(common_ends)}
        groups = [([], []) for _ in common_ends]
        for side, tokens in enumerate((a, b)):
            for x, e in tokens:
                groups[at[next(c for c in common_ends if c >= e)] if common_ends else 0][side].append(x)
        links[i] = [(next(x for x, f in a if f == e), next(x for x, f in b if f == e)) for e in common_ends]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out[i] = [len(a), len(b), len(groups), len(links[i]), text]
    n = collections.Counter(p for x in links.values() for p in x)
    best = collections.defaultdict(int)
    for p, c in n.items():
        best[p[1]] = max(best[p[1]], c)
    return {i: (*v[:4], sum(n[p] == best[p[1]] for p in links[i]), sum(n[p] for p in links[i]), v[4]) for i, v in out.items()}


@pytest.mark.parametrize("few", [1_000_000, 40, 0])
def test_alignment_is_brute_force(spark, few, monkeypatch):
    monkeypatch.setattr(token_alignment, "LANE", 16)
    words = " ".join(texts(120, 5))
    rows = [*enumerate(texts(300)), (300, None), (301, ""), (302, "one text twice"), (303, "one text twice"), (304, words), (305, " "), (306, "x" * 5000)]
    d = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, pair int, id string")
    got = token_alignment.with_counts(token_alignment.align(d, A, B), few)
    assert {r["id"]: tuple(r)[1:] for r in got.collect()} == plain_alignment(rows)


def test_alignment_digests_repeated_null_ids_and_empty(spark):
    rows = [(None, "a b"), (None, "a b"), (1, "a b"), (1, None)]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(tuple(r) for r in token_alignment.with_counts(token_alignment.align(d, A, B, groups="sha256")).select("n_a", "n_links", "count_sum", "groups").collect())
    text = plain_alignment([(1, "a b")])[1][6]
    assert got == [(0, 0, 0, "")] + [(2, 2, 6, hashlib.sha256(text.encode()).hexdigest())] * 3
    assert token_alignment.with_counts(token_alignment.align(d.limit(0), A, B)).collect() == []


def test_merge_in_lanes(monkeypatch):
    r = np.random.default_rng(1)
    monkeypatch.setattr(token_alignment, "LANE", 7)
    starts, ends, a, b = [], [], [], []
    at = 0
    for size in (1, 3, 50, 400, 7, 14):
        starts.append(at)
        for out in (a, b):
            out += sorted({at + size, *(at + 1 + r.choice(size, max(1, size // 3))).tolist()})
        at += size
        ends.append(at)
    a, b = np.array(a), np.array(b)
    x, y = token_alignment.merge(a, b, np.array(starts), np.array(ends))
    assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def vectors(n, d, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, d))
    return (centres[r.integers(0, 5, n)] * 0.7 + r.normal(size=(n, d)) * np.linspace(1, 0.2, d)).tolist()


def whole_numbers(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


@pytest.mark.parametrize(("n", "d", "k"), [(400, 64, 16), (300, 20, 16), (9, 40, 16), (500, 3, 16), (600, 100, 4)])
def test_whitening_is_the_eigenbasis(spark, n, d, k):
    rows = [(i, v) for i, v in enumerate(vectors(n, d))]
    rows += [(n + i, rows[0][1]) for i in range(50)] + [(None, rows[1][1])]
    bad = [(-1, None), (-2, [math.nan] * d), (-3, [math.inf, *[0.0] * (d - 1)]), (-4, [None, *[0.0] * (d - 1)]), (-5, [0.0]), (-6, []), (-7, [1e300, *[0.0] * (d - 1)])]
    e = spark.createDataFrame([(*x, "x", 0) for x in rows + bad], "vec_id long, embedding array<double>, x string, id int").repartition(5)
    got = whitening.whitened(e, k).collect()
    x = np.array([whole_numbers(v) for _, v in rows])
    fit = np.unique(x, axis=0)
    m, s = len(fit), fit.sum(0)
    y = (fit * m - s) / m
    values, u = np.linalg.eigh(y.T @ y / m)
    values, u = values[::-1][:k], u[:, ::-1][:, :k]
    values, u = values[values > 1e-10 * values[0]], u[:, : (values > 1e-10 * values[0]).sum()]
    assert len(got) == len(rows) * len(values)
    want = {}
    for (i, _), row in zip(rows, x, strict=True):
        want[i] = (int(((m * row - s) ** 2).sum()), ((row * m - s) / m) @ u / np.sqrt(values))
    by_component = collections.defaultdict(list)
    for r in got:
        assert (r["n"], r["deviation"]) == (m, want[r["vec_id"]][0])
        assert r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], values[r["component"] - 1] / (y**2).sum() * m, rel_tol=1e-9)
        by_component[r["component"]].append((r["whitened"], want[r["vec_id"]][1][r["component"] - 1]))
    assert sorted(by_component) == list(range(1, len(values) + 1))
    for pairs in by_component.values():
        a, b = np.array(pairs).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def test_whitening_of_little(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened(empty).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whitened(same).collect() == []  # one distinct vector does not vary
    large = spark.createDataFrame([(1, [2.0**40, 2.0**40]), (2, [0.0, 0.0]), (3, [0.0, 2.0**40])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whitened(large).collect()} == {None}  # exact, but beyond 64 bits


def test_degenerate_spectrum():
    """Equal eigenvalues at both sides of the last component, and none that is missed."""
    v = np.diag([9.0, 5.0, 5.0, 5.0, *[1.0] * 60])
    values, q, left = whitening.eigenpairs(lambda x: v @ x, 64, 3)
    assert np.allclose(values, [9, 5, 5]) and np.allclose(q.T @ q, np.eye(3)) and left.max() < 1e-11


def page(i, html):
    return i, f"http://h/{i}", html


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_round_trip(spark, tmp_path, compression):
    r = random.Random(2)
    long = "".join(r.choice("abé\r\n\0") for _ in range(5000))
    rows = [page(i, "".join(r.choice(["<p>", "é", "\r\n\r\n", "WARC/1.1\r\n", "🙂", "0\r\n\r\n"]) for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows += [page(70, long), page(71, long), page(69, long), page(80, None), page(81, ""), page(None, long), page(82, rows[3][2]), page(82, rows[3][2]), (90, None, "x"), (91, "a\r\nb", "y"), page(None, "only without an id")]
    d = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, row int").repartition(3)
    path = str(tmp_path / "w")
    warc.write(d, path, segment_bytes=300, chunk_bytes=70, compression=compression)
    found = warc.payloads(warc.read(spark, path))
    texts = {(x["id"], x["payload"].decode()) for x in found.where("type = 'response'").collect()}
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        first[data] = min([first.get(data, math.inf), math.inf if i is None else i])
    assert {t for _, t in texts} == {k.decode() for k in first} and len(texts) == len(first)
    got = sorted((str(x["id"]), x["payload_bytes"], x["digest"], str(x["refers_to_id"])) for x in warc.resolved(found).collect() if x["type"] == "revisit")
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        of = first[data]
        if of != i and not (i is None and of == math.inf):
            want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), str(of)))
    want.append(("82", len(rows[3][2].encode()), base64.b32encode(hashlib.sha1(rows[3][2].encode()).digest()).decode(), str(first[rows[3][2].encode()]))) if first[rows[3][2].encode()] == 82 else None
    assert got == sorted(want)
    assert {x["status"] for x in warc.resolved(found).collect()} == {"ok"}
    # what is below the least size is always a response
    warc.write(d, str(tmp_path / "v"), least_bytes=6000)
    alone = warc.payloads(warc.read(spark, str(tmp_path / "v")))
    assert alone.where("type = 'revisit'").count() == sum(len((h or "").encode()) >= 6000 for *_, h in rows) - len({h for *_, h in rows if len((h or "").encode()) >= 6000})
    empty = str(tmp_path / "e")
    warc.write(d.limit(0), empty)
    assert warc.resolved(warc.payloads(warc.read(spark, empty))).collect() == []


def test_segments_in_any_file_and_what_is_broken(spark, tmp_path):
    body = bytes(range(256)) * 9
    records = list(warc.records_of(1, "p 1", "u", body, warc.base32_sha1(body), None, 200, 90))
    assert len(records) > 9

    def kept(name, files):
        (tmp_path / name).mkdir()
        for k, parts in enumerate(files):
            data = b"".join(x + b"\r\n\r\n" for x in parts)
            (tmp_path / name / f"{k}.warc").write_bytes(gzip.compress(data) if k % 2 else data)
        return {x["record_id"]: x for x in warc.payloads(warc.read(spark, str(tmp_path / name))).collect()}

    origin = "<urn:rowledger:record:1>"
    shuffled = random.Random(4).sample(records, len(records))
    good = kept("a", [shuffled[:4], shuffled[4:], shuffled[:2]])[origin]  # two of them twice
    assert (good["status"], good["id"], good["payload"]) == ("ok", "p 1", body)
    assert kept("b", [records[:3] + records[4:]])[origin]["status"] == "missing segment"
    assert kept("c", [records[:-1]])[origin]["status"] == "missing segment"
    assert kept("d", [records[1:]])[origin]["status"] == "missing segment"
    other = list(warc.records_of(1, "p 1", "u", body[::-1], warc.base32_sha1(body), None, 200, 90))
    assert kept("e", [records, other[2:3]])[origin]["status"] == "conflicting segments"
    assert kept("f", [[records[0], *other[1:]]])[origin]["status"] == "wrong digest"
    assert kept("g", [[*records[:-1], records[-1].replace(b"Total-Length: ", b"Total-Length: 1")]])[origin]["status"] == "wrong length"
    (tmp_path / "h").mkdir()
    (tmp_path / "h/x.warc").write_bytes(records[0] + b"\r\n\r\n" + b"WARC/1.1\r\nContent-Length: 999\r\n\r\nshort")
    assert [r["type"] for r in warc.read(spark, str(tmp_path / "h")).orderBy("offset").collect()] == ["response", "broken"]
    lone = list(warc.records_of(2, None, None, b"", warc.base32_sha1(b""), 5, 200, 90))
    assert {x["status"] for x in [r.asDict() for r in warc.resolved(warc.payloads(_read(spark, tmp_path, lone))).collect()]} == {"missing response"}


def _read(spark, tmp_path, records):
    (tmp_path / "lone").mkdir()
    (tmp_path / "lone/x.warc").write_bytes(b"".join(x + b"\r\n\r\n" for x in records))
    return warc.read(spark, str(tmp_path / "lone"))


@pytest.mark.parametrize("body", [b"3\r\nabc\r\n0\r\n\r\n", b"3;x=y\r\nabc\r\n000\r\nA: b\r\n\r\n", b"1\r\na\r\n2 \r\nbc\r\n0\r\n\r\n"])
def test_chunks(body):
    assert warc.unchunked(body) == b"abc"


@pytest.mark.parametrize("body", [b"", b"abc", b"3\r\nabc\r\n", b"4\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n0\r\n\r\nmore", b"-3\r\nabc\r\n0\r\n\r\n"])
def test_broken_chunks(body):
    assert warc.unchunked(body) is None


def test_base32(spark):
    rows = [(bytearray(f"{i}".encode()),) for i in range(200)]
    got = spark.createDataFrame(rows, "b binary").select("b", warc.base32_of_hex(F.sha1("b")).alias("d")).collect()
    assert all(r["d"] == warc.base32_sha1(bytes(r["b"])) for r in got)
