"""Exact Jaccard join of word-shingle sets by universe partitioning.

Sizes fall into bands of ratio 1.3. For each band a scheme splits the hashed
universe of shingles into segments; its sets, and larger ones that may link with
them, are indexed under it. If two sets link, they differ in at most H shingles
(15/85 of the smaller one at 0.85). A segment that must be equal (tolerance 1) and
one that is indexed with its one-deletion neighbourhood (tolerance 2) each fail only
for that many differences, so with tolerances of H + 1 + slack one of them matches.
How many segments of either kind a scheme has is chosen by cost: entries written
plus candidates to be expected from nearly empty segments, by the documents of the
band. The slack allows for a subset of the segments: frequent contents (common
passages, empty segments) stay out of the index for every document that can spare
them, and stay in for the others, so no link is lost.

Candidates are made between sets that differ; equal sets are one node. Exact bounds look
at every pair before any set is moved: sizes, and parity sketches of about four bits a
shingle, whose differing bits cannot exceed the differing shingles. The nodes of an entry
of up to ``FREQUENT`` meet each other there. A longer entry is dealt into blocks, each of
which also holds a few nodes that all blocks of the entry see, and a block gives a forest
that spans what the bounds leave together, nearest first. Verification is exact on the
sets, and most of such a forest is true. The nodes of entries that still have several
components are indexed anew, by the shingles that are rarest among them: a set brings only
as many as must hold one that a link shares (a prefix filter), so what meets in a frequent
passage alone meets no more. There the nodes outside of an entry's largest component visit
its blocks; the nearest of each node and other component come first, until all pairs
between components that may link have been verified. So rows grow with the nodes, and
beyond that only with those that share a rarest shingle without being linked to most of its nodes.

Shingles, nodes and index keys are 64-bit hashes. Defined results: null or empty
texts have no shingles and link with nothing; texts of fewer than ``width`` words
are one shingle; equal ids share a component; a null id has a null component; other
columns are not read; an empty table gives an empty result; texts are whole.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_column, components, discard, measured_table, shared_folder, table

BLOCK = 256
RATIO, SCHEMES, SEGMENT_BITS = 1.3, 64, 17
#: Entries of more rows than this stay out of the index where the slack allows.
FREQUENT = 16
#: Nodes up to this number are sent to all tasks (8 bytes each); beyond, Spark joins by a shuffle.
FEW_NODES = 400_000
#: Members of a leader that meet in one task, and rows of an entry's block.
GROUP, ROWS = 256, 512
#: Nodes of an entry, about, that all its blocks see at first.
SEEN = 8
#: Places in which shingles are counted, to order them by how rare they are.
PLACES = 1 << 16
#: Places of the short sketch that a join condition looks at.
MINI = 512
#: Bytes of text that a shingle takes, about, for the number of documents in each band.
BYTES_EACH = 6.5


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_FACTORS = [np.uint64(f) for f in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def shingles(text: str | None, memo: Words, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles. A-Z are lower-cased; words divide at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    s = np.zeros(n, np.uint64)
    for i in range(width):
        s = _mix(s ^ h[i : i + n]) if i >= len(_FACTORS) else s + h[i : i + n] * _FACTORS[i]
    s = _mix(s)
    s.sort()
    return s[np.r_[True, s[1:] != s[:-1]]]


class Threshold:
    """Two sets link when den * |A and B| >= num * |A or B|."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low = [1]
        while len(low) < SCHEMES:
            low.append(max(low[-1] + 1, math.ceil(low[-1] * RATIO)))
        self.low = low

    def band(self, size: int) -> int:
        return bisect_right(self.low, size) - 1

    def top(self, band: int) -> int:
        return self.low[band + 1] - 1 if band + 1 < SCHEMES else 1 << 40

    def differences(self, band: int) -> int:
        return self.top(band) * (self.den - self.num) // self.num

    def schemes(self, size: int) -> list[int]:
        """Its own band's, and those of smaller sets that it may link with."""
        own = self.band(size)
        return [b for b in range(own, -1, -1) if b == own or size <= self.top(b) * self.den // self.num]

    def prefix(self, size: int) -> int:
        """How many of a set's shingles, in an order that all sets have, hold one at least that it shares with a set it links with."""
        return size + 1 - -(-size * self.num // self.den)

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)


def allocate(limit: Threshold, documents: dict[int, int]) -> list[tuple[int, int, int]]:
    """For each scheme (segments, how many of them with their one-deletion neighbourhood, slack), by cost."""
    out = []
    for band in range(SCHEMES):
        h, size = limit.differences(band), (limit.low[band] + min(limit.top(band), limit.low[band] * 2)) / 2
        slack = round(0.06 * (h + 1))
        if h + 1 + slack >= 1 << SEGMENT_BITS:
            slack = 0  # more segments than names: everything is indexed
        need, n, best = h + 1 + slack, documents.get(band, 0) + documents.get(band + 1, 0), None
        for double in {0, *(need // 2 * k // 8 for k in range(9)), need // 2}:
            m = need - double
            mean = size / m
            tiny = lambda t: sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(t + 1))
            entries = (m - double) + double * (1 + mean)
            cost = entries + 1e-3 * n * ((m - double) * tiny(0) + double * tiny(1))
            if best is None or cost < best[0]:
                best = (cost, m, double, slack)
        out.append(best[1:])
    return out


def entries(s: np.ndarray, scheme: int, m: int, double: int) -> np.ndarray:
    """The index keys of a set under a scheme: scheme, segment and content."""
    x = _mix(s, scheme + 1)
    segment = ((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(segment, kind="stable")
    segment, content = segment[order].astype(np.int64), _mix(x[order], 7)
    sums = np.zeros(m, np.uint64)
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    sums[segment[starts]] = np.add.reduceat(content, starts)
    name = np.arange(m, dtype=np.uint64)
    if double:
        inner = segment < double
        sums, name = np.concatenate([sums, sums[segment[inner]] - content[inner]]), np.concatenate([name, segment[inner].astype(np.uint64)])
    name = name & np.uint64((1 << SEGMENT_BITS) - 1)
    return ((np.uint64(scheme) << np.uint64(57)) | (name << np.uint64(40)) | (_mix(sums) >> np.uint64(24))).astype(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def sets(docs: DataFrame, limit: Threshold, width: int, plan: list[tuple[int, int, int]], id_col: str, text_col: str) -> DataFrame:
    """(id, n, node, sketch, mini, entries): a row for each document, in one scan without a shuffle. Equal sets of one task are indexed once, by a row with an id."""
    h = [limit.differences(b) for b in range(SCHEMES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = _WORDS, set()
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                part = b.slice(k, BLOCK)
                n, nodes, sketches, minis, keys = [], [], [], [], []
                for i, t in zip(part.column(0), part.column(1), strict=True):
                    s = shingles(t.as_py(), memo, width)
                    node, own = _node(s), []
                    if len(s) and i.is_valid and node not in seen:  # a row without an id links with nothing and stands for no other
                        if len(seen) < 1_000_000:
                            seen.add(node)
                        own = [entries(s, scheme, *plan[scheme][:2]) for scheme in limit.schemes(len(s)) if h[scheme]]  # else only equal sets link
                    n.append(len(s))
                    nodes.append(node)
                    sketches.append(sketch(s) if len(s) else None)
                    minis.append(np.frombuffer(parities(s, MINI), np.int64))
                    keys.append(np.concatenate([np.zeros(0, np.int64), *own]))
                ends = np.cumsum([0, *map(len, keys)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
                small = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (MINI // 64), pa.int32()), pa.array(np.concatenate(minis)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary()), small, lists], ["id", "n", "node", "sketch", "mini", "entries"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n long, node long, sketch binary, mini array<long>, entries array<long>")


#: The memo of this Python process, which tasks that follow each other share.
_WORDS = Words()


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's hashes over a power of two of places, four for each shingle at least."""
    places = max(512, 1 << (4 * len(s) - 1).bit_length())
    return parities(s, places)


def parities(s: np.ndarray, places: int) -> bytes:
    return np.packbits((np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Places in which two sketches differ, the longer one folded to the shorter: no more than the sets differ by."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def plan_of(docs: DataFrame, limit: Threshold, text_col: str) -> list[tuple[int, int, int]]:
    """The schemes' allocation by how many documents each band has, told by the texts' lengths."""
    size = F.greatest(F.octet_length(text_col) / BYTES_EACH, F.lit(1.0))
    band = F.least(F.greatest(F.floor(F.log(size) / math.log(RATIO)), F.lit(0)), F.lit(200)).cast("int")  # a bounded number of groups
    about: dict[int, int] = {}
    for r in docs.where(F.col(text_col).isNotNull()).groupBy(band.alias("g")).count().collect():
        b = limit.band(max(1, round(RATIO ** (r["g"] + 0.5))))
        about[b] = about.get(b, 0) + r["count"]
    return allocate(limit, about)


def _node(s: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None


def candidates(found: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """(entry, node, size) of entries with two nodes or more, frequent ones only for nodes that cannot spare them."""
    all_rows = found.where("id is not null").select(F.explode("entries").alias("entry"), "node")
    # stored, so that the files of its shuffle are gone before the next one
    shared = table(all_rows.groupBy("entry").agg(F.count("*").alias("rows")).where("rows > 1"), "shared")
    rows = table(all_rows.join(shared, "entry").distinct(), "entries")
    scheme, segment = F.shiftright("entry", 57).cast("int"), F.shiftright("entry", 40).bitwiseAND((1 << SEGMENT_BITS) - 1)
    schemes = F.array(*(F.struct(F.lit(d).alias("double"), F.lit(z).alias("slack")) for _, d, z in plan))
    lost = rows.where(F.col("rows") > FREQUENT).select("node", scheme.alias("scheme"), segment.alias("segment")).distinct()
    mine = F.element_at(schemes, F.col("scheme") + 1)
    spare = lost.groupBy("node", "scheme").agg(F.sum(F.when(F.col("segment") < mine["double"], 2).otherwise(1)).alias("lost")).where(F.col("lost") <= mine["slack"]).select("node", "scheme", F.lit(True).alias("spare"))
    often = rows.where(F.col("rows") > FREQUENT).withColumn("scheme", scheme).join(spare, ["node", "scheme"], "left_anti")
    kept = rows.where(F.col("rows") <= FREQUENT).select("entry", "node").union(often.select("entry", "node"))
    two = kept.groupBy("entry").agg(F.count("*").alias("size")).where("size > 1")
    out = table(kept.join(two, "entry"), "kept")
    discard(rows, shared)
    return out


def again(docs: DataFrame, wanted: DataFrame, small: bool, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles): the sets of the documents with the ``wanted`` ids (id), made from the texts again."""
    some = _texts(docs, id_col, text_col).join(F.broadcast(wanted) if small else wanted, "id", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WORDS
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                s = [shingles(t.as_py(), memo, width) for t in b.column(1).slice(k, BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())], ["node", "shingles"])

    return some.mapInArrow(make, "node long, shingles binary")


def verify(docs: DataFrame, place: DataFrame, pairs: DataFrame, limit: Threshold, width: int, id_col: str, text_col: str) -> DataFrame:
    """The linked ones of ``pairs`` (a, b), exactly. ``place``: (node, id) of one document for each node.

    Sets are made from the texts again and shuffled to the group of ``a``; a group of more than GROUP members is dealt over several
    tasks, each with a copy of the leader."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    members = pairs.join(sizes, "a").select("a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    leaders = sizes.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    work, facts = measured_table(leaders.unionByName(members), "pairs")
    small = facts["rows"] <= FEW_NODES
    wanted = work.select("node").distinct().join(place, "node").select("id")
    made = again(docs, wanted, small, width, id_col, text_col)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leader = None, None
        for b in batches:
            out_a, out_b = [], []
            for a, salt, role, node, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.frombuffer(blob, np.uint64)
                if role == 0:
                    group, leader = (a, salt), s
                elif group == (a, salt):
                    at = np.searchsorted(leader, s)
                    both = int(np.count_nonzero(leader[np.minimum(at, len(leader) - 1)] == s))
                    if limit.linked(both, len(leader), len(s)):
                        out_a.append(a)
                        out_b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    # a node's set may be wanted by several leaders, and documents with equal sets make it more than once
    joined = made.join(F.broadcast(work) if small else work, "node").select("a", "salt", "role", "node", "shingles")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = table(joined.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(compare, "a long, b long").distinct(), "verified")
    discard(work)
    return out


def near(pairs: DataFrame, facts: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs (a, b) that their sizes and sketches allow to link, with how far the sketches are apart. ``facts``: (node, n, sketch)."""
    f = lambda c: facts.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    d = pairs.join(f("a"), "a").join(f("b"), "b").where(small * limit.den >= large * limit.num).select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            d = np.array([apart(p, q) for p, q in zip(x, y, strict=True)], np.int64)
            # sizes and differences together give the largest intersection that is left
            total = np.array(n, np.int64) + np.array(m, np.int64)
            both = (total - d) // 2
            keep = pa.array(limit.den * both >= limit.num * (total - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], ["a", "b", "apart"]).filter(keep)

    return d.mapInArrow(run, "a long, b long, apart long")


def forest(i: np.ndarray, j: np.ndarray, far: np.ndarray, n: int) -> np.ndarray:
    """Places of edges (i, j) among ``n`` nodes that connect what all of them connect, short ones first."""
    order = np.lexsort((j, i, far))
    i, j, label, out = i[order], j[order], np.arange(n), []
    while True:
        a, b = label[i], label[j]
        left = np.flatnonzero(a != b)
        if not len(left):
            return order[np.unique(np.concatenate([np.zeros(0, np.int64), *out]))]
        best = np.full(n, len(i))
        np.minimum.at(best, a[left], left)
        np.minimum.at(best, b[left], left)
        took = np.unique(best[best < len(i)])
        out.append(took)
        # the edges are in one order, so what each label takes has no cycles
        while len(took):
            x, y = label[i[took]], label[j[took]]
            took = took[x != y]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != label[label]).any():
                label = label[label]


def met(limit: Threshold, n: np.ndarray, sketches: list[bytes], side: np.ndarray, both_sides: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, apart) of the pairs of a block, or of one from either side of two, that sizes and sketches allow to link."""
    out = [(np.zeros(0, np.int64),) * 3]
    lengths = np.array([len(x) for x in sketches])
    groups = [(w, np.flatnonzero(lengths == w)) for w in np.unique(lengths)]
    for w, p in groups:
        for v, q in groups:
            if v < w:
                continue
            x = np.frombuffer(b"".join(sketches[k] for k in p), np.uint64).reshape(len(p), -1)
            y = np.frombuffer(b"".join(sketches[k] for k in q), np.uint64).reshape(len(q), -1)
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            step = max(1, (1 << 20) // max(1, y.size))
            for at in range(0, len(p), step):
                i, part = p[at : at + step], x[at : at + step]
                d = np.bitwise_count(part[:, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
                total = n[i][:, None] + n[q][None, :]
                both = np.minimum((total - d) // 2, np.minimum(n[i][:, None], n[q][None, :]))
                ok = limit.den * both >= limit.num * (total - both)
                ok &= side[i][:, None] != side[q][None, :] if both_sides else True
                if v == w:
                    ok &= i[:, None] < q[None, :]
                a, b = np.nonzero(ok)
                out.append((i[a], q[b], d[a, b]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(i: np.ndarray, j: np.ndarray, far: np.ndarray, component: np.ndarray, deal: int) -> tuple[np.ndarray, bool]:
    """Places of the ``deal`` shortest edges of each node and other component, and whether these are not all."""
    cross = np.flatnonzero(component[i] != component[j])
    rank = np.full(len(cross), len(cross))
    for a, b in ((i[cross], j[cross]), (j[cross], i[cross])):
        order = np.lexsort((b, far[cross], component[b], a))
        key = np.stack([a[order], component[b[order]]])
        starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]) if len(order) else np.zeros(0, np.int64)
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        rank[order] = np.minimum(rank[order], place)
    return cross[rank < deal], bool((rank >= deal).any())


def dealt(rows: DataFrame) -> DataFrame:
    """(entry, block, guest, node, n, sketch, component). ``rows``: (entry, node, size, n, sketch, component, visits). A node is at home
    in one block of its entry; one that visits is a guest of all others."""
    out = rows.withColumn("blocks", F.ceil(F.col("size") / ROWS).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block"))
    columns = "node", "n", "sketch", "component"
    guests = out.where("visits and blocks > 1").select("entry", F.explode(others).alias("block"), F.lit(True).alias("guest"), *columns)
    return out.select("entry", "block", F.lit(False).alias("guest"), *columns).union(guests)


def blocks(rows: DataFrame, limit: Threshold, deal: int) -> DataFrame:
    """(a, b, more) from the blocks of ``dealt``, whose guests pass by ROWS at a time. Without ``deal``, a forest; with it, pairs between components."""
    most = ROWS

    def pairs(home: list[tuple], guests: list[tuple], first: bool) -> tuple[list[int], list[int], list[bool]]:
        _, _, side, node, n, sketches, component = zip(*home, *guests, strict=True)
        side, n, sketches = np.array(side), np.array(n, np.int64), list(sketches)
        i, j, far = met(limit, n, sketches, side, True)
        if first:
            own = met(limit, n[: len(home)], sketches[: len(home)], side[: len(home)], False)
            i, j, far = (np.concatenate(c) for c in zip((i, j, far), own, strict=True))
        node, component = np.array(node, np.int64), np.array(component, np.int64)
        at, more = nearest(i, j, far, component, deal) if deal else (forest(i, j, far, len(node)), False)
        a, b = np.maximum(node[i[at]], node[j[at]]), np.minimum(node[i[at]], node[j[at]])
        return a.tolist(), b.tolist(), [more] * len(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, guests, key, first = [], [], None, True
        out: tuple[list, list, list] = ([], [], [])

        def meet() -> None:
            nonlocal first
            if home and len(home) + len(guests) > 1 and (first or guests):
                for c, x in zip(out, pairs(home, guests, first), strict=True):
                    c.extend(x)
            first = False
            guests.clear()

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], ["a", "b", "more"])
            for c in out:
                c.clear()
            return made

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:2] != key or len(guests) >= most:
                    meet()
                    if len(out[0]) > 10_000:
                        yield told()
                if r[:2] != key:
                    home.clear()
                    key, first = r[:2], True
                (guests if r[2] else home).append(r)
        meet()
        yield told()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt(rows).repartition(parts, "entry", "block").sortWithinPartitions("entry", "block", "guest").mapInArrow(run, "a long, b long, more boolean")


def _sum_blocks(f: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"block": f["block"][:1], "counts": [np.sum([np.frombuffer(x, np.int64) for x in f["counts"]], axis=0).tobytes()]})


def rarest(found: DataFrame, limit: Threshold) -> DataFrame:
    """(entry, node, size): shingles that two sets or more may share, each set's rarest ones, so many that sets that link share one.

    ``found``: (node, shingles). All sets order the shingles alike, by how many of them are counted in a place, then by hash."""
    step = PLACES // 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(PLACES, np.int64)
        for b in batches:
            s = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)
            n += np.bincount((s & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES)
        if n.any():
            cuts = range(0, PLACES, step)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(cuts), pa.int32()), pa.array([n[a : a + step].tobytes() for a in cuts], pa.binary())], ["block", "part", "counts"])

    shape = "block int, counts binary"
    made = found.select("shingles").mapInArrow(count, "block int, part int, counts binary")
    some = made.groupBy("block", F.floor(F.col("part") / 64).alias("g")).applyInPandas(lambda key, f: _sum_blocks(f), shape)
    got = sorted(some.groupBy("block").applyInPandas(_sum_blocks, shape).collect(), key=lambda r: r["block"])  # 16 rows
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in got]) if got else np.zeros(PLACES, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for node, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.frombuffer(blob, np.uint64)
                often = counts[(s & np.uint64(PLACES - 1)).astype(np.int64)]
                at = np.lexsort((s, often))[: limit.prefix(len(s))]
                keys.append(s[at[often[at] > 1]])  # what is alone in its place is in no other set
                nodes.append(np.full(len(keys[-1]), node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(nodes))], ["entry", "node"])

    rows = table(found.select("node", "shingles").mapInArrow(run, "entry long, node long"), "rarest")
    out = table(rows.join(rows.groupBy("entry").agg(F.count("*").alias("size")).where("size > 1"), "entry"), "shared")
    discard(rows)
    return out


def links(docs: DataFrame, found: DataFrame, limit: Threshold, plan: list[tuple[int, int, int]], width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(src, dst) between nodes: enough verified links to connect every component of the exact link graph.

    ``found`` is the table that ``sets`` gives."""
    kept = candidates(found, plan)
    place = found.where("n > 0 and id is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("mini").alias("mini"))
    place = table(place.join(kept.select("node").distinct(), "node", "left_semi"), "places")
    facts, args = place.select("node", "n", "sketch"), (limit, width, id_col, text_col)

    # short entries: at most FREQUENT nodes, each pair told once
    few = kept.where(F.col("size") <= FREQUENT).join(place.select("node", "n", "mini"), "node").select("entry", "node", "n", "mini")
    x, y = few.alias("x"), few.alias("y")
    d = sum((F.bit_count(F.get("x.mini", F.lit(i)).bitwiseXOR(F.get("y.mini", F.lit(i)))) for i in range(MINI // 64)), F.lit(0))
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    may = (small * limit.den >= large * limit.num) & (d * (limit.den + limit.num) <= (small + large) * (limit.den - limit.num))
    close = x.join(y, (F.col("x.entry") == F.col("y.entry")) & (F.col("x.node") > F.col("y.node")) & may).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    close = near(close, facts, limit).select("a", "b")

    # long entries: a forest first. Sketches are joined last, to what meets
    long_rows, size = measured_table(kept.where(F.col("size") > FREQUENT).select("entry", "node", "size"), "long")
    everywhere = F.pmod(F.xxhash64("node", F.lit(1)), F.col("size")) < SEEN
    grown = blocks(long_rows.withColumn("component", F.col("node")).withColumn("visits", everywhere).join(facts, "node"), limit, 0).select("a", "b")
    tried = table(close.union(grown).distinct() if size["rows"] else close, "tried")
    one = verify(docs, place, tried, *args)

    def named() -> DataFrame:
        found = components(place.select(F.col("node").alias("id")), one.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        out = table(found.select(F.col("id").alias("node"), "component"), "names")
        discard(found.links)
        return out

    def several(rows: DataFrame) -> DataFrame:
        """The rows of entries with several components, with these; those outside of the entry's largest one visit."""
        here = rows.join(names, "node")
        each = here.groupBy("entry", "component").agg(F.count("*").alias("rows"))
        each = each.groupBy("entry").agg(F.max_by("component", F.struct("rows", "component")).alias("top"), F.count("*").alias("components"))
        return here.join(each.where("components > 1").select("entry", "top"), "entry").withColumn("visits", F.col("component") != F.col("top"))

    rows, deal = None, 4
    if size["rows"]:
        # then the nodes of what has several components, by their rarest shingles
        names = named()
        wanted, left = measured_table(several(long_rows).select("node").distinct().join(place.select("node", "id"), "node").select("id"), "wanted")
        if left["rows"]:
            # a node that comes twice, with an id that does, is one component and meets no more
            found = table(again(docs, wanted, left["rows"] <= FEW_NODES, width, id_col, text_col), "open")
            rows = rarest(found, limit)
            discard(found)
        discard(wanted)
    while rows is not None:
        met_here = several(rows).select("entry", "node", "size", "component", "visits").join(facts, "node")
        between, seen = measured_table(blocks(met_here, limit, deal).groupBy("a", "b").agg(F.max("more").alias("more")), "between", more=F.max("more"))
        new, left = measured_table(between.select("a", "b").join(tried, ["a", "b"], "left_anti"), "new")
        discard(between)
        if left["rows"]:
            true = verify(docs, place, new, *args)
            one, tried = one.union(true), tried.union(new)
        if not seen["more"]:
            discard(rows)
            break
        discard(names)
        names, deal = named(), deal * 4
    if size["rows"]:
        discard(names)
    discard(kept, place, long_rows)
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def classes(docs: DataFrame, num: int = 85, den: int = 100, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), a row for each document."""
    limit = Threshold(num, den)
    shared_folder(docs.sparkSession)
    plan = plan_of(docs, limit, text_col)
    found = table(sets(docs, limit, width, plan, id_col, text_col), "sets")
    nodes = found.where("n > 0").groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    e = links(docs.where(F.col(id_col).isNotNull()), found, limit, plan, width, id_col, text_col)
    named = components(nodes.select(F.col("node").alias("id")), e).withColumnRenamed("id", "node")
    classed = table(nodes.join(named, "node"), "classes")
    lowest = classed.groupBy("component").agg(F.min("low").alias("component_id"))
    moved = classed.join(lowest, "component").where("copies > 1 or low <> component_id").select("node", "component_id")
    out = found.select("id", "n", "node").join(moved, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def representatives(docs: DataFrame, num: int = 85, den: int = 100, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their own columns: one of each component, that with the smallest id (rows without an id last).

    Rows are told by a key of their own, so that repeated rows and copies without an id go, and rows of one id with texts that do
    not link are apart. Of rows without words one stays for each id, and all that have no id."""
    shared_folder(docs.sparkSession)
    row = as_column(docs.columns, "_row")
    keyed = table(docs.withColumn(row, F.monotonically_increasing_id()), "rows", compression="zstd")
    out = classes(keyed, num, den, width, row, text_col).join(keyed.select(row, id_col), row)
    out = table(out.select(F.col(row).alias("r"), F.col(id_col).alias("id"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("c")), "classed")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "r")
    best = out.where("c is not null").groupBy("c").agg(F.min(order)["r"].alias("keep"), F.count("*").alias("rows")).where("rows > 1").select("c", "keep")
    first = out.where("c is null and id is not null").groupBy("id").agg(F.min("r").alias("keep"), F.count("*").alias("rows")).where("rows > 1").select("id", "keep")
    gone = out.where("c is not null").join(best, "c").where("r <> keep").select("r").union(out.where("c is null").join(first, "id").where("r <> keep").select("r"))
    gone, size = measured_table(gone.withColumnRenamed("r", row), "gone")
    return keyed.join(F.broadcast(gone) if size["rows"] <= FEW_NODES else gone, row, "left_anti").drop(row)
