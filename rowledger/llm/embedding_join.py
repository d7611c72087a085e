"""Exact threshold pairs of embeddings by dual traversal of cover trees.

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c). For
each label a cover tree of nested levels with halving radii is laid out from a
bounded sample of vectors; then every vector descends to a leaf, and the largest
distance found in each leaf gives the leaves, and through their parents all nodes,
covering radii that hold for all vectors. The pair of roots is traversed: a pair of
nodes too far apart for their radii is dropped, others are split down to pairs of
leaves. Leaves are stored in blocks of bounded size; each task takes pairs of blocks,
grows the trees' lower levels over them and traverses these in the same way. Pairs of
nodes that lie within the threshold with all their vectors count as linked without a
look at each; pairs of small nodes are compared in double precision.

A task returns for each vector how many it links with and one linked vector, enough
to connect what the pair of blocks connects; pairs are never listed. Equal vectors of
a label are one vector with a count.

Defined results: vectors that are null, zero or hold null or non-finite components,
and those of null labels, link with nothing; vectors of unequal length do not link;
rows of equal ids share a component; a null id has a null component; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, shared_folder, table

#: Vectors that lay out the upper tree: a bound for all labels together.
SAMPLE = 4096
#: Vectors of a block, and of a node that is compared as it is.
BLOCK, LEAF = 2048, 48
#: Doubt of a distance in double precision: bounds are widened by it.
DOUBT = 1e-7


class Node:
    """A node of a cover tree over rows of ``x``: a centre, a covering radius, its rows and children."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, centre: np.ndarray, radius: float, level: float, least: int):
        self.rows, self.centre, self.radius, self.children = rows, centre, radius, []
        if len(rows) <= least or level < 2**-6 or radius == 0:
            return
        # the next level: centres more than half the radius apart cover all rows within it
        half = level / 2
        left = np.arange(len(rows))
        own = x[rows]
        while len(left):
            c = own[left[0]]
            d = distance(own[left], c)
            near = d <= half
            self.children.append(Node(x, rows[left[near]], c, float(d[near].max()), half, least))
            left = left[~near]
        if len(self.children) > max(2, len(rows) // 2):  # nothing lies close together here
            self.children = []


def distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(1))


def tree(x: np.ndarray, least: int = LEAF) -> Node:
    rows = np.arange(len(x))
    d = distance(x, x[0])
    return Node(x, rows, x[0], float(d.max()), 2.0, least)


def traverse(a: Node, b: Node, reach: float, same: bool, all_in, compare) -> None:
    """Dual traversal. ``same``: both are one tree, so a pair of nodes is met in one order only."""
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        d = 0.0 if p is q and same else float(np.sqrt(((p.centre - q.centre) ** 2).sum()))
        if d - p.radius - q.radius > reach + DOUBT:
            continue
        if (2 * p.radius if p is q and same else d + p.radius + q.radius) <= reach - DOUBT:
            all_in(p, q)
        elif not p.children and not q.children:
            compare(p, q)
        elif p is q and same:
            todo += [(c, e) for i, c in enumerate(p.children) for e in p.children[i:]]
        elif p.children and (not q.children or p.radius >= q.radius):
            todo += [(c, q) for c in p.children]
        else:
            todo += [(p, c) for c in q.children]


def block_links(xa: np.ndarray, wa: np.ndarray, xb: np.ndarray, wb: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For two blocks (or one with itself): the weighted links of each row, those of a before those of b, and for each row
    the lowest row that it is connected with here."""
    n, reach = len(xa), math.sqrt(2 - 2 * cosine)
    total = n if same else n + len(xb)
    links, parent = np.zeros(total, np.int64), np.arange(total)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)

    at = 0 if same else n

    def all_in(p: Node, q: Node) -> None:
        if p is q and same:
            links[p.rows] += wa[p.rows].sum() - wa[p.rows]
        else:
            links[p.rows] += wb[q.rows].sum()
            links[q.rows + at] += wa[p.rows].sum()
        for i in p.rows:
            join(i, q.rows[0] + at)
        for j in q.rows:
            join(p.rows[0], j + at)

    def compare(p: Node, q: Node) -> None:
        hit = xa[p.rows] @ xb[q.rows].T >= cosine
        if p is q and same:
            np.fill_diagonal(hit, False)
            links[p.rows] += hit @ wa[p.rows]
        else:
            links[p.rows] += hit @ wb[q.rows]
            links[q.rows + at] += hit.T @ wa[p.rows]
        for i, j in zip(*np.nonzero(hit), strict=True):
            join(p.rows[i], q.rows[j] + at)

    a = tree(xa)
    traverse(a, a if same else tree(xb), reach, same, all_in, compare)
    return links, np.array([root(i) for i in range(total)]), np.arange(total)


def unit(vectors: list[np.ndarray | None]) -> list[np.ndarray | None]:
    out = []
    for v in vectors:
        x = None if v is None or len(v) == 0 else np.array([np.nan if c is None else c for c in v], np.float64)
        scale = 0.0 if x is None or not np.isfinite(x).all() else float(np.abs(x).max())
        out.append(x / scale / np.sqrt(((x / scale) ** 2).sum()) if scale > 0 else None)
    return out


class Layout:
    """The upper trees: for each label a flat list of nodes (parent, centre), leaves last reached by descent."""

    def __init__(self, sample: dict[int, np.ndarray]):
        self.trees: dict[int, list[tuple[int, np.ndarray, list[int]]]] = {}
        for label, x in sample.items():
            flat: list[tuple[int, np.ndarray, list[int]]] = []

            def add(node: Node, parent: int, flat=flat) -> int:
                k = len(flat)
                flat.append((parent, node.centre, []))
                flat[k][2].extend([add(c, k) for c in node.children])
                return k

            add(tree(x, 32), -1)
            self.trees[label] = flat

    def leaf(self, label: int, v: np.ndarray) -> tuple[int, float]:
        flat = self.trees.get(label)
        if not flat or len(flat[0][1]) != len(v):
            return -1, 2.0
        k = 0
        while flat[k][2]:
            kids = flat[k][2]
            k = kids[int(np.argmin([((flat[c][1] - v) ** 2).sum() for c in kids]))]
        return k, float(np.sqrt(((flat[k][1] - v) ** 2).sum()))

    def pairs(self, label: int, radius: dict[int, float], reach: float) -> list[tuple[int, int]]:
        """Pairs of leaves that hold vectors and may hold links. The vectors that no tree takes (leaf -1) are a leaf near everything."""
        flat = self.trees.get(label, [])
        full = sorted(k for k in radius if k >= 0)
        cover, held = [0.0] * len(flat), [False] * len(flat)
        for k in range(len(flat) - 1, -1, -1):
            if k in radius:
                cover[k], held[k] = radius[k], True
            for c in flat[k][2]:
                if held[c]:
                    held[k] = True
                    cover[k] = max(cover[k], float(np.sqrt(((flat[k][1] - flat[c][1]) ** 2).sum())) + cover[c])
        out, todo = [], [(0, 0)] if full else []
        while todo:
            p, q = todo.pop()
            if not held[p] or not held[q]:
                continue
            d = float(np.sqrt(((flat[p][1] - flat[q][1]) ** 2).sum()))
            if d - cover[p] - cover[q] > reach + DOUBT:
                continue
            a, b = flat[p][2], flat[q][2]
            if p == q and a:
                todo += [(c, e) for i, c in enumerate(a) for e in a[i:]]
            elif not a and not b:
                out.append((min(p, q), max(p, q)))
            elif a and (not b or cover[p] >= cover[q]):
                todo += [(c, q) for c in a]
            else:
                todo += [(p, c) for c in b]
        return out + [(-1, k) for k in radius if -1 in radius]


def linked(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each vector."""
    spark = vectors.sparkSession
    shared_folder(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = unit(b.column(1).to_pylist())
            ok = [u is not None and lab is not None for u, lab in zip(units, b.column(2).to_pylist(), strict=True)]
            blobs = [u.tobytes() if o else None for u, o in zip(units, ok, strict=True)]
            keys = [xxhash.xxh3_64_intdigest(x) - (1 << 63) if x else None for x in blobs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v if o else None for v, o in zip(b.column(2).to_pylist(), ok, strict=True)], pa.int64()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["id", "label", "node", "unit"])

    rows = table(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("long").alias("label")).mapInArrow(prepare, f"id {kind}, label long, node long, unit binary"), "units")
    nodes = table(rows.where("unit is not null").groupBy("label", "node").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("unit").alias("unit")), "nodes")

    # a bounded sample, dealt by a hash, lays out the upper trees
    n = nodes.count()
    picked = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))).select("label", "node", "unit").collect()
    by: dict[int, list[np.ndarray]] = {}
    for r in sorted(picked, key=lambda r: (r["label"], r["node"])):
        v = np.frombuffer(r["unit"])
        if not by.setdefault(r["label"], []) or len(by[r["label"]][0]) == len(v):
            by[r["label"]].append(v)
    layout = Layout({k: np.array(v) for k, v in by.items()})

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [layout.leaf(lab, np.frombuffer(u)) for lab, u in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k for k, _ in at], pa.int32()), pa.array([d for _, d in at], pa.float64())], [*b.schema.names, "leaf", "far"])

    # leaves of vectors of different lengths stay apart by their length
    placed = table(nodes.select("label", "node", "copies", "unit").mapInArrow(descend, "label long, node long, copies long, unit binary, leaf int, far double").withColumn("dims", F.length("unit")), "leaves")
    leaves = table(placed.groupBy("label", "dims", "leaf").agg(F.max("far").alias("far"), F.ceil(F.count("*") / BLOCK).alias("salts")), "radii")
    reach = math.sqrt(2 - 2 * cosine)

    def pair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                found = layout.pairs(r.label, {int(x["leaf"]): float(x["far"]) for x in r.leaves}, reach)
                yield pd.DataFrame({"label": r.label, "dims": r.dims, "p": [p for p, _ in found], "q": [q for _, q in found]})

    # at most as many leaves as the sample has vectors
    grouped = leaves.groupBy("label", "dims").agg(F.collect_list(F.struct("leaf", "far")).alias("leaves"))
    pairs = grouped.mapInPandas(pair, "label long, dims int, p int, q int")
    side = leaves.select("label", "dims", "leaf", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt"))
    jobs = pairs.join(side.select("label", "dims", F.col("leaf").alias("p"), F.col("salt").alias("s")), ["label", "dims", "p"]).join(side.select("label", "dims", F.col("leaf").alias("q"), F.col("salt").alias("t")), ["label", "dims", "q"]).where("p <> q or s <= t")

    def block(t: pa.Table) -> pa.Table:
        return pa.table({"label": t["label"][:1], "dims": t["dims"][:1], "leaf": t["leaf"][:1], "salt": t["salt"][:1], "nodes": pa.array([np.array(t["node"]).astype("<i8").tobytes()], pa.binary()), "weights": pa.array([np.array(t["copies"]).astype("<i8").tobytes()], pa.binary()), "units": pa.array([b"".join(t["unit"].to_pylist())], pa.binary())})

    salted = placed.join(leaves.select("label", "dims", "leaf", "salts"), ["label", "dims", "leaf"]).select("label", "dims", "leaf", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), "node", "copies", "unit")
    blocks = table(salted.groupBy("label", "dims", "leaf", "salt").applyInArrow(block, "label long, dims int, leaf int, salt int, nodes binary, weights binary, units binary"), "blocks")
    one = blocks.select("label", "dims", F.col("leaf").alias("p"), F.col("salt").alias("s"), *(F.col(c).alias(f"{c}_a") for c in ("nodes", "weights", "units")))
    two = blocks.select("label", "dims", F.col("leaf").alias("q"), F.col("salt").alias("t"), *(F.col(c).alias(f"{c}_b") for c in ("nodes", "weights", "units")))
    work = jobs.repartition(parts, "label", "p", "s", "q", "t").join(one, ["label", "dims", "p", "s"]).join(two, ["label", "dims", "q", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                same = (r["p"], r["s"]) == (r["q"], r["t"])
                na, nb = np.frombuffer(r["nodes_a"], "<i8"), np.frombuffer(r["nodes_b"], "<i8")
                wa, wb = np.frombuffer(r["weights_a"], "<i8"), np.frombuffer(r["weights_b"], "<i8")
                xa, xb = np.frombuffer(r["units_a"]).reshape(len(na), -1), np.frombuffer(r["units_b"]).reshape(len(nb), -1)
                links, root, _ = block_links(xa, wa, xa if same else xb, wa if same else wb, cosine, same)
                names = na if same else np.concatenate([na, nb])
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["label"]), pa.int64()), pa.array(names[at]), pa.array(links[at]), pa.array(names[root[at]])], ["label", "node", "links", "other"])

    found = table(work.select("label", "p", "s", "q", "t", *(f"{c}_{k}" for k in "ab" for c in ("nodes", "weights", "units"))).mapInArrow(run, "label long, node long, links long, other long"), "found")
    counts = found.groupBy("label", "node").agg(F.sum("links").alias("links"))
    # nodes of two labels are two nodes: name them by both
    name = lambda c: F.xxhash64("label", c)
    named = components(nodes.select(name("node").alias("id")), found.where("node <> other").select(name("node").alias("src"), name("other").alias("dst")))
    classed = table(nodes.join(counts, ["label", "node"], "left").select("label", "node", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), name("node").alias("id")).join(named, "id"), "classes")
    lowest = classed.groupBy("component").agg(F.min("low").alias("component_id"))
    facts = classed.join(lowest, "component").select("label", "node", "n_links", "component_id")
    out = rows.select("id", "label", "node").join(facts, ["label", "node"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(False)).alias("kept"))
