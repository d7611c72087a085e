"""Best-fit packing of documents into sequences of a fixed number of tokens, by a
grouping genetic algorithm on islands.

A document's ids and its end id form one piece, or, if longer than a sequence,
full pieces behind a first one that may be shorter. Full pieces are sequences of
their own. All others are dealt by a hash into groups of about ``group_size``
pieces. Each group lives on several islands, which start from differently
disturbed best-fit-decreasing solutions and breed: a child takes well-filled bins
of one parent whole into the other, bins that then hold a piece twice are
dissolved, and what lost its place is best-fitted, longest first. Between epochs
every island sends its best solution to the next one; at the end each group keeps
its best. A group's size is bounded by the dealing, a task holds one group, and
what is carried between the epochs are lists of bin numbers.

Defined results: a null text counts as empty and is its end id alone; repeated
rows are packed as often as they occur; ids may be null; other columns are not
read; an empty table gives an empty result; any text length.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteBpe, memo, table
from .token_files import pack_ids

BLOCK = 256
#: Words, and pieces, that a process keeps the ids of; more of them save time and take memory.
KNOWN = 400_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep: int = KNOWN) -> DataFrame:
    """(uid, id, piece, start, length, ids_crc32). One scan of two columns; uid is unique within one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, uid = memo(ByteBpe, tokenizer, pack_ids, b"", keep), pack_ids([end_id]), TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(k, BLOCK)
                out = []
                for at, t in enumerate(rows.column(1).to_pylist()):
                    ids = b"".join(known.values(t or "")) + end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        out.append((at, uid, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                        uid += 1
                at, *cols = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["id", "uid", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, uid long, piece int, start long, length long, ids_crc32 long")


class Island:
    """Solutions of one group: each a list of bins, a bin a list of places in ``lengths``."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.random = lengths, capacity, random.Random(seed)

    def fit(self, items: list[int], bins: list[list[int]], room: list[int]) -> None:
        """Best fit: each item, in the order given, goes to the fullest bin that has room for it."""
        free, lengths = sorted((r, b) for b, r in enumerate(room) if r), self.lengths
        for i in items:
            n = lengths[i]
            k = bisect_left(free, (n, -1))
            if k == len(free):
                bins.append([i])
                room.append(self.capacity - n)
                b = len(bins) - 1
            else:
                _, b = free.pop(k)
                bins[b].append(i)
                room[b] -= n
            if room[b]:
                insort(free, (room[b], b))

    def start(self, disturb: float) -> list[list[int]]:
        noise = [n * (1 + disturb * self.random.random()) for n in self.lengths]
        bins: list[list[int]] = []
        self.fit(sorted(range(len(noise)), key=lambda i: (-noise[i], i)), bins, [])
        return bins

    def value(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewest bins first, then uneven filling, which leaves room for later pieces."""
        return -len(bins), sum((self.filled(b) / self.capacity) ** 2 for b in bins) / max(1, len(bins))

    def filled(self, items: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, items))

    def cross(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        fill = [self.filled(x) for x in b]
        order = sorted(range(len(b)), key=lambda k: -fill[k])
        good = order[: max(1, len(order) // 2)]
        taken = [b[k] for k in self.random.sample(good, max(1, len(good) // 4))]
        inside = {i for x in taken for i in x}
        kept, out = [], []
        for x in a:
            if inside.isdisjoint(x):
                kept.append(x)
            else:
                out += [i for i in x if i not in inside]
        # the emptiest bins are dissolved with them, or a child would never need fewer bins
        kept.sort(key=self.filled)
        loose = max(1, len(kept) // 20)
        out += [i for x in kept[:loose] for i in x]
        bins = [list(x) for x in kept[loose:]] + [list(x) for x in taken]
        self.fit(sorted(out, key=lambda i: (-self.lengths[i], i)), bins, [self.capacity - self.filled(x) for x in bins])
        return bins

    def evolve(self, people: list[list[list[int]]], generations: int) -> list[list[list[int]]]:
        # each solution is valued once
        valued = sorted(((self.value(x), x) for x in people), key=itemgetter(0), reverse=True)
        least = -(-sum(self.lengths) // self.capacity)
        for _ in range(generations):
            if not valued or len(valued[0][1]) <= least:  # no solution can have fewer
                break
            (_, a), (_, b) = self.random.sample(valued, 2) if len(valued) > 1 else valued * 2
            child = self.cross(a, b)
            valued = sorted([*valued, (self.value(child), child)], key=itemgetter(0), reverse=True)[: len(valued)]
        return [x for _, x in valued]


def pack(items: DataFrame, capacity: int = 1024, group_size: int = 2000, islands: int = 3, epochs: int = 2, generations: int = 8, people: int = 3) -> DataFrame:
    """Items (uid unique, length below or at capacity) -> (uid, sequence, offset); a sequence is named by its smallest uid.

    Islands of a group are rows of their own, so groups and islands run side by side; a lost executor repeats its groups with the same seeds."""
    n = items.count()
    groups = max(1, math.ceil(n / group_size))
    spread = items.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("grp"))
    # bounded: the dealing gives each group about group_size items, whatever their keys
    g = spread.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("items"))
    state = g.select("grp", F.col("items.uid").alias("uids"), F.col("items.length").alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(None).cast("array<array<int>>").alias("genomes"), F.lit(None).cast("array<int>").alias("guest"))
    state = state.repartition("grp", "island")

    def epoch(k: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for r in f.itertuples(index=False):
                    isle = Island([int(x) for x in r.lengths], capacity, hash((int(r.grp), int(r.island), k)) & 0xFFFFFFFF)
                    genomes = [] if r.genomes is None else [*r.genomes, *([] if r.guest is None else [r.guest])]
                    folk = [_bins(x) for x in genomes] or [isle.start(0.15 * j + 0.05 * int(r.island) * (j > 0)) for j in range(people)]
                    folk = isle.evolve(folk, generations)[:people]
                    yield pd.DataFrame({"grp": [r.grp], "island": [r.island], "uids": [r.uids], "lengths": [r.lengths], "genomes": [[_genome(b, len(r.lengths)) for b in folk]], "bins": [len(folk[0])], "filled": [isle.value(folk[0])[1]]})

        return run

    shape = "grp long, island int, uids array<long>, lengths array<long>, genomes array<array<int>>, bins int, filled double"
    for k in range(epochs):
        done = state.mapInPandas(epoch(k), shape)
        if k + 1 == epochs:  # read once, by what follows
            break
        done = table(done, "islands")
        guests = done.select("grp", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("genomes")[0].alias("guest"))
        state = done.drop("bins", "filled").join(guests, ["grp", "island"])
    best = done.groupBy("grp").agg(F.min_by(F.struct("uids", "lengths", F.col("genomes")[0].alias("genome")), F.struct("bins", -F.col("filled"), "island")).alias("b")).select("b.*")

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                uid, n, g = np.asarray(r.uids), np.asarray(r.lengths), np.asarray(r.genome)
                order = np.lexsort((uid, g))
                uid, n, g = uid[order], n[order], g[order]
                first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])[np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1]
                before = np.cumsum(n) - n
                yield pd.DataFrame({"uid": uid, "sequence": uid[first], "offset": before - before[first]})

    return best.mapInPandas(places, "uid long, sequence long, offset long")


def _bins(genome) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(genome):
        bins.setdefault(int(b), []).append(i)
    return list(bins.values())


def _genome(bins: list[list[int]], n: int) -> list[int]:
    g = [0] * n
    for b, items in enumerate(bins):
        for i in items:
            g[i] = b
    return g


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep: int = KNOWN, **options) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    p = table(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, keep), "pieces")
    full = p.where(F.col("length") == capacity).select("*", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = p.where(F.col("length") < capacity)
    placed = part.join(pack(part, capacity, **options), "uid").withColumnRenamed("sequence", "sequence_id")
    return full.unionByName(placed).drop("uid").withColumnRenamed("id", id_col)
