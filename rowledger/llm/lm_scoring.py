"""Masked pseudo-likelihood of documents under a bidirectional window network.

Counts of all words of all documents give the vocabulary: the most frequent words by
name, all others by a hash into a fixed number of places. The network sees the words
on both sides of a masked one: their vectors, each scaled for its place in the window,
are summed and squashed, and predict the masked word in two steps, its class and the
word within the class. It is trained in numpy, data-parallel: each task runs steps of
AdaGrad over the masked positions of its documents from the current network, and the
networks are averaged by Spark, weighted by positions, once for each round. By default one round
masks every position of every document; the network depends on how the documents are dealt to tasks.

A document's score is the sum over its words of the log-probability of each given the
others in the window: every position is predicted once. For a word without a name the
network gives the probability of its place, and the corpus counts that of the word within the
place: its count, or 1 if it never occurs, over the place's total plus 1. The counts of the
``KNOWN`` most frequent of these words go to all tasks; those of all others are joined by Spark.
So what is gathered grows with the input; what reaches the driver is the vocabulary, the
places' totals and one network, all of fixed size.

Texts are read twice, to count and to number words; training and scoring read the stored numbers.

Defined results: null or empty texts have no words, score 0 and a mean of null; texts
of any length are taken whole; ids may be null or repeat; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_folder, table

CLASSES = 64
WORDS = CLASSES * CLASSES
#: Places for words that have no name of their own.
OTHERS = 512
#: Words beyond those with a name whose counts are sent to all tasks.
KNOWN = 1 << 16
SIDES, SIZE = (-2, -1, 1, 2), 16
CHUNK = 1 << 15
#: Rows of logits that are in work at once.
ROWS = 1 << 11


class Rates(NamedTuple):
    """What the corpus says of words within their places."""

    totals: np.ndarray  # logarithm of each place's total plus 1
    known: list[tuple[bytes, int]]  # (word, count) of the most frequent
    rest: DataFrame  # (word, log_count) of the others that occur twice or more


def place(word: bytes) -> int:
    """The hashed place of a word, which Spark finds alike."""
    return zlib.crc32(word) % OTHERS


class Vocabulary(dict):
    """word -> its number: frequent words spread over the classes, others by hash into the last places; ``known`` ones among these
    have numbers of their own from WORDS on."""

    def __init__(self, names: list[bytes], known: list[bytes] = ()):
        super().__init__((w, i) for i, w in enumerate(names[: WORDS - OTHERS]))
        self.update((w, WORDS + i) for i, w in enumerate(known))
        self.fixed = dict(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
            self.update(self.fixed)
        i = self[word] = WORDS - OTHERS + place(word)  # fixed ones are never missing
        return i


_LAST: dict[int, Vocabulary] = {}


def numbering(names: list[bytes], known: list[bytes] = ()) -> Vocabulary:
    """The vocabulary's memo of this Python process, which tasks that follow each other share."""
    key = xxhash.xxh3_64_intdigest(b"\n".join([*names, b"", *known]))
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Vocabulary(names, known)
    return _LAST[key]


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, place, count, bin) over all documents, stored; combined in each task before the shuffle. bin: eight an octave of the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(words(t.as_py()))
            if len(seen) > 300_000:
                yield from out(seen)
                seen.clear()
        yield from out(seen)

    def out(seen: Counter[bytes]) -> Iterator[pa.RecordBatch]:
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "count"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))
    place = (F.crc32("word") % OTHERS).cast("int").alias("place")
    return table(counts.select("word", place, "count", F.floor(F.log2("count") * 8).cast("int").alias("bin")), "words")


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words and their counts. A histogram of the counts shows from which bin on words can be among them; only those are sorted."""
    low = total = 0
    for r in counts.groupBy("bin").agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect():  # at most 8 * 63 rows
        total, low = total + r["n"], r["bin"]
        if total >= most:
            break
    # few words are that frequent, so few tasks hold them
    top = counts.where(F.col("bin") >= low).repartition(4).orderBy(F.desc("count"), "word").limit(most).collect()
    return [(bytes(r["word"]), r["count"]) for r in top]


def vocabulary(docs: DataFrame, text_col: str = "text") -> list[bytes]:
    """The words with a name, the most frequent ones."""
    counts = word_counts(docs, text_col)
    top = frequent(counts, WORDS - OTHERS)
    discard(counts)
    return [w for w, _ in top]


def rated(counts: DataFrame) -> tuple[list[bytes], Rates]:
    """The words with a name, and what the counts say of all others."""
    top = frequent(counts, WORDS - OTHERS + KNOWN)
    names, known = top[: WORDS - OTHERS], top[WORDS - OTHERS :]
    totals = np.zeros(OTHERS)
    for r in counts.groupBy("place").agg(F.sum("count").alias("n")).collect():  # a row for each place
        totals[r["place"]] = r["n"]
    for w, n in names:
        totals[place(w)] -= n
    least = known[-1][1] if known else 0
    rest = counts.where((F.col("count") >= 2) & (F.col("count") <= least)).select("word", F.log("count").alias("log_count"))
    return [w for w, _ in names], Rates(np.log(totals + 1), known, rest)


def new_network(seed: int = 1) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    return {
        "vectors": r.normal(0, 0.3, (WORDS + 1, SIZE)).astype(np.float32), "sides": np.ones((len(SIDES), SIZE), np.float32) + r.normal(0, 0.1, (len(SIDES), SIZE)).astype(np.float32),
        "kind": r.normal(0, 0.1, (CLASSES, SIZE)).astype(np.float32), "kind_bias": np.zeros(CLASSES, np.float32),
        "inner": r.normal(0, 0.1, (CLASSES, CLASSES, SIZE)).astype(np.float32), "inner_bias": np.zeros((CLASSES, CLASSES), np.float32),
    }


def flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in sorted(net)])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    net, at = new_network(), 0
    for k in sorted(net):
        net[k] = x[at : at + net[k].size].reshape(net[k].shape).astype(np.float32)
        at += net[k].size
    return net


def _joined(net: dict[str, np.ndarray], name: str) -> tuple[np.ndarray, np.ndarray]:
    """Weights with their bias as a last column, and whether logits may be too large for a plain exponential: no h is beyond 1."""
    weights = np.concatenate([net[name], net[name + "_bias"][..., None]], -1)
    return weights, np.abs(weights).sum(-1).max(-1) > 60


def _sums(words: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sums of the rows of each word, turned; ``columns``: the rows, turned."""
    words = np.ascontiguousarray(words)
    return np.array([np.bincount(words, weights=c, minlength=WORDS + 1) for c in columns])


def forward(net: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Log-probabilities of the targets (n) given context (n, sides); with ``grad``, adds the gradients of their sum to it."""
    if not len(target):
        return np.zeros(0)
    # by class, so that the words of a class are one product
    kind, inner = (target % CLASSES).astype(np.uint8), target // CLASSES
    order = np.argsort(kind, kind="stable")
    context, kind, inner = context[order], kind[order], inner[order]
    h = np.ones((len(target), SIZE + 1), net["vectors"].dtype)  # the last column is for the bias
    np.tanh(sum((net["vectors"] * net["sides"][s]).take(context[:, s], 0) for s in range(len(SIDES))), out=h[:, :SIZE])
    log, back = np.zeros(len(h), h.dtype), np.zeros((len(h), SIZE), h.dtype)
    rows, ones = np.arange(ROWS), np.ones(CLASSES, h.dtype)

    def layer(at: slice, weights: np.ndarray, large: bool, column: np.ndarray, slopes: tuple[np.ndarray, np.ndarray] | None) -> None:
        """Adds the log-probability of one column in each row of the logits of ``h``, and, if asked for, the slopes."""
        x, column = h[at], column[at]
        z, row = x @ weights.T, rows[: len(column)]
        if large:
            z -= z.max(1, keepdims=True)
        one = z[row, column]
        np.exp(z, out=z)
        total = z @ ones
        log[at] += one - np.log(total)
        if slopes is not None:
            # the logits' slopes are these over -total, by which the narrow factors are divided
            z[row, column] -= total
            scale = (-1 / total)[:, None]
            g = z.T @ (x * scale)
            slopes[0][...] += g[:, :-1]
            slopes[1][...] += g[:, -1]
            back[at] += (z @ weights[:, :-1]) * scale

    weights, large = _joined(net, "kind")
    for a in range(0, len(h), ROWS):
        layer(slice(a, a + ROWS), weights, large, kind, grad and (grad["kind"], grad["kind_bias"]))
    weights, large = _joined(net, "inner")
    cuts = np.searchsorted(kind, np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(cuts)):
        for a in range(cuts[c], cuts[c + 1], ROWS):
            layer(slice(a, min(a + ROWS, cuts[c + 1])), weights[c], large[c], inner, grad and (grad["inner"][c], grad["inner_bias"][c]))
    if grad is not None:
        h = h[:, :SIZE]
        columns = np.ascontiguousarray((back * (1 - h * h)).T, np.float64)
        vectors, total = np.ascontiguousarray(net["vectors"].T), np.zeros((SIZE, WORDS + 1))
        for s in range(len(SIDES)):
            g = _sums(context[:, s], columns)
            grad["sides"][s] += np.einsum("ij,ij->i", g, vectors)
            g *= net["sides"][s][:, None]
            total += g
        grad["vectors"] += total.T
    out = np.empty(len(log), log.dtype)
    out[order] = log
    return out


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(context, target) of every position; beyond a text's ends stands the number WORDS."""
    edge = np.full(max(map(abs, SIDES)), WORDS, np.int64)
    ids = np.concatenate([edge, *(x for t in texts for x in (t, edge))])
    at = np.flatnonzero(ids != WORDS)
    return np.stack([ids[at + s] for s in SIDES], 1), ids[at]


def masked(lengths: list[int], every: int, k: int) -> np.ndarray:
    """Positions of a block's documents that round ``k`` masks: one in ``every`` of each document, one at least."""
    n = np.array(lengths, np.int64)
    n = n[n > 0]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.flatnonzero((place - np.repeat(k % np.minimum(n, every), n)) % every == 0)


def numbered(docs: DataFrame, names: list[bytes], rates: Rates | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, uid, ids, within, others), stored: the network's numbers of a text's words, 16 bits each; the log-probabilities within
    their places of its words that are known, and for the others what their places' totals make of them, summed; and these others, whose counts are to be joined."""
    known, joined = rates.known if rates else [], rates is not None
    totals = rates.totals if rates else np.zeros(OTHERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = numbering(names, [w for w, _ in known])
        at = np.array([place(w) for w, _ in known], np.int64)
        number = np.concatenate([np.arange(WORDS), WORDS - OTHERS + at]).astype("<i2")
        within = np.concatenate([np.zeros(WORDS - OTHERS), -totals, np.log([float(n) for _, n in known]) - totals[at]])
        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            ids, sums, ends, rare, times = [], [], [0], [], []
            for t in b.column(1):
                w = words(t.as_py())
                x = np.fromiter(map(vocab.__getitem__, w), np.int64, len(w))
                ids.append(number[x].tobytes())
                sums.append(float(within[x].sum()))
                if joined:
                    seen = Counter([w[i] for i in np.flatnonzero((x >= WORDS - OTHERS) & (x < WORDS))])
                    rare += seen.keys()
                    times += seen.values()
                ends.append(len(rare))
            others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["word", "n"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(range(uid, uid + len(ids)), pa.int64()), pa.array(ids, pa.binary()), pa.array(sums), others], ["id", "uid", "ids", "within", "others"])
            uid += len(ids)

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, uid long, ids binary, within double, others array<struct<word:binary,n:bigint>>")
    return table(made, "numbered")


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Blocks of documents with about CHUNK words each."""
    for b in batches:
        start, held, n = 0, [], 0
        for i, x in enumerate(b.column(column)):
            held.append(np.frombuffer(x.as_py(), "<i2").astype(np.int64))
            n += len(held[-1])
            if n >= CHUNK:
                yield b.slice(start, i + 1 - start), held
                start, held, n = i + 1, [], 0
        if held:
            yield b.slice(start), held


def fit(texts: DataFrame, rounds: tuple[int, ...] = (1,), rate: float = 0.1) -> np.ndarray:
    """The network, from numbered texts. Each round masks one position in as many of every document, one at least, and averages
    the tasks' networks; a round of 1 trains on every position."""
    state, block = flat(new_network()), 1 << 12

    for k, every in enumerate(rounds):

        def run(batches: Iterator[pa.RecordBatch], state=state, every=every, k=k) -> Iterator[pa.RecordBatch]:
            net, size, done = unflat(state), len(state), 0
            power = {n: np.full(v.shape, 1e-3, np.float32) for n, v in net.items()}
            for _, texts in _blocks(batches, 0):
                context, target = windows(texts)
                for part in np.array_split(masked([len(t) for t in texts], every, k), 4):
                    if not len(part):
                        continue
                    grad = {n: np.zeros(v.shape, np.float64) for n, v in net.items()}
                    forward(net, context[part], target[part], grad)
                    for n, g in grad.items():
                        g = (g / len(part)).astype(np.float32)
                        power[n] += g * g
                        net[n] += rate * g / np.sqrt(power[n])
                done += len(target)
            if done:
                x = flat(net)
                cuts = range(0, size, block)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(cuts), pa.int32()), pa.array([float(done)] * len(cuts)), pa.array([(x[a : a + block] * done).astype(np.float64).tobytes() for a in cuts], pa.binary())], ["block", "part", "weight", "sums"])

        def add(f: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(x) for x in f["sums"]], axis=0)
            return pd.DataFrame({"block": f["block"][:1], "weight": [f["weight"].sum()], "sums": [total.tobytes()]})

        shape = "block int, weight double, sums binary"
        made = texts.select("ids").mapInArrow(run, "block int, part int, weight double, sums binary")
        # a tree of sums of up to 64 at a time: three levels are enough for 262,144 tasks
        first = made.groupBy("block", F.floor(F.col("part") / 64).alias("g")).applyInPandas(lambda key, f: add(f).assign(part=int(key[1])), shape + ", part int")
        second = first.groupBy("block", F.floor(F.col("part") / 64).alias("g")).applyInPandas(lambda key, f: add(f), shape)
        got = sorted(second.groupBy("block").applyInPandas(add, shape).collect(), key=lambda r: r["block"])
        if got:
            state = np.concatenate([np.frombuffer(r["sums"]) / r["weight"] for r in got]).astype(np.float32)
    return state


def train(docs: DataFrame, rounds: tuple[int, ...] = (1,), rate: float = 0.1, text_col: str = "text") -> tuple[list[bytes], np.ndarray, Rates]:
    """(words with a name, network, rates of all other words) of a corpus."""
    names, rates = rated(word_counts(docs, text_col))
    texts = numbered(docs, names, None, text_col, text_col)
    state = fit(texts, rounds, rate)
    discard(texts)
    return names, state, rates


def score_numbered(texts: DataFrame, state: np.ndarray, rates: Rates | None = None, id_col: str = "doc_id") -> DataFrame:
    """The scores of numbered texts: one scan of the numbers, and a join of the words that few documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = unflat(state)
        for b, held in _blocks(batches, 2):
            context, target = windows(held)
            log = np.concatenate([np.zeros(0), *(forward(net, context[a : a + CHUNK], target[a : a + CHUNK]) for a in range(0, len(target), CHUNK))])
            n = np.array([len(t) for t in held])
            sums = np.bincount(np.repeat(np.arange(len(n)), n), weights=log, minlength=len(n)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(n, pa.int64()), pa.array(sums + b.column(3).to_numpy())], ["id", "uid", "n_words", "total"])

    kind = texts.schema["id"].dataType.simpleString()
    out = texts.select("id", "uid", "ids", "within").mapInArrow(run, f"id {kind}, uid long, n_words long, total double")
    rest = F.lit(0.0)
    if rates:
        rare = texts.select("uid", F.inline("others")).join(rates.rest, "word").groupBy("uid").agg(F.sum(F.col("n") * F.col("log_count")).alias("rest"))
        out, rest = out.join(rare, "uid", "left"), F.coalesce("rest", F.lit(0.0))
    out = out.select(F.col("id").alias(id_col), "n_words", (F.col("total") + rest).alias("pseudo_log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("pseudo_log_likelihood") / F.col("n_words")))


def score(docs: DataFrame, model: tuple[list[bytes], np.ndarray] | tuple[list[bytes], np.ndarray, Rates], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, pseudo_log_likelihood, mean_log_likelihood) of any documents. Without rates, a word without a name has the probability of its place."""
    names, state, *rates = model
    rates = rates[0] if rates else None
    return score_numbered(numbered(docs, names, rates, id_col, text_col), state, rates, id_col)


def scored(docs: DataFrame, rounds: tuple[int, ...] = (1,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of the documents under a model of themselves, whose words are numbered once for both."""
    shared_folder(docs.sparkSession)
    names, rates = rated(word_counts(docs, text_col))
    texts = numbered(docs, names, rates, id_col, text_col)
    return score_numbered(texts, fit(texts, rounds), rates, id_col)
