"""Toxicity by a chain of linear classifiers.

The categories are 0/1 columns of a label table, predicted one after the other. A
category's logistic model sees the text's features and the log-odds of the earlier
categories; in training those come from models that had not seen the document (out
of fold), so a later model does not trust them more than it can when it is used.

Features are the distinct lower-cased words of the whole text and their beginnings
of 4 to 7 letters, hashed; of these, each category keeps the ones most associated
with it (likelihood ratio), so that long documents do not add up noise. The model is
fitted on the driver from at most ``max_rows`` labelled documents, chosen by a hash
of the id; everything else covers all rows. Scoring is one scan without a shuffle.

Defined results: a null text counts as empty and gets the score of a text without
features; null ids and repeated rows come back one for one; a label that is null is
not used, the others of its row are; equal ids in the labels count once, of several texts with a labelled id one is learnt from, and with no labels of both kinds a
category's score is its rate; empty tables give empty results; columns of the
documents are carried only if asked for, and score columns never replace one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_column

BITS = 20
_SPACES = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


class Features(dict):
    """word -> hashed features: the word and its beginnings; with ``known``, the places of those in it."""

    def __init__(self, known: dict[int, int] | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        w = word.decode("utf-8", "ignore")
        forms = [b"=" + word, *(b"^" + w[:n].encode() for n in range(4, 8) if len(w) >= n)]
        ids = [xxhash.xxh3_64_intdigest(f) & ((1 << BITS) - 1) for f in forms]
        v = self[word] = tuple(ids if self.known is None else [self.known[i] for i in ids if i in self.known])
        return v

    def of(self, text: str | None) -> list[int]:
        words = set((text or "").lower().encode("utf-8", "ignore").translate(_SPACES).split())
        return sorted({f for fs in filter(None, map(self.__getitem__, words)) for f in fs})


@dataclass
class Link:
    """One category's linear model."""

    name: str
    bias: float
    threshold: float = 0.5
    weights: dict[int, float] = field(default_factory=dict)
    chain: list[float] = field(default_factory=list)


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def counted(rows: list[np.ndarray]) -> np.ndarray:
    """In how many of the rows each feature is; some rows at a time."""
    n = np.zeros(1 << BITS, np.int64)
    for k in range(0, len(rows), 256):
        n += np.bincount(np.concatenate(rows[k : k + 256]), minlength=1 << BITS)
    return n


def select(rows: list[np.ndarray], y: np.ndarray, most: int, least_rows: int) -> np.ndarray:
    """Features by likelihood ratio with the category, among those in enough documents."""
    if not len(rows):
        return np.zeros(0, np.int64)
    n, one = len(y), int(y.sum())
    all_, in_ = counted(rows), counted([r for r, v in zip(rows, y, strict=True) if v])
    at = np.flatnonzero(all_ >= least_rows)
    a, b = in_[at].astype(float), (all_ - in_)[at].astype(float)
    cells = [(a, one), (b, n - one), (one - a, one), (n - one - b, n - one)]
    share = [(a + b) / n, (a + b) / n, 1 - (a + b) / n, 1 - (a + b) / n]
    g = sum(2 * c * np.log(np.maximum(c, 1e-9) / np.maximum(t * s, 1e-9)) for (c, t), s in zip(cells, share, strict=True))
    keep = at[np.argsort(-g, kind="stable")[:most]]
    return keep[np.isin(keep, at[g > 10.8])]  # the 0.1 % point of the ratio's distribution


def fit_linear(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, most: int, least_rows: int, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(features, their weights, weights of the dense columns, bias) by gradient steps scaled for each column."""
    at = select(rows, y, most, least_rows)
    place = np.full(1 << BITS, -1, np.int64)
    place[at] = np.arange(len(at))
    cols = [place[r] for r in rows]
    cols = [c[c >= 0] for c in cols]
    doc, col = np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate([np.zeros(0, np.int64), *cols])
    n = len(at)
    w, v, rate = np.zeros(n), np.zeros(dense.shape[1]), float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = float(_odds(np.array([rate]))[0])
    # the scale of a column: how much the loss can bend along it, with what a row's columns share
    row = np.bincount(doc, minlength=len(y)) + (dense**2).sum(1) + 1
    bend = ridge + 0.25 * np.bincount(col, weights=row[doc], minlength=n) * 0.3
    bend_v, bend_b = ridge + 0.25 * (dense**2 * row[:, None]).sum(0), 0.25 * row.sum()
    last = [np.zeros(n), np.zeros(dense.shape[1]), 0.0]
    for k in range(steps):
        pull = k / (k + 3)
        aw, av, ab = w + pull * (w - last[0]), v + pull * (v - last[1]), bias + pull * (bias - last[2] if k else 0)
        last = [w, v, bias]
        err = _sigmoid(np.bincount(doc, weights=aw[col], minlength=len(y)) + dense @ av + ab) - y
        w = aw - (np.bincount(col, weights=err[doc], minlength=n) + ridge * aw) / bend
        v = av - (dense.T @ err + ridge * av) / bend_v
        bias = ab - err.sum() / bend_b
    return at, w, v, float(bias)


def predict_linear(rows: list[np.ndarray], dense: np.ndarray, model) -> np.ndarray:
    at, w, v, bias = model
    dictionary = np.zeros(1 << BITS)
    dictionary[at] = w
    return _sigmoid(np.array([dictionary[r].sum() for r in rows]) + dense @ v + bias)


def fit_chain(rows: list[np.ndarray], labels: dict[str, np.ndarray], folds: np.ndarray, most: int = 1500, least_rows: int = 6, ridge: float = 1.0, steps: int = 120) -> tuple[list[Link], dict[str, np.ndarray]]:
    """The chain, and the out-of-fold probabilities of each category. A label of NaN is not used, but its row takes part in the
    categories that it is labelled for. Thresholds hold a precision out of fold."""
    dense, chain, held = np.zeros((len(rows), 0)), [], {}
    for name, given in labels.items():
        there = ~np.isnan(given)
        y = np.where(there, given, 0.0)
        rate = float(given[there].mean()) if there.any() else 0.0
        if not 0 < y.sum() < there.sum():
            p = np.full(len(y), rate)
            chain.append(Link(name, float(_odds(np.array([p[0] if len(p) else 0.0]))[0]), chain=[0.0] * dense.shape[1]))
        else:
            p = np.zeros(len(y))
            for k in np.unique(folds):
                inside = np.flatnonzero((folds != k) & there)
                outside = np.flatnonzero(folds == k)
                if len(inside) and 0 < y[inside].sum() < len(inside):
                    m = fit_linear([rows[i] for i in inside], dense[inside], y[inside], most, least_rows, ridge, steps)
                    p[outside] = predict_linear([rows[i] for i in outside], dense[outside], m)
                else:
                    p[outside] = y[inside].mean() if len(inside) else rate
            own = np.flatnonzero(there)
            at, w, v, bias = fit_linear([rows[i] for i in own], dense[own], y[own], most, least_rows, ridge, steps)
            chain.append(Link(name, bias, best_threshold(p[own], y[own]), dict(zip(at.tolist(), w.tolist(), strict=True)), v.tolist()))
        held[name] = p
        dense = np.column_stack([dense, _odds(p)])
    return chain, held


def best_threshold(p: np.ndarray, y: np.ndarray, precision: float = 0.95) -> float:
    """The lowest threshold at which so many of the rejected are rightly so, out of fold; one half if none is."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    if not len(good):
        return 0.5
    k = int(good[-1])
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + low) / 2, 0.3, 0.9))


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], max_rows: int = 6000, folds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> list[Link]:
    """Fit the chain on at most about ``max_rows`` labelled documents, a bound that does not grow with the tables."""
    known = labels.select(F.col(id_col).alias("id"), *(F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories))).dropna("all", subset=[f"y{i}" for i in range(len(categories))]).where("id is not null")
    n = known.count()
    part = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, max_rows / max(n, 1)) * (1 << 30)))
    part = part.groupBy("id").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Features()
        for b in batches:
            blobs = [np.array(memo.of(t.as_py()), np.int32).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(blobs, pa.binary())], [b.schema.names[0], *b.schema.names[2:], "features"])

    ys = [f"y{i}" for i in range(len(categories))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(part, "id").select("id", "text", *ys)
    shape = f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{y} int" for y in ys) + ", features binary"
    # one text for each labelled id, so that the bound holds whatever repeats in the documents
    one = rows.mapInArrow(run, shape).groupBy("id").agg(*(F.max(y).alias(y) for y in ys), F.min("features").alias("features"))
    got = sorted(one.collect(), key=lambda r: r["id"])
    x = [np.frombuffer(r["features"], np.int32) for r in got]
    y = {c: np.array([np.nan if r[f"y{i}"] is None else r[f"y{i}"] != 0 for r in got], float) for i, c in enumerate(categories)}
    fold = np.array([xxhash.xxh3_64_intdigest(str(r["id"])) % folds for r in got], np.int64)
    return fit_chain(x, y, fold)[0]


def score(docs: DataFrame, chain: list[Link], id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """The carried columns (the id alone by default) and p_<category> for each link of the chain. One scan."""
    carry = (id_col,) if carry is None else carry
    features = sorted({f for link in chain for f in link.weights})
    place = {f: i for i, f in enumerate(features)}
    weights = np.array([[link.weights.get(f, 0.0) for f in features] for link in chain]).reshape(len(chain), len(features))
    names: list[str] = []
    for link in chain:
        names.append(as_column([*carry, *names], f"p_{link.name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Features(place)
        for b in batches:
            logit = np.array([weights[:, memo.of(t.as_py())].sum(1) for t in b.column(0)]).reshape(b.num_rows, len(chain))
            p: list[np.ndarray] = []
            for j, link in enumerate(chain):
                p.append(_sigmoid(logit[:, j] + link.bias + sum(c * _odds(q) for c, q in zip(link.chain, p, strict=True))))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *map(pa.array, p)], [*b.schema.names[1:], *names])

    inside = docs.select(F.col(text_col).alias(as_column(list(carry), "scored_text")), *(F.col(f"`{c}`") for c in carry))
    fields = [docs.schema[c] for c in carry]
    shape = type(docs.schema)(fields)
    for n in names:
        shape = shape.add(n, "double")
    return inside.mapInArrow(run, shape)


def graded(labels: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """The chain's categories from a table of quality and toxic flags: low quality, toxic, and both together."""
    low, toxic = 1 - F.col("quality"), F.col("toxic")
    return labels.select("doc_id", low.alias("low_quality"), toxic.alias("toxic"), (low * toxic).alias("toxic_low_quality")), ("low_quality", "toxic", "toxic_low_quality")


def reject(docs: DataFrame, chain: list[Link], category: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the chain does not find to be of the category, with their own columns."""
    scored = score(docs, chain, id_col, text_col, tuple(docs.columns))
    link = next(x for x in chain if x.name == category)
    own = scored.columns[len(docs.columns) + chain.index(link)]
    return scored.where(F.col(own) < link.threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
