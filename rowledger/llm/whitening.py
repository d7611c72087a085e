"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries are put on a grid of 64ths and moved by a million, so vectors are whole numbers.
The fit list holds each distinct vector once; its number of rows n and its sums S are exact,
and a row is centred as (n*x - S) / n before anything is multiplied.

The covariance V is never formed. A block of vectors Q goes through passes over the
stored fit list, each of which adds up X'(XQ) inside the tasks. A round applies a Chebyshev
polynomial of V to the block by its three-term recurrence, a pass for each degree, which
damps what lies between the unwanted ends of the spectrum; QR and Rayleigh-Ritz follow.
Vectors whose residual |Vq - eq| is small are locked and projected out of all that
follows. The upper end of the unwanted part is the block's smallest Ritz value; its lower end
comes from one Lanczos vector that the same passes carry along. The degree is bounded so that
no column drowns in the leading one. At the end the locked vectors go through one more pass:
their residuals certify them, and another pass measures how far the whitened covariance is
from the identity.

What tasks return is a matrix of dimensions x block columns, added up in ``GROUPS`` tasks
where there are many; the driver holds matrices of that size and no rows.

Defined results: rows whose vector is null, or holds null or non-finite entries or entries beyond
2**50 (which have no exact place on the grid), have no result, nor have vectors of another length than the
commonest of the fit list (of equally common ones the longest); equal vectors under several ids
each have their rows; ids may be null; components whose eigenvalue is not above 1e-12
of the largest do not exist, so fewer distinct vectors give fewer of them, and one or none
gives an empty result; of equal eigenvalues any orthonormal vectors are taken; a deviation
beyond 64 bits is null; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Tasks that add up what the tasks of a pass return, where these are many.
GROUPS = 16
#: Eigenvalues below this share of the largest are those of dimensions that do not vary.
RANK = 1e-12


def grid(vector: Column, cells: int = 64, origin: int = 1_000_000) -> Column:
    """Entries as whole numbers; null where the vector has no place on the grid."""
    x = vector.cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) <= 2.0**50))
    return F.when(good, F.transform(x, lambda c: F.floor(c * cells) + origin))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Whitening:
    """n, sums: of the fit list; values, vectors (a column each), residuals: eigenvalues by falling size; trace: of V."""

    n: int
    sums: list[int]
    wide: bool
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.empty(0))
    vectors: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    residuals: np.ndarray = field(default_factory=lambda: np.empty(0))
    identity_error: float = 0.0
    passes: int = 0

    def distances(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact."""
        if self.wide:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x).astype(float) / max(1, self.n)


def _fold(parts: Iterator[list]) -> list | None:
    total = None
    for part in parts:
        total = part if total is None else [x + y for x, y in zip(total, part, strict=True)]
    return total


def over_rows(rows: DataFrame, d: int, step: Callable[[np.ndarray], list]) -> list | None:
    """The sums of what ``step`` makes of the rows' matrices: one pass, added up in the tasks and then in a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _fold(step(_matrix(b.column(0), d)) for b in batches if b.num_rows)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _fold(pickle.loads(p) for b in batches for p in b.column(0).to_pylist())
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    parts = rows.select("x").mapInArrow(run, "part binary")
    if rows.rdd.getNumPartitions() > 4 * GROUPS:
        parts = parts.repartition(GROUPS).mapInArrow(join, "part binary")
    return _fold(pickle.loads(r["part"]) for r in parts.collect())


def _orthonormal(y: np.ndarray, locked: np.ndarray) -> np.ndarray:
    for _ in range(2):
        y = np.linalg.qr(y - locked @ (locked.T @ y))[0]
    return y


def _ritz(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values by falling size, vectors, V times them, residuals."""
    h = q.T @ w
    values, u = np.linalg.eigh((h + h.T) / 2)
    values, u = values[::-1], u[:, ::-1]
    q, w = q @ u, w @ u
    return values, q, w, np.linalg.norm(w - q * values, axis=0)


class _Lanczos:
    """One vector that rides along with the passes; its Ritz values tell where the spectrum begins."""

    def __init__(self, d: int, random: np.random.Generator):
        z = random.standard_normal(d)
        self.basis, self.alpha, self.beta = [z / np.linalg.norm(z)], [], []

    @property
    def next(self) -> np.ndarray:
        return self.basis[-1][:, None]

    def add(self, image: np.ndarray) -> None:
        z = self.basis[-1]
        self.alpha.append(float(z @ image))
        for _ in range(2):
            for b in self.basis:
                image = image - b * (b @ image)
        beta = float(np.linalg.norm(image))
        self.beta.append(beta)
        # an exhausted space goes on with what it has: zeros add nothing
        self.basis.append(image / beta if beta > 1e-10 * max(map(abs, self.alpha)) else np.zeros_like(image))

    def lowest(self) -> float:
        m = len(self.alpha)
        if m < 3:
            return 0.0
        t = np.diag(self.alpha) + np.diag(self.beta[: m - 1], 1) + np.diag(self.beta[: m - 1], -1)
        values, u = np.linalg.eigh(t)
        return max(0.0, float(values[0] - self.beta[-1] * abs(u[-1, 0])))


def eigenpairs(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, tolerance: float = 1e-13, rounds: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k leading eigenvalues of V, their vectors and residuals, where ``apply(Q)`` is V Q."""
    random = np.random.default_rng(seed)
    k = min(k, d)
    size = min(d, k + max(8, k))
    lanczos = _Lanczos(d, random)

    def image(q: np.ndarray) -> np.ndarray:
        if len(lanczos.alpha) >= min(d, 40):
            return apply(q)
        w = apply(np.hstack([q, lanczos.next]))
        lanczos.add(w[:, -1])
        return w[:, :-1]

    locked, found = np.empty((d, 0)), []
    q = np.linalg.qr(random.standard_normal((d, size)))[0]
    values, q, w, left = _ritz(q, image(q))
    largest, before, stalls = max(float(values[0]), 0.0), np.inf, 0
    for _ in range(rounds):
        largest = max(largest, float(values[0]))
        limit = tolerance * largest if stalls < 3 else 1e-10 * largest
        while len(left) and left[0] <= limit and len(found) < k:
            found.append(values[0])
            locked = np.hstack([locked, q[:, :1]])
            values, q, w, left = values[1:], q[:, 1:], w[:, 1:], left[1:]
            before, stalls = np.inf, 0
        if len(found) >= k or not len(left):
            break
        stalls = stalls + 1 if left[0] > before / 2 else 0
        before = min(before, float(left[0]))
        upper, lower = float(values[-1]), min(lanczos.lowest(), float(values[-1]))
        half, centre = (upper - lower) / 2, (upper + lower) / 2
        if half <= 1e-12 * largest:  # what is unwanted is one value: a shifted step
            y = w - centre * q
        else:
            growth = np.arccosh(1 + max(1e-9, float(values[0]) - upper) / half)
            degree = int(np.clip(np.arccosh(1e6) / growth, 2, 12))
            sigma = half / max(float(values[0]) - centre, half)
            tau = 2 / sigma
            old, y = q, (w - centre * q) * (sigma / half)
            for _ in range(degree - 1):
                y -= locked @ (locked.T @ y)
                following = 1 / (tau - sigma)
                old, y = y, 2 * (following / half) * (image(y) - centre * y) - sigma * following * old
                sigma = following
        q = _orthonormal(y, locked)
        values, q, w, left = _ritz(q, image(q))
    else:
        raise RuntimeError(f"{len(found)} of {k} components in {rounds} rounds")
    # certified by a pass of their own
    locked = np.linalg.qr(locked)[0]
    values, q, _, left = _ritz(locked, apply(locked))
    return values, q, left


def fit(rows: DataFrame, k: int = 16) -> tuple[Whitening, int]:
    """The whitening of ``rows`` (x on the grid, null for none) and its number of dimensions."""
    listed = table(rows.where("x is not null").select("x").distinct(), "fit-list")
    lengths = listed.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths or not lengths[0]["d"]:
        return Whitening(0, [], False), 0
    d = lengths[0]["d"]
    listed = listed.where(F.size("x") == d)
    # Python's whole numbers, so that no sum is rounded
    n, sums, reach = over_rows(listed, d, lambda x: [len(x), x.sum(0, dtype=object), _Largest(int(np.abs(x).max()))])
    model = Whitening(int(n), [int(s) for s in sums], reach.value * int(n) >= 1 << 61)

    def apply(q: np.ndarray) -> np.ndarray:
        model.passes += 1

        def step(x: np.ndarray) -> list:
            c = model.centred(x)
            return [c.T @ (c @ q)]

        return over_rows(listed, d, step)[0] / model.n

    model.trace = float(over_rows(listed, d, lambda x: [(model.centred(x) ** 2).sum()])[0]) / model.n
    if model.trace > 0:
        values, vectors, left = eigenpairs(apply, d, k)
        some = values > RANK * values[0]
        # either sign is right; this one does not depend on the run
        signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
        model.values, model.vectors, model.residuals = values[some], (vectors * signs)[:, some], left[some]
        scaled = model.vectors / np.sqrt(model.values)

        def spread(x: np.ndarray) -> list:
            y = model.centred(x) @ scaled
            return [y.T @ y]

        model.identity_error = float(np.abs(over_rows(listed, d, spread)[0] / model.n - np.eye(len(model.values))).max())
    return model, d


class _Largest:
    """A largest value that adds up like a sum."""

    def __init__(self, value: int):
        self.value = value

    def __add__(self, other: _Largest) -> _Largest:
        return _Largest(max(self.value, other.value))


def transform(rows: DataFrame, model: Whitening, d: int) -> DataFrame:
    """(id, deviation, whitened): the sum over dimensions of (n*x - S)^2 and the row on all components. One scan, no shuffle."""
    scaled = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = model.distances(_matrix(batch.column(1), d))
            if int(np.abs(far).max()) ** 2 * d >= 1 << 63:
                far = far.astype(object)
            deviation = [x if x < 1 << 63 else None for x in (far * far).sum(1).tolist()]
            y = far.astype(float) / model.n @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], ["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    some = rows.where((F.size("x") == d) if len(model.values) else F.lit(False))
    return some.select("id", "x").mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def whitened(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, component from 1, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = vectors.select(F.col(id_col).alias("id"), grid(F.col(vector_col)).alias("x"))
    model, d = fit(rows, components)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    each = transform(rows, model, d).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
