"""Whitening of vectors by Jacobi-Davidson, with the covariance as a Spark job and never as a matrix.

The distinct vectors are written once, packed in blocks of whole numbers. A product of the
covariance with some columns is one pass over the blocks: each is centred, multiplied, multiplied
back, and the sums of the tasks are added. The driver holds only columns as long as a vector: the
search space, its image, and the vectors found. Corrections of all vectors still sought come from
one run of MINRES on their projected equations, a column each, so a step of it is one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.scratch import stage
from burnish.llm.frames import arrow_schema

#: Whole numbers beyond this cannot be summed exactly in a block: such an entry counts as not finite.
LARGEST = 1 << 44
#: Residuals to reach, as a part of the largest eigenvalue; what rounding alone may leave; parts of all variance that count as none.
REACHED, ROUNDING, NOTHING = 2.0**-46, 2.0**-36, 1e-12
#: Columns of the search space at first and at most, over those sought; MINRES steps of a correction; rounds.
GUARD, WIDEST, STEPS, ROUNDS = 4, 4, 12, 200

Product = Callable[[np.ndarray], np.ndarray]
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> tuple[DataFrame, int]:
    """``vec_id, x`` with ``floor(scale * entry) + offset`` in x, and the length of the vectors.

    Vectors that are null or hold null, non-finite or huge entries are dropped, and those that have
    not the length that most have (of equally frequent lengths the longest).
    """
    entry = lambda c: c.cast("double") * scale
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(entry(c)) < LARGEST - offset))
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & usable).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda c: F.floor(entry(c)) + offset).alias("x")
    )
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    return rows.where(F.size("x") == d), d


@dataclass(frozen=True)
class Fit:
    """The distinct vectors in blocks, their number and sums."""

    blocks: DataFrame
    d: int
    n: int
    sums: tuple[int, ...]

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the sums have beyond n times the base."""
        return np.array([s % self.n for s in self.sums], np.int64)


def fit_list(rows: DataFrame, d: int) -> Fit:
    """Each vector once. Equal ones are found before they are shuffled, where one task holds several."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy()
                kind = next(k for k in ("<i2", "<i4", "<i8") if x.size and np.iinfo(k).min <= x.min() - 1_000_000 and x.max() - 1_000_000 <= np.iinfo(k).max)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.num_rows]), pa.array([kind]), pa.array([(x - 1_000_000).astype(kind).tobytes()])], ["n", "kind", "body"]
                )

    blocks = stage(rows.select("x").distinct().mapInArrow(packed, "n long, kind string, body binary"), "vectors")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole(batches, d):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(x.sum(axis=0))], ["place", "total"])

    sums = blocks.mapInArrow(summed, "place long, total long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    n = blocks.agg(F.sum("n")).first()[0] or 0
    return Fit(blocks, d, n, tuple(int(r["total"]) for r in sums.orderBy("place").collect()))


def _whole(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist()):
            yield np.frombuffer(body, kind).astype(np.int64).reshape(-1, d) + 1_000_000


def _totals(fit: Fit, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of an array of ``size`` numbers of the centred block."""
    d, base, rest = fit.d, fit.base, fit.rest / fit.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in _whole(batches, d):
            total += of((x - base) - rest).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["place", "total"])

    sums = fit.blocks.mapInArrow(run, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(size)
    for r in sums:
        out[r["place"]] = r["total"]
    return out


def covariance_product(fit: Fit) -> Product:
    """Columns to covariance times columns: one pass over the blocks."""

    def product(columns: np.ndarray) -> np.ndarray:
        return _totals(fit, lambda c: c.T @ (c @ columns), columns.size).reshape(columns.shape) / fit.n

    return product


def minres(product: Product, shifts: np.ndarray, sides: np.ndarray, project: Callable[[np.ndarray], np.ndarray], steps: int, reach: float) -> np.ndarray:
    """Solves P (A - shift) P t = side for every column at once; each step is one product."""

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=b != 0)

    k = sides.shape[1]
    first = np.linalg.norm(sides, axis=0)
    v_old, v, beta, left = np.zeros_like(sides), over(sides, np.broadcast_to(first, sides.shape)), np.zeros(k), first.copy()
    c_old, c, s_old, s = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    w_old, w, t = np.zeros_like(sides), np.zeros_like(sides), np.zeros_like(sides)
    for _ in range(steps):
        image = project(product(v) - v * shifts)
        alpha = (v * image).sum(axis=0)
        v_new = image - alpha * v - beta * v_old
        beta_new = np.linalg.norm(v_new, axis=0)
        r0, r2, r3 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        r1 = np.hypot(r0, beta_new)
        c_old, c, s_old, s = c, over(r0, r1), s, over(beta_new, r1)
        w_old, w = w, over(v - r3 * w_old - r2 * w, np.broadcast_to(r1, sides.shape))
        t += c * left * w
        left = -s * left
        v_old, v, beta = v, over(v_new, np.broadcast_to(beta_new, sides.shape)), beta_new
        if (np.abs(left) <= reach * first).all():
            break
    return t


def orthonormal(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``columns`` adds to the orthonormal ``against``."""
    kept: list[np.ndarray] = []
    for column in columns.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            column = column - against @ (against.T @ column)
            for q in kept:
                column = column - q * (q @ column)
        rest = np.linalg.norm(column)
        if size > 0 and rest > 1e-10 * size:
            kept.append(column / rest)
    return np.stack(kept, 1) if kept else np.zeros((len(columns), 0))


def jacobi_davidson(product: Product, d: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors as columns.

    Rayleigh-Ritz on a search space; a vector whose residual is small enough is locked, and the space
    grows by corrections of the others until all are. The space is cut back to its best vectors when
    it is WIDEST times as wide as wanted. Stops short of REACHED only at what rounding leaves.
    """
    wanted = min(wanted, d)
    draw = np.random.default_rng(seed)
    space = orthonormal(draw.standard_normal((d, min(d, wanted + GUARD))), np.zeros((d, 0)))
    image = product(space)
    best, idle = np.inf, 0
    for turn in range(ROUNDS):
        small = space.T @ image
        values, turned = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, turned = values[order], turned[:, order]
        found = space @ turned[:, :wanted]
        missing = image @ turned[:, :wanted] - found * values[:wanted]
        size, scale = np.linalg.norm(missing, axis=0), max(abs(values[0]), np.finfo(float).tiny)
        locked = size <= REACHED * scale
        worst = size.max() / scale
        best, idle = (worst, 0) if worst < best / 2 else (best, idle + 1)
        if locked.all() or (idle >= 3 and worst <= ROUNDING):
            return values[:wanted], found
        if min(space.shape[1] + int((~locked).sum()), d) > max(WIDEST * wanted, wanted + GUARD) and space.shape[1] < d:
            keep = turned[:, : wanted + GUARD]
            space, image = space @ keep, image @ keep
        sides = -missing[:, ~locked]
        if space.shape[1] < d:
            project = lambda c, x=found: c - x @ (x.T @ c)
            steps = minres(product, values[:wanted][~locked], project(sides), project, STEPS, 2.0 ** -(turn + 1))
            fresh = orthonormal(steps, space)[:, : d - space.shape[1]]
            if not fresh.shape[1]:
                fresh = orthonormal(draw.standard_normal((d, 1)), space)
            space, image = np.hstack([space, fresh]), np.hstack([image, product(fresh)])
        else:
            # The space is everything: only rounding of its image is left. Take both anew.
            space = orthonormal(space @ turned, np.zeros((d, 0)))
            image = product(space)
    raise ArithmeticError(f"The vectors did not converge: a residual is {worst:.1e} of the largest eigenvalue.")


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector, and how well."""

    fit: Fit
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float


def learn(rows: DataFrame, d: int, components: int = 16) -> Whitening | None:
    """From ``rows`` (x); None where no direction has any variance. Directions without variance are no components."""
    fit = fit_list(rows, d) if d else None
    if fit is None or fit.n < 2:
        return None
    trace = _totals(fit, lambda c: (c * c).sum(axis=0), d).sum() / fit.n
    if trace <= 0:
        return None
    values, vectors = jacobi_davidson(covariance_product(fit), d, components)
    real = values > NOTHING * trace
    values, vectors = values[real], vectors[:, real]
    to_white, k = vectors / np.sqrt(values), len(values)

    def spread(c: np.ndarray) -> np.ndarray:
        w = c @ to_white
        return np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)])

    sums = _totals(fit, spread, k + k * k) / fit.n
    seen = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    return Whitening(fit, values, vectors, values / trace, float(np.abs(seen - np.eye(k)).max()))


def whiten(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per vector and component.

    See whole_vectors() for the vectors that are dropped. Components come from the distinct vectors;
    repeated rows and null keys are returned as they are. Directions that hold none of the variance
    are no components, so one distinct vector, or an empty table, gives an empty result. A
    ``deviation`` that does not fit a long is null. Other columns are ignored whatever their names.
    """
    rows, d = whole_vectors(df, key, vector, scale, offset)
    found = learn(rows, d, components)
    if found is None:
        return df.sparkSession.createDataFrame([], _OUT)
    n, base, rest = found.fit.n, found.fit.base, found.fit.rest
    to_white, explained, error = found.vectors / np.sqrt(found.values), found.explained, found.identity_error
    schema, k = arrow_schema(_OUT), len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            x = batch.column(1).flatten().to_numpy().reshape(m, d) - base
            columns = [
                np.repeat(batch.column(0).to_numpy(zero_copy_only=False), k) if not batch.column(0).null_count else [i for i in batch.column(0).to_pylist() for _ in range(k)],
                np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n),
                [v for v in deviations(x, n, rest) for _ in range(k)],
                ((x - rest / n) @ to_white).reshape(-1), np.tile(explained, m), np.full(m * k, error),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, _OUT)


def deviations(x: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Exact sums of squares of n * x - rest by row; None beyond a long."""
    largest = n * (int(np.abs(x).max()) + 1) if x.size else 0
    if largest * largest * x.shape[1] < 1 << 63:
        off = x * n - rest
        return (off * off).sum(axis=1).tolist()
    off = x.astype(object) * n - rest.astype(object)
    return [s if s < 1 << 63 else None for s in (off * off).sum(axis=1).tolist()]
