"""Embedding whitening: exact integer covariances in Spark, components by FEAST contour integration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, table

#: An entry c counts as the integer floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Components that are kept.
COMPONENTS = 8
#: Entries beyond this many units are held at it, so that sums over 10^13 vectors fit decimal(38).
FARTHEST = 1 << 40
#: Nodes of the quadrature on a half circle, and rounds of subspace iteration at most.
NODES, ROUNDS = 12, 40
#: Eigenvalues under this share of the trace count as no variance.
NOTHING = 1e-12


def usable(rows: DataFrame, vector_col: str) -> DataFrame:
    """`rows` with their integer vector as column `x`, without those that have none.

    Null vectors and those with a null or non-finite entry have none; where lengths differ, only the
    commonest length (of several, the longest) is read, and vectors of other lengths have none either.
    """
    entry = F.col(vector_col)
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < math.inf))
    held = lambda c: F.greatest(F.lit(-float(FARTHEST)), F.least(F.lit(float(FARTHEST)), F.floor(c.cast("double") * SCALE).cast("double")))
    found = rows.filter(entry.isNotNull() & (F.size(entry) > 0) & finite).withColumn("x", F.transform(entry, lambda c: held(c).cast("long") + OFFSET))
    sizes = found.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).first()
    return found.filter(F.size("x") == (sizes.size if sizes else 0))


def stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64)


def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's number of vectors (at -1) and sum of each entry."""
    n, total = 0, None
    for rows in batches:
        if len(rows):
            x = stacked(rows["x"])
            n, total = n + len(x), x.astype(object).sum(axis=0) if total is None else total + x.astype(object).sum(axis=0)
    if n:
        yield pd.DataFrame({"i": range(-1, len(total)), "s": [Decimal(int(v)) for v in (n, *total)]})


def exact_products(v: np.ndarray) -> np.ndarray:
    """v'v of integers: in floating point while every sum is below 2^53 and so exact, else in Python integers."""
    largest = int(np.abs(v).max(initial=0))
    if largest**2 * len(v) < 1 << 53:
        return (v.T.astype(float) @ v.astype(float)).astype(np.int64).astype(object)
    return v.T.astype(object) @ v.astype(object)


def partial_products(batches: Iterator[pd.DataFrame], centre: np.ndarray) -> Iterator[pd.DataFrame]:
    """A task's sums of products of centred entries, i <= j."""
    total = None
    for rows in batches:
        if len(rows):
            part = exact_products(stacked(rows["x"]) - centre)
            total = part if total is None else total + part
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pd.DataFrame({"i": i, "j": j, "s": [Decimal(int(v)) for v in total[i, j]]})


def moments(vectors: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance) of the integer vectors `x`.

    Entries are centred at the integer below their mean before they are multiplied, and all sums are of
    integers, so that only the last division rounds. The driver gets one number a pair of dimensions.
    """
    sums = vectors.select("x").mapInPandas(partial_sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    found = {r.i: int(r.s) for r in sums}
    n = found.pop(-1, 0)
    if not n:
        return 0, [], np.zeros((0, 0))
    total = [found[i] for i in range(len(found))]
    centre = [s // n for s in total]
    at = np.array(centre, dtype=np.int64)
    products = vectors.select("x").mapInPandas(lambda batches: partial_products(batches, at), "i int, j int, s decimal(38,0)")
    covariance = np.zeros((len(total), len(total)))
    for r in products.groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect():
        rest = (total[r.i] - n * centre[r.i]) * (total[r.j] - n * centre[r.j])
        covariance[r.i, r.j] = covariance[r.j, r.i] = float(Fraction(n * int(r.s) - rest, n * n))
    return n, total, covariance


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above `shift`: the inertia of the shifted matrix.

    By Sylvester's law, the signs of the pivots of a symmetric factorisation with complete pivoting, by
    single entries or, where those are small, by pairs, one of which is positive.
    """
    a = matrix - shift * np.eye(len(matrix))
    count, k, d = 0, 0, len(a)
    while k < d:
        rest = np.abs(a[k:, k:])
        diagonal = rest.diagonal()
        i = int(diagonal.argmax())
        r, s = divmod(int(rest.argmax()), d - k)
        if not rest[r, s]:
            break
        single = diagonal[i] >= 0.64 * rest[r, s]
        for at, other in ((k, k + i),) if single else ((k, k + min(r, s)), (k + 1, k + max(r, s))):
            a[[at, other]] = a[[other, at]]
            a[:, [at, other]] = a[:, [other, at]]
        size = 1 if single else 2
        pivot, side = a[k : k + size, k : k + size], a[k + size :, k : k + size].copy()
        count += 1 if size == 2 or pivot[0, 0] > 0 else 0
        a[k + size :, k + size :] -= side @ np.linalg.solve(pivot, side.T)
        k += size
    return count


def interval(matrix: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """(low, high, n): an interval with the `wanted` largest eigenvalues of a covariance, n of them with ties.

    Eigenvalues without variance are never inside. Ends are found by halving, guided by inertia counts.
    """
    most = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9)
    floor = NOTHING * float(np.trace(matrix))
    n = above(matrix, floor)
    low, high = floor, most
    while high - low > 0.02 * most:  # the largest eigenvalue
        middle = (low + high) / 2
        low, high = (middle, high) if above(matrix, middle) else (low, middle)
    top = high
    if n <= wanted:
        return floor, top, n
    low, high = floor, top
    while high - low > 1e-13 * most:
        middle = (low + high) / 2
        n = above(matrix, middle)
        if n == wanted:
            return middle, top, n
        low, high = (middle, high) if n > wanted else (low, middle)
    return low, top, above(matrix, low)


def projected(matrix: np.ndarray, start: np.ndarray, low: float, high: float) -> np.ndarray:
    """`start` filtered by the contour around [low, high]: a Gauss-Legendre sum of complex shifted solves."""
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    out = np.zeros_like(start)
    for x, w in zip(points, weights, strict=True):
        turn = np.exp(1j * math.pi / 2 * (1 - x))
        out += (w / 2 * radius * turn * np.linalg.solve((centre + radius * turn) * np.eye(len(matrix)) - matrix, start)).real
    return out


def ritz(matrix: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz values, falling, and vectors of `matrix` in the columns of `space`."""
    base, _ = np.linalg.qr(space)
    values, inner = np.linalg.eigh(base.T @ matrix @ base)
    return values[::-1], (base @ inner)[:, ::-1]


def components(covariance: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as columns) of the largest eigenvalues of a covariance, falling.

    FEAST: a subspace is filtered by contour integration and refined by Rayleigh-Ritz until the residuals
    no longer fall. The number of values found in the interval must be its inertia count, and so must the
    number above each gap, or the search starts again with a larger subspace. Directions without variance
    are left out, so there may be fewer than `wanted`; of tied eigenvalues any basis may come. The sign of
    a vector makes its largest entry positive.
    """
    d, size = len(covariance), float(np.trace(covariance)) if len(covariance) else 0.0
    if size <= 0:
        return np.zeros(0), np.zeros((d, 0))
    matrix = covariance / size
    low, high, inside = interval(matrix, min(wanted, d))
    for extra in (inside + 8, 3 * inside + 16, d):
        space = np.random.default_rng(extra).standard_normal((d, min(d, inside + extra)))
        best = math.inf
        for _ in range(ROUNDS):
            values, vectors = ritz(matrix, projected(matrix, space, low, high))
            space = vectors
            found = values > low
            worst = np.abs(matrix @ vectors[:, found] - vectors[:, found] * values[found]).max(initial=0.0)
            if found.sum() == inside and worst >= best / 2:
                break
            best = worst if found.sum() == inside else math.inf
        values, vectors = values[found], vectors[:, found]
        gaps = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False) if a - b > 1e-9 * values[0]]
        if len(values) == inside and all(above(matrix, g) == (values > g).sum() for g in gaps):
            values, vectors = values[:wanted], vectors[:, :wanted]
            largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
            return values * size, vectors * np.sign(largest)
    raise ArithmeticError("contour integration has missed eigenvalues that the inertia counts")


def projection(batches: Iterator[pd.DataFrame], n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> Iterator[pd.DataFrame]:
    """Each vector's exact deviation and its projections on the components, over their standard deviations."""
    centre = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s - n * (s // n) for s in sums]
    shift, across = np.array([r / n for r in rest]), vectors / np.sqrt(values)
    for rows in batches:
        if not len(rows):
            continue
        v = stacked(rows["x"]) - centre
        white = (v - shift) @ across
        whole = v.astype(object)
        far = n * n * (whole * whole).sum(axis=1) - 2 * n * (whole @ np.array(rest, dtype=object)) + sum(r * r for r in rest)
        yield pd.DataFrame({"id": rows["id"], "deviation": pd.array([int(f) if f < 1 << 63 else None for f in far], dtype="Int64"), "white": list(white)})


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS) -> tuple[DataFrame, int, np.ndarray, float]:
    """(whitened rows, n, values, trace): the rows have id, deviation and white, an array of a number a component.

    Vectors without usable entries are left out (see `usable`); repeated rows and ids count each time they
    occur. An empty table, or one whose vectors are all equal, gives no rows. A deviation that a long can't
    hold is null. Other columns are not read.
    """
    vectors = durable(usable(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector").select("id", "x"))
    n, sums, covariance = moments(vectors)
    values, across = components(covariance, wanted)
    kind = dict(vectors.dtypes)["id"]
    if not len(values):
        return vectors.limit(0).select("id", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("white")), n, values, 0.0
    white = vectors.mapInPandas(lambda batches: projection(batches, n, sums, values, across), f"id {kind}, deviation long, white array<double>")
    return durable(white), n, values, float(np.trace(covariance))


def identity_error(white: DataFrame, n_components: int) -> float | None:
    """The largest absolute entry of the covariance of the `white` numbers minus the identity; null without rows."""
    if not n_components:
        return None
    means = white.agg(*[F.avg(F.col("white")[i]).alias(f"m{i}") for i in range(n_components)]).first()
    part = [F.col("white")[i] - F.lit(means[i]) for i in range(n_components)]
    pairs = [(i, j) for i in range(n_components) for j in range(i + 1)]
    found = white.agg(*[F.avg(part[i] * part[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))


def op11_whitening(spark, sf_dir):
    """Every vector on every component."""
    white, n, values, trace = whitened(table(spark, sf_dir, "embeddings"))
    error = identity_error(white, len(values))
    explained = F.element_at(F.array(*[F.lit(float(v) / trace) for v in values]).cast("array<double>"), F.col("component"))
    rows = white.select("id", "deviation", F.posexplode("white").alias("place", "whitened")).withColumn("component", (F.col("place") + 1).cast("int"))
    columns = [F.col("id").alias("vec_id"), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened"]
    return rows.select(*columns, explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
