"""Whitening of embeddings: spectral divide and conquer of their covariance, then one broadcast projection."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free_name, land

EPS = np.finfo(float).eps
LARGEST = np.iinfo(np.int64).max
LIMIT = float(1 << 62)      # components that the scale takes to this size or beyond are no longs
ROWS = 4096                 # vectors that a task turns into a matrix at a time


def polar_factor(a: np.ndarray, rounds: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by the QR form of the dynamically weighted Halley iteration.

    Eigenvalues go to their sign; one that is zero to double precision stays undecided.  The lower bound on the singular values
    is the smallest that doubles can tell from zero: a bound too low costs a round or two, never the result.
    """
    size = len(a)
    x, low = a / np.linalg.norm(a), EPS / 4
    for _ in range(rounds):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        weight = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))) / 2
        outer = (weight - 1) ** 2 / 4
        inner = weight + outer - 1
        q = np.linalg.qr(np.vstack([np.sqrt(inner) * x, np.eye(size)]))[0]
        after = outer / inner * x + (weight - outer / inner) / np.sqrt(inner) * (q[:size] @ q[size:].T)
        after = (after + after.T) / 2
        low = min(1 - EPS, low * (weight + outer * low**2) / (1 + inner * low**2))
        moved, x = np.linalg.norm(after - x), after
        if moved < np.sqrt(size) * 10 * EPS or (moved < np.cbrt(EPS) * 1e-3 and 1 - low < 10 * EPS):
            break
    return x


def _halves(a: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if the matrix is a multiple of the identity."""
    size = len(a)
    norm = max(np.linalg.norm(a), np.finfo(float).tiny)
    middle = np.trace(a) / size
    spread = np.linalg.norm(a - middle * np.eye(size))
    if spread <= 4 * size * EPS * norm:
        return None
    noise = np.random.default_rng(seed).standard_normal((size, size))
    best = None
    for step in (0.0, 0.02, -0.02, 0.07, -0.07, 0.15, -0.15):  # a shift on an eigenvalue decides nothing: the next one
        projector = (polar_factor(a - (middle + step * spread / np.sqrt(size)) * np.eye(size)) + np.eye(size)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < size:
            continue
        basis = np.linalg.qr(projector @ noise[:, :rank])[0]
        basis = np.linalg.qr(projector @ basis, mode="complete")[0]
        left = np.linalg.norm(basis[:, rank:].T @ a @ basis[:, :rank])
        if best is None or left < best[0]:
            best = left, basis[:, :rank], basis[:, rank:]
        if left <= 16 * size * EPS * norm:
            break
    return None if best is None else best[1:]


def _descend(a: np.ndarray, basis: np.ndarray, seed: int) -> Iterator[tuple[float, np.ndarray]]:
    """Eigenpairs by falling value: the part above each shift before the part below it."""
    todo = [(a, basis)]
    while todo:
        a, basis = todo.pop()
        split = _halves(a, seed) if len(a) > 1 else None
        if split is None:
            yield from ((float(a[i, i]), basis[:, i]) for i in range(len(a)))
            continue
        high, low = split
        todo.append((low.T @ a @ low, basis @ low))
        todo.append((high.T @ a @ high, basis @ high))


def principal(cov: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns; numerically zero ones are left out.

    QDWH divide and conquer: the polar factor of the shifted matrix gives the projector on the eigenvectors above the shift, whose
    range and its complement split the matrix in two, down to single rows; parts below the k-th value are never split.
    Of equal eigenvalues any orthonormal basis of their space is given.  The entry of largest size of each vector is positive.
    """
    d = len(cov)
    if not d or not np.trace(cov) > 0:
        return np.zeros(0), np.zeros((d, 0))
    cov = (cov + cov.T) / 2
    found = []
    for value, vector in _descend(cov, np.eye(d), seed):
        if len(found) == k or value <= 8 * d * EPS * np.trace(cov):
            break
        found.append(vector)
    if not found:
        return np.zeros(0), np.zeros((d, 0))
    vectors = np.linalg.qr(np.stack(found, 1))[0]
    values = np.einsum("ij,ij->j", vectors, cov @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    top = vectors[np.abs(vectors).argmax(0), np.arange(len(order))]
    return values[order], vectors * np.where(top < 0, -1.0, 1.0)


def _matrices(batches, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their vectors (array<long> of one length) as a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _second_moments(matrices: Iterator[np.ndarray], d: int) -> Iterator[pa.RecordBatch]:
    """One row per dimension of a task: its sum and its products with all dimensions."""
    total, products, n = np.zeros(d), np.zeros((d, d)), 0
    for y in matrices:
        total += y.sum(0)
        products += y.T @ y
        n += len(y)
    if n:
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "total": total, "products": pa.array(list(products), pa.list_(pa.float64()))})


def _collected(partial: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all tasks: d and d x d numbers, added up by Spark."""
    added = partial.select("i", "total", F.posexplode("products").alias("j", "product")).groupBy("i", "j").agg(F.sum(F.when(F.col("j") == 0, F.col("total"))).alias("total"), F.sum("product").alias("product"))
    total, products = np.zeros(d), np.zeros((d, d))
    for r in added.collect():
        products[r.i, r.j] = r.product
        if r.j == 0:
            total[r.i] = r.total
    return total, products


def grid_vectors(rows: DataFrame, key: str, vector: str, scale: int, shift: int) -> DataFrame:
    """``_key`` and ``_x`` (array<long>): floor(scale * c) + shift of each component of the vectors that take part."""
    entries = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.col(vector).isNotNull() & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * F.lit(float(scale)) < F.lit(LIMIT)))
    grid = F.transform(entries, lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift))
    return rows.where(F.coalesce(sound, F.lit(False))).select(F.col(key).alias("_key"), grid.alias("_x"))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Whitened principal components of each vector: key, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error``; up to ``k`` rows per vector.

    Components c become whole numbers x = floor(scale * c) + shift.  Two passes give the sums of x and, about their rounded means, the
    second moments (whole numbers, so order does not matter while they stay below 2**53); the covariance V, d x d numbers for
    d dimensions, goes to the driver, whatever the number of rows.  ``principal`` takes it apart, and mean and k vectors
    are broadcast to all rows.  ``deviation`` is the exact sum of (n * x - S)**2 over the dimensions (the largest long, if beyond it);
    ``identity_error`` is measured on the whitened rows, which are landed first.

    Null vectors and those that hold null or non-finite entries, or entries that the scale takes to 2**62 or beyond, take no part and give no rows.
    Where lengths differ, only those of the most frequent length (of equally frequent ones the longest) take part.  Repeated
    rows count each time; null keys are kept.  Components whose eigenvalue is zero to double precision have no whitened value
    and no rows: equal vectors, a single one, empty vectors and empty tables give none.  Only key and vector are read.
    """
    spark = rows.sparkSession
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    name = free_name(rows, "_x")
    kept = grid_vectors(rows, key, vector, scale, shift).select("_key", F.col("_x").alias(name), F.size("_x").alias("_d")).where("_d > 0")
    lengths = kept.groupBy("_d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("_d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d, n = lengths["_d"], lengths["n"]
    kept = land(kept.where(F.col("_d") == d).select("_key", name), "whiten-grid")

    def sums(batches):
        total, m = [0] * d, 0
        for part, x in _matrices(batches, name):
            total = [t + int(s) for t, s in zip(total, x.sum(0, dtype=np.int64) if np.abs(x).max() < 1 << 48 else x.astype(object).sum(0), strict=True)]
            m += len(x)
        if m:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "s": pa.array([str(t) for t in total])})

    added = kept.mapInArrow(sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by_dimension = {r.i: int(r.s) for r in added}
    s = [by_dimension[i] for i in range(d)]
    centre = [(2 * t + n) // (2 * n) for t in s]
    rest = [t - n * c for t, c in zip(s, centre, strict=True)]  # S = n * centre + rest, |rest| <= n / 2
    about = np.array(centre, np.int64)

    def moments(batches):
        return _second_moments(((x - about).astype(float) for _, x in _matrices(batches, name)), d)

    total, products = _collected(kept.mapInArrow(moments, "i int, total double, products array<double>"), d)
    mean = np.array([r / n for r in rest])
    cov = products / n - np.outer(mean, mean)
    values, vectors = principal(cov, k)
    m = len(values)
    if not m:
        return spark.createDataFrame([], schema)
    explained = values / np.trace(cov)
    model = spark.sparkContext.broadcast((about, rest, mean, vectors / np.sqrt(values)))  # d x (k + 3) numbers

    def project(batches):
        about, rest, mean, weights = model.value
        exact = np.array(rest, dtype=object)
        for part, x in _matrices(batches, name):
            y = x - about
            if d * (n * float(np.abs(y).max()) + n) ** 2 < 2.0**62:
                off = n * y - np.array(rest, np.int64)
                deviation = (off * off).sum(1).tolist()
            else:
                off = n * y.astype(object) - exact
                deviation = [min(int(v), LARGEST) for v in (off * off).sum(1)]
            white = (y - mean) @ weights
            yield pa.RecordBatch.from_pydict({"_key": part.column("_key"), "deviation": pa.array(deviation, pa.int64()), "white": pa.array(list(white), pa.list_(pa.float64()))})

    key_type = rows.schema[key].dataType.simpleString()
    white = land(kept.mapInArrow(project, f"_key {key_type}, deviation long, white array<double>"), "whiten-rows")
    total, products = _collected(white.mapInArrow(lambda batches: _second_moments((x for _, x in _matrices(batches, "white")), m), "i int, total double, products array<double>"), m)
    error = float(np.abs(products / n - np.outer(total / n, total / n) - np.eye(m)).max())
    share = F.array(*[F.lit(float(e)) for e in explained])
    wide = white.select(F.col("_key").alias(key), "deviation", F.posexplode("white").alias("i", "whitened"))
    return wide.select(key, (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, "i").alias("explained"), F.lit(error).alias("identity_error"))
