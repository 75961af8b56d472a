"""Embedding whitening from a pivoted Cholesky factor.

Vectors become integers; each distinct vector counts once.  The scatter matrix of the centred vectors is summed as one
partial matrix a task, added up row by row.  Pivoted Cholesky factors it as ``P L L' P'``, stopping where what
is left is rounding noise, so the columns of ``L`` are as many as the rank.  One-sided Jacobi then rotates those columns
until they are orthogonal: their squared norms are the eigenvalues of the scatter, the columns divided by
their norms its eigenvectors.  The matrix is never multiplied out again, which keeps small eigenvalues exact.

Vectors of different lengths are fitted apart.  What one task holds is a few matrices of length x length, whatever the
number of rows; the driver holds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import batches
from waymark.session import materialize

#: Largest cosine between two columns that count as orthogonal.
ORTHOGONAL = 1e-15
SWEEPS = 60
#: Rows centred and multiplied in one numpy pass.
PASS_ROWS = 2048
_LONG = (-(2**63), 2**63 - 1)


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): ``matrix[order][:, order] = L @ L.T``, L lower trapezoidal with as many columns as the rank."""
    left = matrix.astype(np.float64)
    d = len(left)
    order, factor = np.arange(d), np.zeros((d, d))
    noise = d * np.finfo(np.float64).eps * max(left.diagonal().max(initial=0.0), 0.0)
    rank = 0
    for k in range(d):
        pivot = k + int(left.diagonal()[k:].argmax())
        if left[pivot, pivot] <= noise:
            break
        for swapped in (left, left.T, factor):
            swapped[[k, pivot]] = swapped[[pivot, k]]
        order[[k, pivot]] = order[[pivot, k]]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1 :, k] = left[k + 1 :, k] / factor[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
        rank = k + 1
    return factor[:, :rank], order


def _pairings(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs that together hold every pair of n columns once."""
    places = list(range(n + n % 2))
    half = len(places) // 2
    for _ in range(max(len(places) - 1, 0)):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(places[:half], reversed(places[half:]), strict=True) if max(a, b) < n]
        if pairs:
            yield tuple(np.array(side) for side in zip(*pairs, strict=True))
        places = [places[0], places[-1], *places[1:-1]]


def one_sided_jacobi(columns: np.ndarray) -> np.ndarray:
    """The columns, rotated pair by pair until all are orthogonal, longest first."""
    u = columns.copy()
    rounds = list(_pairings(u.shape[1]))
    for _ in range(SWEEPS):
        worst = 0.0
        for i, j in rounds:
            a, b = u[:, i], u[:, j]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            size = np.sqrt(alpha * beta)
            cosine = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, float(cosine.max()))
            turn = cosine > ORTHOGONAL
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            tangent = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = np.where(turn, 1 / np.hypot(1.0, tangent), 1.0)
            sin = np.where(turn, cos * tangent, 0.0)
            u[:, i], u[:, j] = cos * a - sin * b, sin * a + cos * b
        if worst <= ORTHOGONAL * max(1, len(u)):
            break
    return u[:, np.argsort(-(u * u).sum(axis=0), kind="stable")]


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues of a positive semi-definite matrix, falling, and its unit eigenvectors as columns."""
    factor, order = pivoted_cholesky(scatter)
    rotated = one_sided_jacobi(factor)
    norms = np.sqrt((rotated * rotated).sum(axis=0))
    vectors = np.zeros_like(rotated)
    vectors[order] = rotated / norms
    return norms**2, vectors


def _integers(scale: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, embedding -> vec_id, dim, v (little-endian 64-bit integers) of whole finite vectors."""
        for batch in batches(rows, PASS_ROWS):
            keep, dims, cells = [], [], []
            for i, vector in enumerate(batch.column(1)):
                if not vector.is_valid or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    whole = np.floor(scale * x)
                low, high = whole < _LONG[0], whole >= 2.0**63
                v = np.where(low | high, 0, whole).astype("<i8")
                v[low], v[high] = _LONG
                keep.append(i)
                dims.append(len(v))
                cells.append(v.tobytes())
            ids = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(dims, pa.int32()), pa.array(cells, pa.binary())], names=["vec_id", "dim", "v"])

    return run


def _stack(cells: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), "<i8").reshape(len(cells), dim)


def _by_length(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut by length of the vectors."""
    for batch in batches(rows, PASS_ROWS):
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            yield dim, batch.filter(pa.array(dims == dim))


def _sum_parts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, v -> dim, place, n, s: exact sums of each place over the task's vectors."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for dim, batch in _by_length(rows):
        x = _stack(batch.column("v"), dim)
        # Halves of 32 bits cannot overflow within a batch; Python's integers add them up.
        part = (x >> 32).sum(axis=0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        n, before = sums.get(dim, (0, 0))
        sums[dim] = (n + len(x), before + part)
    for dim, (n, s) in sums.items():
        columns = [[dim] * dim, list(range(dim)), [n] * dim]
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()), strict=True)),
                pa.array([str(int(v)) for v in s], pa.string()),
            ],
            names=["dim", "place", "n", "s"],
        )


def centred(x: np.ndarray, n: int, s: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - s`` exactly (64-bit or Python integers), and the same divided by n as doubles."""
    top = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max((abs(v) for v in s), default=0)
    kind = np.int64 if top < 2**63 else object
    exact = n * x.astype(kind) - np.array(s, dtype=kind)
    return exact, (exact / n).astype(np.float64)


def _scatter_parts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, v, n, s -> dim, place, part: rows of the scatter matrix of the task's centred vectors."""
    parts: dict[int, np.ndarray] = {}
    for dim, batch in _by_length(rows):
        _, c = centred(_stack(batch.column("v"), dim), *_moments(batch))
        parts[dim] = parts.get(dim, 0) + c.T @ c
    for dim, part in parts.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([r.tobytes() for r in part], pa.binary())],
            names=["dim", "place", "part"],
        )


def _moments(batch: pa.RecordBatch) -> tuple[int, list[int]]:
    return batch.column("n")[0].as_py(), [int(v) for v in batch.column("s")[0].as_py()]


def _add_rows(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    dim, place = (k.as_py() for k in key)
    total = np.zeros(dim)
    for batch in group:
        for part in batch.column("part").to_pylist():
            total += np.frombuffer(part)
    yield pa.RecordBatch.from_arrays(
        [pa.array([dim], pa.int32()), pa.array([place], pa.int32()), pa.array([total.tobytes()], pa.binary())],
        names=["dim", "place", "part"],
    )


def _solve(most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The rows of one scatter matrix -> one row: n, s, components (dim x found doubles) and eigenvalues of the covariance."""
        dim, n = int(rows["dim"].iloc[0]), int(rows["n"].iloc[0])
        rows = rows.sort_values("place")
        scatter = np.stack([np.frombuffer(p) for p in rows["part"]])
        e, vectors = eigen((scatter + scatter.T) / 2)
        e = e / n
        one = {"dim": dim, "n": n, "s": rows["s"].iloc[0], "vectors": vectors[:, :most].tobytes()}
        return pd.DataFrame([one | {"e": e[:most].tolist(), "trace": float(e.sum())}])

    return run


def _projected(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exact n * x - s, whitened, eigenvalues) of a batch of one length, joined with its model."""
    exact, c = centred(_stack(batch.column("v"), dim), *_moments(batch))
    e = np.array(batch.column("e")[0].as_py())
    vectors = np.frombuffer(batch.column("vectors")[0].as_py()).reshape(dim, len(e))
    return exact, c @ vectors / np.sqrt(e), e


def _merge(a: tuple | None, b: tuple) -> tuple:
    """(count, mean, centred products) of two sets together."""
    if a is None:
        return b
    n, shift = a[0] + b[0], b[1] - a[1]
    return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def _covariance_parts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fit list joined with its model -> dim, n, mean, products of the task's whitened vectors."""
    held: dict[int, tuple] = {}
    for dim, batch in _by_length(rows):
        _, w, _ = _projected(batch, dim)
        mean = w.mean(axis=0)
        held[dim] = _merge(held.get(dim), (len(w), mean, (w - mean).T @ (w - mean)))
    for dim, (n, mean, products) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())],
            names=["dim", "n", "mean", "products"],
        )


def _identity_error(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in group:
        for n, mean, products in zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "products")), strict=True):
            mean = np.frombuffer(mean)
            total = _merge(total, (n, mean, np.frombuffer(products).reshape(len(mean), len(mean))))
    n, _, products = total
    error = np.abs(products / n - np.eye(len(products))).max(initial=0.0)
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([float(error)])], names=["dim", "identity_error"]
    )


def _whiten(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dim, batch in _by_length(rows):
        exact, w, e = _projected(batch, dim)
        top = max(abs(int(exact.max(initial=0))), abs(int(exact.min(initial=0))))
        squares = exact if top * top * dim < 2**63 else exact.astype(object)
        deviation = [int(d) if d <= _LONG[1] else None for d in (squares * squares).sum(axis=1).tolist()]
        rank, m = len(e), len(w)
        rows_of = pa.array(np.repeat(np.arange(m), rank))
        share = e / np.array(batch.column("trace")[0].as_py())
        error = batch.column("identity_error")[0].as_py()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id").take(rows_of),
                pa.array(np.tile(np.arange(1, rank + 1), m), pa.int32()),
                batch.column("n").take(rows_of),
                pa.array(deviation, pa.int64()).take(rows_of),
                pa.array(w.reshape(-1)),
                pa.array(np.tile(share, m)),
                pa.array(np.full(m * rank, error)),
            ],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(vectors: DataFrame, components: int = 4, scale: float = 256.0) -> DataFrame:
    """Whitened coordinates of every usable row: one output row for each of the first ``components`` components.

    ``vectors`` needs vec_id (of any type) and embedding (array of numbers); other columns are ignored.  Entries become
    floor(scale * x), held at the ends of the 64-bit range.  Rows with a null vector or a null or non-finite entry
    are left out; rows with a null or repeated vec_id count like any other.  The fit takes each distinct vector once.
    Vectors of another length have a fit of their own.  Components with no variance do not exist: a fit of one distinct
    vector, or of empty vectors, gives no rows, and one of rank 2 gives two components.  Columns: vec_id, component (from 1
    by falling eigenvalue; equal eigenvalues in some order, the same for all rows), n (distinct vectors), deviation
    (squared length of n * x - sum, exact; null beyond 64 bits), whitened, explained (share of the
    total variance), identity_error (largest absolute entry of the whitened fit list's covariance minus the identity, measured).
    """
    names = {c.lower(): i for i, c in enumerate(vectors.columns)}
    narrow = vectors.toDF(*[f"c{i}" for i in range(len(vectors.columns))]).select(
        F.col(f"c{names['vec_id']}").alias("vec_id"), F.col(f"c{names['embedding']}").cast("array<double>").alias("embedding")
    )
    key = narrow.schema["vec_id"].dataType.simpleString()
    stored = materialize(narrow.mapInArrow(_integers(scale), f"vec_id {key}, dim int, v binary").where("dim > 0"), "vectors")
    fit = materialize(stored.select("dim", "v").distinct(), "fit")

    sums = fit.mapInArrow(_sum_parts, "dim int, place int, n long, s string")
    sums = sums.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    # One row for each length of vectors: Spark broadcasts it by its stored size, or shuffles.
    moments = sums.groupBy("dim").agg(
        F.max("n").alias("n"), F.expr("transform(array_sort(collect_list(struct(place, s))), x -> cast(x.s as string))").alias("s")
    )
    moments = materialize(moments, "moments")

    parts = fit.join(moments, "dim").mapInArrow(_scatter_parts, "dim int, place int, part binary")
    scatter = parts.groupBy("dim", "place").applyInArrow(_add_rows, "dim int, place int, part binary")
    solved = scatter.join(moments, "dim").groupBy("dim").applyInPandas(
        _solve(components), "dim int, n long, s array<string>, vectors binary, e array<double>, trace double"
    )
    model = materialize(solved.where("size(e) > 0"), "model")

    checked = fit.join(model, "dim").mapInArrow(_covariance_parts, "dim int, n long, mean binary, products binary")
    error = checked.groupBy("dim").applyInArrow(_identity_error, "dim int, identity_error double")
    model = materialize(model.join(error, "dim"), "checked-model")
    return stored.join(model, "dim").mapInArrow(
        _whiten,
        f"vec_id {key}, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )
