"""Embedding whitening, its components from QDWH spectral divide and conquer.

Entries become integers (64 steps a unit), so every sum over vectors is exact: tasks sum products of integers centred
near the mean, Spark adds the tasks' sums as decimals, and the covariance is one division away from the exact value.
What the driver holds is d x d for vectors of d entries, whatever their number.

The symmetric matrix is then divided: the polar factor of it, shifted by the mean of its eigenvalues, is +1 on the space
of those above the shift and -1 on the rest (found by the QR-based weighted Halley iteration), so it gives the
projectors on two invariant spaces; the matrix restricted to each is divided in turn, down to single components. The
whitening matrix, d x 16 at most, goes to all tasks.

Defined cases: a vector that is null or holds null or non-finite entries is dropped; so is an empty one. Vectors of
another length have a fit of their own. A component whose eigenvalue is zero up to rounding has null whitened, and
explained 0; it is left out of identity_error, which is null if no component is left. A null vec_id comes back null.
Rows that repeat count once in the fit and come back each. Of equal eigenvalues any basis is as right; the same is used
for all rows. deviation is null where it is beyond a long. Entries beyond +-MAX_ENTRY, or lengths whose matrices hold
over MAX_MATRIX numbers, raise an error. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

STEPS, OFFSET, COMPONENTS = 64, 1_000_000, 16
MAX_ENTRY, MAX_MATRIX = 1e15, 1 << 24
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_EXACT = 2**52


# ---- eigenvectors of a symmetric matrix --------------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a regular symmetric matrix, by the QR-based dynamically weighted Halley
    iteration."""
    n = len(a)
    x = a / max(np.linalg.norm(a, 2), np.finfo(float).tiny)
    low = 1e-16  # at least this is the smallest singular value; six or seven steps whatever it is
    for _ in range(12):
        square = low * low
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        root = math.sqrt(1 + d)
        weight = root + 0.5 * math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack((math.sqrt(c) * x, np.eye(n))))
        following = (b / c) * x + (weight - b / c) / math.sqrt(c) * (q[:n] @ q[n:].T)
        following = (following + following.T) / 2
        step = np.linalg.norm(following - x)
        x = following
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
        if 1 - low < 1e-15 and step < 1e-8:
            break
    return x


def _ranges(projector: np.ndarray, rank: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of the rest."""
    start = np.random.default_rng(seed).normal(size=(len(projector), rank))
    for _ in range(2):
        start, _ = np.linalg.qr(projector @ start)
    whole, _ = np.linalg.qr(start, mode="complete")
    return whole[:, :rank], whole[:, rank:]


def components_of(a: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix."""
    size = np.linalg.norm(a, 2) if len(a) else 0.0
    values, vectors = [], []
    waiting = [np.eye(len(a))]
    while waiting:
        basis = waiting.pop()
        n = basis.shape[1]
        if not n:
            continue
        inner = basis.T @ a @ basis
        inner = (inner + inner.T) / 2
        mean = np.trace(inner) / n
        centred = inner - mean * np.eye(n)
        spread = np.linalg.norm(centred, 2)
        if n == 1 or spread <= 4 * np.finfo(float).eps * size:  # one component, or all of one eigenvalue
            values += [float(x) for x in np.diag(inner)]
            vectors += [basis[:, i] for i in range(n)]
            continue
        for share in (0.0, 0.05, -0.05, 0.11, -0.11, 0.23, -0.23, 0.37, -0.37):
            # The mean parts the eigenvalues; next to one of them, another shift does.
            sign = polar(centred - share * spread * np.eye(n))
            rank = round((n + np.trace(sign)) / 2)
            if 0 < rank < n and np.linalg.norm(sign @ sign - np.eye(n)) < 1e-9:
                break
        else:
            raise ArithmeticError("no shift divides the matrix")
        above, below = _ranges((sign + np.eye(n)) / 2, rank, seed)
        waiting += [basis @ below, basis @ above]
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).reshape(len(values), len(a))[order].T


# ---- sums over vectors -------------------------------------------------------------------------------------------


def _by_length(batch, vector: int, numbers=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and vectors of a batch, for each length of its vectors."""
    column = batch.column(vector)
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begins = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, flat[begins[rows][:, None] + np.arange(d)]


def _products(means: dict[int, np.ndarray]):
    """For mapInArrow: sums of products of entries, centred near their mean, of all of a task's vectors."""

    def run(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for d, _, x in _by_length(batch, 0):
                z = x - means[d]
                most = int(np.abs(z).max(initial=0))
                exact = most * most * len(z) < _EXACT
                product = (z.T.astype(float) @ z.astype(float)).astype(np.int64) if exact else z.T.astype(object) @ z.astype(object)
                sums[d] = sums[d] + product.astype(object) if d in sums else product.astype(object)
        for d, g in sums.items():
            for i in range(d):
                row = [int(v) for v in g[i, i:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * len(row), pa.int32()), pa.array([i] * len(row), pa.int32()), pa.array(range(i, d), pa.int32()), pa.array([str(v) for v in row])],
                    names=["d", "i", "j", "g"],
                )

    return run


def _white(fits: dict[int, dict]):
    """For mapInArrow: of the fit's vectors, count, means and centred products of the whitened values of a task."""

    def run(batches):
        import pyarrow as pa

        parts: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for d, _, x in _by_length(batch, 0):
                w = _whitened(x, fits[d])
                parts[d] = merged(parts.get(d), (len(w), w.mean(axis=0), centred_products(w)))
        for d, (n, mean, products) in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([mean], pa.list_(pa.float64())), pa.array([products.ravel()], pa.list_(pa.float64()))], names=["d", "n", "mean", "products"])

    return run


def _merged_parts(batches):
    """For mapInArrow: what tasks found, merged."""
    import pyarrow as pa

    parts: dict[int, tuple] = {}
    for batch in batches:
        for row in batch.to_pylist():
            k = len(row["mean"])
            parts[row["d"]] = merged(parts.get(row["d"]), (row["n"], np.array(row["mean"]), np.array(row["products"]).reshape(k, k)))
    for d, (n, mean, products) in parts.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([mean], pa.list_(pa.float64())), pa.array([products.ravel()], pa.list_(pa.float64()))], names=["d", "n", "mean", "products"])


def centred_products(w: np.ndarray) -> np.ndarray:
    c = w - w.mean(axis=0)
    return c.T @ c


def merged(one: tuple | None, two: tuple) -> tuple:
    """Count, means and centred products of two parts together."""
    if one is None:
        return two
    n = one[0] + two[0]
    apart = two[1] - one[1]
    return n, one[1] + apart * (two[0] / n), one[2] + two[2] + np.outer(apart, apart) * (one[0] * two[0] / n)


def _whitened(x: np.ndarray, fit: dict) -> np.ndarray:
    """x - S/n projected, over the root of the eigenvalue; NaN where that is zero."""
    centred = (x - fit["near"]).astype(float) - fit["rest"]
    return (centred @ fit["vectors"]) / fit["roots"]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    near = [s // n for s in sums]
    most = n * (int(max((abs(x - np.array(near)).max(initial=0)), 0)) + 1)
    if most * most * x.shape[1] < 2**62:
        y = n * (x - np.array(near, np.int64)) - np.array([s - n * m for s, m in zip(sums, near, strict=True)], np.int64)
        return (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - np.array(sums, object)
    return [v if (v := int(r)) < 2**63 else None for r in (y * y).sum(axis=1)]


def _output(fits: dict[int, dict]):
    """For mapInArrow: vec_id, x to one row for each component."""

    def run(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        names = [f.split()[0] for f in WHITENED.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                for d, rows, x in _by_length(part, 1):
                    fit, m = fits[d], len(rows)
                    k = len(fit["roots"])
                    ids = part.column(0).take(pa.array(np.repeat(rows, k)))
                    deviation = [v for v in _deviations(x, fit["n"], fit["sums"]) for _ in range(k)]
                    values = _whitened(x, fit).ravel()
                    columns = [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, fit["n"])),
                        pa.array(deviation, pa.int64()),
                        pa.array(values, mask=np.isnan(values)),
                        pa.array(np.tile(fit["explained"], m)),
                        pa.array([fit["identity_error"]] * (m * k), pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


# ---- the fit -----------------------------------------------------------------------------------------------------


def steps(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, the entries as integers, of vectors without null or non-finite entries."""
    v = F.col("v_")
    fine = (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v_")).filter(F.coalesce(fine, F.lit(False)))
    whole = lambda c: F.when(F.abs(c) > MAX_ENTRY, F.raise_error(F.lit("an entry is too large"))).otherwise(F.floor(c * STEPS) + OFFSET)
    return rows.select("vec_id", F.transform(v, whole).cast("array<long>").alias("x"))


def fitted(rows: DataFrame, components: int = COMPONENTS) -> dict[int, dict]:
    """The fit for each length of vectors: n, sums, components, eigenvalues and how far from white the result is."""
    distinct = cut(rows.select("x").distinct())
    each = distinct.select(F.size("x").alias("d"), F.posexplode("x").alias("i", "v"))
    totals: dict[int, dict] = {}
    # A row for each entry of a vector: the lengths are checked first.
    lengths = {r["d"]: r["n"] for r in distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).limit(MAX_MATRIX).collect()}
    if sum(d * d for d in lengths) > MAX_MATRIX:
        raise ValueError("vectors are too long, or of too many lengths")
    for r in each.groupBy("d", "i").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s")).collect():
        totals.setdefault(r["d"], {})[r["i"]] = int(r["s"])
    sums = {d: [t[i] for i in range(d)] for d, t in totals.items()}
    near = {d: np.array([round(v / lengths[d]) for v in s], np.int64) for d, s in sums.items()}
    products = distinct.mapInArrow(_products(near), "d int, i int, j int, g string")
    g = {d: np.zeros((d, d), object) for d in lengths}
    for r in products.groupBy("d", "i", "j").agg(F.sum(F.col("g").cast("decimal(38,0)")).alias("g")).toLocalIterator():
        g[r["d"]][r["i"], r["j"]] = g[r["d"]][r["j"], r["i"]] = int(r["g"])
    fits: dict[int, dict] = {}
    for d, n in lengths.items():
        rest = np.array([s - n * int(m) for s, m in zip(sums[d], near[d], strict=True)], object)
        # Exact integers until here: n sum(zz') - sum(z) sum(z)', over n squared.
        covariance = ((n * g[d] - np.outer(rest, rest)) / (n * n)).astype(float)
        values, vectors = components_of(covariance)
        k, trace = min(components, d), float(np.trace(covariance))
        flat = values[:k] <= d * np.finfo(float).eps * max(float(values[0]), 0.0)
        fits[d] = {
            "n": n,
            "sums": sums[d],
            "near": near[d],
            "rest": (rest / n).astype(float),
            "vectors": vectors[:, :k],
            "roots": np.where(flat, np.nan, np.sqrt(np.maximum(values[:k], 0))),
            "explained": np.where(flat, 0.0, values[:k] / trace if trace else 0.0),
            "values": values,
            "identity_error": None,
        }
    parts = distinct.mapInArrow(_white(fits), "d int, n long, mean array<double>, products array<double>")
    found: dict[int, tuple] = {}
    for r in parts.repartition(32).mapInArrow(_merged_parts, parts.schema).collect():  # 32 rows for each length
        k = len(r["mean"])
        found[r["d"]] = merged(found.get(r["d"]), (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
    for d, (n, _, squares) in found.items():
        error = np.abs(squares / n - np.eye(len(squares)))
        if not np.isnan(error).all():
            fits[d]["identity_error"] = float(np.nanmax(error))
    return fits


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = steps(vectors, id_col, vector_col)
    return rows.mapInArrow(_output(fitted(rows, components)), WHITENED)
