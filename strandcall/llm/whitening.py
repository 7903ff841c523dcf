"""Embedding whitening by a bidiagonal qd solver.

The covariance is never formed. Tasks reduce their centred rows block by block to a
triangle R by QR, triangles are joined in a tree of shuffles, and the last one (as
wide as the vectors, whatever the number of rows) is brought to bidiagonal form by
Householder reflections. Its singular values come from the dqds recurrence, which finds
small ones as accurately as large ones, and its singular vectors from twisted
factorisations; the reflections carry them back to directions of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcall.llm.common import ship

SCALE, SHIFT = 64, 1_000_000
FAN_IN = 32  # triangles that a task joins
ROWS = 4096  # rows of a block
EPS = np.finfo(float).eps
TOTALS = "n long, sums array<long>"
TRIANGLE = "part long, size int, triangle binary"
WHITENED = "component int, n long, deviation long, whitened double, explained double"


def complete(vector: Column) -> Column:
    """Not null, and without null, NaN and infinite entries; an empty vector isn't complete either."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector.cast("array<double>"), finite) & (F.size(vector) > 0), F.lit(False))


def grid(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers: floor(64 c) + 1,000,000 of every entry."""
    cells = np.floor(np.asarray(vectors.flatten(), np.float64) * SCALE) + SHIFT
    if len(cells) and np.abs(cells).max() >= 1 << 53:
        raise ArithmeticError("an entry is too large for exact sums")
    return cells.astype(np.int64).reshape(-1, width)


def blocks(batches: Iterator[pa.RecordBatch], width: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            block = batch.slice(start, ROWS)
            yield block, grid(block.column(column), width)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once."""
    return (x * n - sums).astype(np.float64) / n


def triangle(rows: np.ndarray) -> np.ndarray:
    """The R of a QR factorisation, square, with zeros where there are fewer rows than columns."""
    out = np.zeros((rows.shape[1],) * 2)
    r = np.linalg.qr(rows, mode="r") if len(rows) else out
    out[: len(r)] = r
    return out


def joined(triangles: Iterator[np.ndarray], width: int) -> np.ndarray:
    return reduce(lambda r, rows: triangle(np.vstack([r, rows])), triangles, np.zeros((width, width)))


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, W): r = U B W' with orthogonal U and W, by Householder reflections."""
    a, size = r.astype(np.float64).copy(), len(r)
    w = np.eye(size)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        v, norm = x.copy(), np.linalg.norm(x)
        v[0] += np.copysign(norm, x[0])
        square = v @ v
        return v, 2 / square if square > 0 else 0.0

    for k in range(size):
        v, beta = reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < size - 2:
            v, beta = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= beta * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The singular values of a bidiagonal matrix, ascending.

    Works on the squares q and e. A shift below the smallest value that is left is
    taken off in every sweep; one that turns out too large makes a d negative, and the sweep is
    made again with less. The last value is split off when its e is negligible.
    """
    q, e = (diagonal**2).tolist(), (above**2).tolist()
    found, taken, shift = [], 0.0, 0.0
    while q:
        m = len(q)
        if m == 1 or e[-1] <= EPS**2 * (taken + q[-1]):
            found.append(taken + q.pop())
            e = e[: m - 2] if m > 1 else []
            shift = 0.0
            continue
        split = next((k for k in range(m - 2, -1, -1) if e[k] <= EPS**2 * taken), None)
        if split is not None:  # two blocks: each has its own values
            for part in ((q[: split + 1], e[:split]), (q[split + 1 :], e[split + 1 :])):
                found += [taken + v for v in _squares(*part)]
            return np.sqrt(np.sort(np.maximum(found, 0.0)))
        while True:
            swept = _sweep(q, e, shift)
            if swept is not None:
                break
            shift = shift / 4 if shift > EPS * taken and shift > 0 else 0.0
        q, e, least = swept
        taken += shift
        shift = max(0.0, 0.98 * least - e[-1] ** 0.5 * q[-1] ** 0.5) if m > 1 else 0.0
    return np.sqrt(np.sort(np.maximum(found, 0.0)))


def _squares(q: list[float], e: list[float]) -> list[float]:
    return [v * v for v in dqds(np.sqrt(np.array(q)), np.sqrt(np.array(e))).tolist()]


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds transform, and the smallest d of it; none if the shift is too large."""
    d = q[0] - shift
    new_q, new_e, least = [], [], d
    for k in range(len(q) - 1):
        if d < 0:
            return None
        top = d + e[k]
        new_q.append(top)
        if top == 0:  # a value of zero: the rest is deflated with it
            new_e.append(0.0)
            d = q[k + 1] - shift
        else:
            ratio = q[k + 1] / top
            new_e.append(e[k] * ratio)
            d = d * ratio - shift
        least = min(least, d)
    if d < 0:
        return None
    return [*new_q, d], new_e, least


def twisted(diagonal: np.ndarray, above: np.ndarray, square: float) -> np.ndarray:
    """The right singular vector of a bidiagonal matrix without zeros for a squared singular value.

    B'B - square is factorised from the top (stationary qd) and from the bottom (progressive
    qd); where both meet with the smallest remainder the vector is one, and the multipliers give the rest.
    """
    n = len(diagonal)
    d, low = diagonal**2, above / diagonal[:-1]
    tiny = np.finfo(float).tiny
    s, p, down, up = np.empty(n), np.empty(n), np.empty(n - 1), np.empty(n - 1)
    s[0] = -square
    for i in range(n - 1):
        plus = s[i] + d[i] or tiny
        down[i] = d[i] * low[i] / plus
        s[i + 1] = down[i] * low[i] * s[i] - square
    p[-1] = d[-1] - square
    for i in range(n - 2, -1, -1):
        minus = d[i] * low[i] ** 2 + p[i + 1] or tiny
        ratio = d[i] / minus
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - square
    k = int(np.argmin(np.abs(s + p + square)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def right_vectors(diagonal: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors as columns) of a bidiagonal matrix.

    Where an entry above the diagonal is negligible the matrix falls apart, and equal values come
    from different parts. Vectors of values that almost agree are made orthogonal to one another.
    """
    n, most = len(diagonal), max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if most == 0:
        return np.zeros(n), np.eye(n)
    diagonal = np.where(np.abs(diagonal) < EPS * most, EPS * most, diagonal)  # no zeros to divide by: an error of one rounding
    cuts = [0, *(np.flatnonzero(np.abs(above) <= EPS * most) + 1).tolist(), n]
    values, vectors = np.empty(n), np.zeros((n, n))
    for a, b in zip(cuts, cuts[1:]):
        found = dqds(diagonal[a:b], above[a : b - 1])[::-1]
        values[a:b] = found
        for k, value in enumerate(found):
            vectors[a:b, a + k] = twisted(diagonal[a:b], above[a : b - 1], value**2) if b - a > 1 else 1.0
        _orthogonal(found, vectors[a:b, a:b], diagonal[a:b], above[a : b - 1])
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _clusters(values: np.ndarray, gap: float) -> list[slice]:
    """Neighbours in a falling list that differ by no more than a share ``gap``, or by rounding; two or more together."""
    apart = values[:-1] - values[1:] > np.maximum(gap * values[:-1], 64 * EPS * values[:1])
    cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(values)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b - a > 1]


def _orthogonal(values: np.ndarray, vectors: np.ndarray, diagonal: np.ndarray, above: np.ndarray) -> None:
    """Make the vectors of each cluster of values orthogonal, and the cluster diagonal.

    Values that are equal but for rounding give the same twisted vector again and again; their
    space comes from inverse iteration on as many pairs of left and right vectors at once.
    """
    n = len(values)
    b = np.diag(diagonal) + np.diag(above, 1)
    both = np.block([[np.zeros((n, n)), b], [b.T, np.zeros((n, n))]])
    random = np.random.default_rng(0)
    for same in _clusters(values, 1e-7):
        near = both - (np.mean(values[same]) + 4 * EPS * values[0]) * np.eye(2 * n)
        basis = random.normal(size=(2 * n, same.stop - same.start))
        for _ in range(10):
            basis, _ = np.linalg.qr(np.linalg.solve(near, basis))
        vectors[:, same], _ = np.linalg.qr(basis[n:])
    for close in _clusters(values, 1e-3):
        u, _, _ = np.linalg.svd(vectors[:, close], full_matrices=False)
        image = b @ u
        _, rotation = np.linalg.eigh(image.T @ image)
        vectors[:, close] = u @ rotation[:, ::-1]


@dataclass
class Whitening:
    """What was fitted: ``n`` vectors with ``sums``; ``components`` in rows, by falling ``eigenvalues``, and the ``trace``."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """One over the deviation of each component, NaN for those without variance."""
        some = self.eigenvalues > (64 * EPS) ** 2 * max(self.trace, 0.0)
        return np.where(some, 1 / np.sqrt(np.where(some, self.eigenvalues, 1)), np.nan)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.components.T * self.scales


def usable(rows: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """(rows whose vector is complete and has the usual length, that length): the commonest length, the longer of two."""
    whole = rows.where(complete(F.col(vector_col)))
    widths = whole.groupBy(F.size(vector_col).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    first = widths.orderBy(F.desc("n"), F.desc("width")).first()
    width = first["width"] if first else 1
    return whole.where(F.size(vector_col) == width), width


def fit(rows: DataFrame, width: int, vector_col: str = "embedding", components: int = 32) -> Whitening | None:
    """The whitening of all rows, which have complete vectors of ``width`` entries; none if there are no rows.

    Two passes: exact sums, then triangles. The driver sees one triangle.
    """
    vectors = rows.select(F.col(vector_col).cast("array<double>").alias("vector"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for _, x in blocks(batches, width):
            n, sums = n + len(x), [a + int(b) for a, b in zip(sums, x.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.int64()))], ["n", "sums"])

    each = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)]
    total = vectors.mapInArrow(add, TOTALS).agg(F.sum("n").alias("n"), *each).first()
    if not total["n"]:
        return None
    n, sums = total["n"], np.array([total[f"s{k}"] for k in range(width)], np.int64)
    if n * (1 + SHIFT) >= 1 << 62:
        raise ArithmeticError("too many rows for exact sums")

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _as_row(joined((centred(x, n, sums) for _, x in blocks(batches, width)), width))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _as_row(joined((r for b in batches for r in _triangles(b)), width))

    tree = vectors.mapInArrow(reduced, TRIANGLE).withColumn("part", F.spark_partition_id().cast("long"))
    parts = vectors.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        tree = tree.repartition(parts, F.pmod(F.col("part"), F.lit(parts))).mapInArrow(together, TRIANGLE)
        tree = tree.withColumn("part", F.spark_partition_id().cast("long"))
    last = [np.frombuffer(r["triangle"]).reshape(width, width) for r in tree.collect()]
    r = joined(iter(last), width)
    diagonal, above, w = bidiagonal(r)
    values, right = right_vectors(diagonal, above)
    kept = min(components, width)
    return Whitening(n, sums, (w @ right).T[:kept], values[:kept] ** 2 / n, float((r**2).sum() / n))


def _as_row(r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([len(r)], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["part", "size", "triangle"])


def _triangles(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for size, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        yield np.frombuffer(data).reshape(size, size)


def identity_error(rows: DataFrame, width: int, found: Whitening, vector_col: str = "embedding") -> float:
    """The largest entry of the whitened rows' covariance minus the identity, over components with variance."""
    vectors = rows.select(F.col(vector_col).cast("array<double>").alias("vector"))
    some = np.flatnonzero(~np.isnan(found.scales))
    k = len(some)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, x in blocks(batches, width):
            y = found.whitened(x)[:, some]
            total += np.vstack([y.T @ y, y.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()[i] for i in range(total.size)], pa.float64()), pa.array(range(total.size), pa.int32())], ["value", "cell"])

    if not k:
        return 0.0
    cells = vectors.mapInArrow(moments, "value double, cell int").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1) * k)
    total[[c["cell"] for c in cells]] = [c["value"] for c in cells]
    total = total.reshape(k + 1, k) / found.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """The sum over dimensions of (n x - sums)^2 of each row, exact; one that no long holds is an error."""
    apart = x * n - sums
    most = int(np.abs(apart).max(initial=0))
    if most**2 * x.shape[1] < 1 << 63:
        return (apart**2).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in apart.tolist()]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """(vec_id, component int, n, deviation long, whitened, explained, identity_error double).

    One row for every vector that counts and each of its first ``components`` components, numbered
    from 1 by falling eigenvalue. Vectors that are null or empty, have null or non-finite entries, or have
    another length than most, take no part. A null id is an id; repeated rows each count and each
    return. A component without variance has a null ``whitened``, and ``explained`` 0;
    components of equal eigenvalues are any orthonormal basis. No rows give no rows.
    Entries above 2^53 / 64, or deviations that no long holds, are an error.
    """
    rows, width = usable(rows, vector_col)
    found = fit(rows, width, vector_col, components)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, {WHITENED}"
    vectors = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    if found is None:
        return vectors.limit(0).selectExpr("vec_id", *[f"cast(null as {c.split()[1]}) {c.split()[0]}" for c in WHITENED.split(", ")], "cast(null as double) identity_error")
    error = identity_error(rows, width, found, vector_col)
    k = len(found.components)
    share = found.eigenvalues / found.trace if found.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, x in blocks(batches, width, 1):
            m = len(x)
            if not m:
                continue
            repeat = lambda values: np.repeat(np.asarray(values, np.int64), k)
            columns = [
                block.column(0).take(pa.array(repeat(range(m)))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, found.n, np.int64)),
                pa.array(repeat(deviations(x, found.n, found.sums))),
                pa.array(found.whitened(x).ravel(), from_pandas=True),  # NaN becomes null
                pa.array(np.tile(share, m)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", *[c.split()[0] for c in WHITENED.split(", ")]])

    return vectors.mapInArrow(run, schema).withColumn("identity_error", F.lit(error))


ship(__name__)
