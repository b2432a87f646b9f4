"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Every entry c becomes the integer ``floor(1024 c) + 100000``, so counts, sums and spreads
are exact. The covariance is never formed: a pass sends a block Q of a few vectors to
every task, which returns its share of the centred X'XQ, one row per dimension, added up
by Spark. A Chebyshev polynomial recurrence over such passes damps the unwanted part of
the spectrum in Q; then QR and Rayleigh-Ritz. The unwanted interval is bounded above by the
least Ritz value of the block and begins at 0, as a covariance has no lower eigenvalues.
It is certified when for every wanted component the residual ``|VQ - eQ|`` is at rounding
level, and the last pass measures the covariance of the whitened
rows against the identity.

Size: vectors are stored once, packed as integers in blocks; a task streams its blocks. The
driver holds d x block numbers (block 32), whatever the number of vectors; no pass depends
on d x d.

Defined results: null vectors, vectors with null, non-finite or unrepresentable entries
(beyond 2^40 as integers) and vectors of another than the most frequent length (the longest
among equals) are left out; rows that repeat count as often as they occur; null ids stay;
components whose eigenvalue is 0 at rounding level are not returned, so equal vectors give
no rows; a deviation beyond 64 bits is null; an empty table gives an empty table; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import written

COMPONENTS = 8
BLOCK = 32
DEGREE = 10
SCALE, SHIFT = 1024, 100_000
TOLERANCE = 2e-14
_ROUNDS = 60
# Part of all variance below which an eigenvalue is rounding.
_NO_SPREAD = 1e-13
_LIMIT = 1 << 40
_BLOCK_ROWS_BYTES = 1 << 20
_PARTITION_BYTES = 16 << 20


def usable(vector: Column) -> Column:
    """Neither null nor with a null, non-finite or unrepresentable entry."""
    bound = _LIMIT / SCALE
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(bound)))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _integers(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * SCALE).astype(np.int64) + SHIFT).reshape(-1, d)


def pack(vectors: DataFrame, d: int) -> DataFrame:
    """rows, sums (per dimension) and x (64-bit integers) per block of vectors of length d."""
    most = max(1, _BLOCK_ROWS_BYTES // (8 * max(d, 1)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                x = _integers(batch.column(0).slice(first, most), d)
                yield pa.record_batch(
                    [
                        pa.array([len(x)], pa.int64()),
                        pa.array([[int(s) for s in x.sum(axis=0)]], pa.list_(pa.int64())),
                        pa.array([x.tobytes()], pa.binary()),
                    ],
                    names=["rows", "sums", "x"],
                )

    return vectors.mapInArrow(blocks, "rows long, sums array<long>, x binary")


@dataclass
class Vectors:
    """Stored blocks with their exact number and sums."""

    blocks: DataFrame
    n: int
    sums: list[int]

    @property
    def d(self) -> int:
        return len(self.sums)

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean in two parts: its whole number and the rest, so that x - mean is exact to an ulp."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return whole, rest

    def times(self, q: np.ndarray) -> np.ndarray:
        """VQ for the covariance V: one distributed pass."""
        whole, rest = self.centre()
        d, k = q.shape

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d, k))
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    y = (np.frombuffer(x, np.int64).reshape(-1, d) - whole) - rest
                    total += y.T @ (y @ q)
            yield pa.record_batch(
                [pa.array(np.arange(d, dtype=np.int32)), *(pa.array(total[:, i]) for i in range(k))],
                names=["dim", *(f"c{i}" for i in range(k))],
            )

        columns = [f"c{i}" for i in range(k)]
        shares = self.blocks.select("x").mapInArrow(share, "dim int, " + ", ".join(f"{c} double" for c in columns))
        added = shares.groupBy("dim").agg(*(F.sum(c).alias(c) for c in columns)).orderBy("dim").toArrow()
        return np.column_stack([added.column(c).to_numpy() for c in columns]) / self.n

    def trace(self) -> float:
        """Sum of the variances of all dimensions."""
        whole, rest = self.centre()
        d = self.d

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    y = (np.frombuffer(x, np.int64).reshape(-1, d) - whole) - rest
                    total += float(np.vdot(y, y))
            yield pa.record_batch([pa.array([total])], names=["squares"])

        return self.blocks.select("x").mapInArrow(share, "squares double").agg(F.sum("squares")).first()[0] / self.n


def stored(vectors: DataFrame) -> Vectors | None:
    """The vectors of ``vector`` of the most frequent length, packed and stored; None without any."""
    good = vectors.where(usable(F.col("vector")))
    sizes = good.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    longest = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if longest is None or longest.d == 0:
        return None
    d, n = longest
    parts = max(1, -(-n * d * 8 // _PARTITION_BYTES))
    packed = pack(good.where(F.size("vector") == d).select("vector"), d)
    blocks = written(packed.coalesce(parts) if parts < 64 else packed, "whitening-blocks")
    sums = (
        blocks.select(F.posexplode("sums").alias("dim", "s"))
        .groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    )
    return Vectors(blocks, n, [int(r.s) for r in sums])


@dataclass
class Components:
    """Unit eigenvectors in columns by falling eigenvalue, and how they were found."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int


def leading(vectors: Vectors, components: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE) -> Components:
    """The leading eigenpairs of the covariance.

    The residual of a component is taken against ``sqrt(top * own eigenvalue)``, the level at
    which a pass rounds. Components at rounding level are locked: the filter runs on the rest,
    orthogonal to them, so a dominant one drowns nothing. Where the block covers every
    dimension the first Rayleigh-Ritz step is the answer. Rounds end when every wanted
    component is certified, or no longer improves and is certified to 1e-10.
    """
    d = vectors.d
    block = min(d, max(block, 2 * components))
    wanted = min(components, d)
    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((d, block)))
    passes, trace, best = 0, vectors.trace(), None
    for _ in range(_ROUNDS):
        # Rayleigh-Ritz.
        vq = vectors.times(q)
        passes += 1
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        real = values > trace * _NO_SPREAD
        level = np.sqrt(values[0] * np.where(real, values, 1.0)) if real.any() else 1.0
        residuals = np.where(real, np.linalg.norm(vq - q * values, axis=0) / level, 0.0)
        found = Components(values[:wanted], q[:, :wanted], trace, float(residuals[:wanted].max()), passes)
        stalled = best is not None and best.residual < 1e-10 and found.residual > best.residual / 2
        if best is None or found.residual < best.residual:
            best = found
        if found.residual <= TOLERANCE or block == d or stalled:
            break
        locked = int(np.argmax(residuals > TOLERANCE))
        kept, q, vq, values = q[:, :locked], q[:, locked:], vq[:, locked:], values[locked:]

        def free(x: np.ndarray) -> np.ndarray:
            return x - kept @ (kept.T @ x)

        # Chebyshev filter of the unwanted interval [0, cut], scaled by the wanted end. The
        # degree falls where the wanted end would grow 1e8 times over the last wanted value.
        cut = max(values[-1], values[0] * 1e-12)
        half = cut / 2
        last = values[max(0, wanted - 1 - locked)]
        growth = np.arccosh(max(1.0, values[0] / half - 1)) - np.arccosh(max(1.0, last / half - 1))
        steps = degree if growth * degree < 18 else max(1, int(18 / growth))
        sigma = first = half / max(values[0] - half, half)
        before, now = q, free(vq - half * q) * (sigma / half)
        for _ in range(steps - 1):
            after = 1 / (2 / first - sigma)
            passes += 1
            turned = free(vectors.times(now)) - half * now
            before, now = now, turned * (2 * after / half) - sigma * after * before
            sigma = after
        q, _ = np.linalg.qr(np.column_stack([kept, now]))
    if best.residual > 1e-9:
        raise ArithmeticError(f"not certified: residual {best.residual:.1e} after {passes} passes")
    best.passes = passes
    return best


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over the dimensions of (n x - S)^2; None beyond 64 bits."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    y = x - whole
    if len(x) and (int(np.abs(y).max()) + 1) * n < 1 << 31 and (int(np.abs(y).max()) + 1) ** 2 * n * n * len(sums) < 1 << 62:
        z = y * n - np.array(rest, np.int64)
        return (z * z).sum(axis=1).tolist()
    z = y.astype(object) * n - np.array(rest, object)
    return [v if v < 1 << 63 else None for v in (z * z).sum(axis=1)]


def whitened(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    block: int = BLOCK,
    degree: int = DEGREE,
) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened,
    explained, identity_error, eigenvalue and residual."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = table.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind)])
    for field in T.StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double,"
        " identity_error double, eigenvalue double, residual double"
    ):
        schema.add(field)
    fit = stored(rows)
    if fit is None:
        return table.sparkSession.createDataFrame([], schema)
    found = leading(fit, components, block, degree)
    kept = found.values > found.trace * _NO_SPREAD
    values, basis = found.values[kept], found.vectors[:, kept]
    k, n, sums, d = len(values), fit.n, fit.sums, fit.d
    if not k:
        return table.sparkSession.createDataFrame([], schema)
    whole, rest = fit.centre()
    turn = basis / np.sqrt(values)
    # W'W/n over the rows, through the same kind of pass.
    error = float(np.abs(turn.T @ fit.times(turn) - np.eye(k)).max())
    explained = values / found.trace
    names = schema.names

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                x = _integers(part.column(1), d)
                w = ((x - whole) - rest) @ turn
                at = np.repeat(np.arange(len(x)), k)
                deviation = pa.array(_deviations(x, n, sums), pa.int64())
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(at)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(at), n)),
                        deviation.take(pa.array(at)),
                        pa.array(w.ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(at), error)),
                        pa.array(np.tile(values, len(x))),
                        pa.array(np.full(len(at), found.residual)),
                    ],
                    names=names,
                )

    good = rows.where(usable(F.col("vector")) & (F.size("vector") == d))
    return good.mapInArrow(project, schema)
