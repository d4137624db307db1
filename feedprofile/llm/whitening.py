"""Whitening of vectors by Chebyshev-filtered subspace iteration.

The covariance is never formed: every step multiplies it by a block of columns in one pass over the rows, in which a
task centres its rows, multiplies twice and returns one matrix as wide as the block. A polynomial of such products is
small on the spectrum below the block and grows above it; QR and Rayleigh-Ritz follow, until the residuals certify
the wanted components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from feedprofile.llm.storage import mapped, materialize

SCALE, SHIFT = 1024, 100_000
#: Columns of the block beyond the components, products of a cycle at most, and cycles at most.
GUARD, DEGREE, CYCLES = 24, 12, 60
#: Matrices of tasks go to the driver up to so many bytes; more are first added up in Spark.
GATHERED_BYTES = 32 << 20


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's integer vectors, one a row."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(batches):
    total = None
    for batch in batches:
        if batch.num_rows:
            here = _rows_of(batch).sum(axis=0)
            total = here if total is None else total + here
    if total is not None:
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(total)), pa.int32()), "s": pa.array(total, pa.int64())})


class Rows:
    """The integer vectors of a table with their number and sums; ``product`` is one pass over them."""

    def __init__(self, table: DataFrame, n: int, width: int, tasks: int):
        self.table, self.n, self.tasks = table, n, tasks
        sums = mapped(table.select("x"), _sums, "dim int, s long").groupBy("dim").agg(F.sum("s").alias("s")).collect()  # a row for each dimension
        self.sums = np.zeros(width, np.int64)
        for r in sums:
            self.sums[r["dim"]] = r["s"]

    def centring(self):
        """Takes the mean from rows; the difference is taken in whole numbers."""
        n, sums = self.n, self.sums
        return lambda x: (n * x - sums) / n

    def _added(self, run, shape: tuple[int, int]) -> np.ndarray:
        """The sum of the matrices that ``run`` makes of every batch's rows."""

        def task(batches):
            total = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    total += run(_rows_of(batch))
            yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

        parts = mapped(self.table.select("x"), task, "m binary")
        zero = np.zeros(shape[0] * shape[1])
        if self.tasks * zero.nbytes > GATHERED_BYTES:

            def fold(some: pa.Table) -> pa.Table:
                return pa.table({"m": pa.array([sum((np.frombuffer(m) for m in some.column("m").to_pylist()), zero).tobytes()], pa.binary())})

            lane = F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(self.tasks))))
            parts = parts.groupBy(lane.alias("lane")).applyInArrow(fold, "m binary")
        return sum((np.frombuffer(r["m"]) for r in parts.collect()), zero).reshape(shape)

    def product(self, q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``."""

        centred = self.centring()

        def run(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            return y.T @ (y @ q)

        return self._added(run, q.shape) / self.n

    def trace(self) -> float:
        centred = self.centring()
        return float(self._added(lambda x: np.array([[(centred(x) ** 2).sum()]]), (1, 1))[0, 0]) / self.n

    def covariance(self, q: np.ndarray) -> np.ndarray:
        """Covariance of the rows' projections on ``q``, centred on their own mean."""
        k, centred = q.shape[1], self.centring()
        mean = self._added(lambda x: (centred(x) @ q).sum(axis=0, keepdims=True), (1, k)) / self.n

        def run(x: np.ndarray) -> np.ndarray:
            w = centred(x) @ q - mean
            return w.T @ w

        return self._added(run, (k, k)) / self.n


def _ritz(q: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values by falling size, Ritz vectors, and the covariance times these."""
    h = q.T @ y
    e, w = np.linalg.eigh((h + h.T) / 2)
    w = w[:, ::-1]
    return e[::-1], q @ w, y @ w


def eigenpairs(product, width: int, k: int, seed: int = 29) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a positive semidefinite operator and their unit vectors, as columns.

    ``product(q)`` applies it. A pair is certified when its residual is at the level of rounding, ``64 eps`` times the
    largest eigenvalue; the direction's error is then at most that over the distance to the next eigenvalue. Without
    certificate after CYCLES cycles this raises an error.
    """
    k = min(k, width)
    m = min(width, k + GUARD)
    q, _ = np.linalg.qr(np.random.default_rng([seed, width]).normal(size=(width, m)))
    e, q, y = _ritz(q, product(q))
    for _ in range(CYCLES):
        residual = np.linalg.norm(y[:, :k] - q[:, :k] * e[:k], axis=0)
        target = 64 * np.finfo(float).eps * max(e[0], 0.0)
        if (residual <= target).all():
            return e[:k], q[:, :k]
        # damp the spectrum from 0 to the block's least Ritz value; scaled, so that the largest eigenvalue maps to one
        half = max(e[-1], 1e-9 * e[0]) / 2
        reach = max(e[k - 1] / half - 1, 1 + 1e-9)
        growth = math.log(reach + math.sqrt(reach * reach - 1))
        need = math.log(2 * residual.max() / target) / growth
        degree = int(min(DEGREE, max(2, math.ceil(need))))
        first = sigma = half / (e[0] - half)
        past, now = q, (y - half * q) * (sigma / half)
        for _ in range(degree - 1):
            ahead = 1 / (2 / first - sigma)
            past, now = now, (product(now) - half * now) * (2 * ahead / half) - (sigma * ahead) * past
            sigma = ahead
        q, _ = np.linalg.qr(now)
        e, q, y = _ritz(q, product(q))
    raise RuntimeError(f"components not certified after {CYCLES} cycles: residuals {residual}")


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows ``(id_col, component, n, deviation, whitened, explained, identity_error)`` of all usable vectors.

    Entries become whole numbers, ``floor(1024 * c) + 100000``. ``deviation`` is the exact sum of ``(n * x - S)**2``, a
    decimal, as it may outgrow a long. Left out are vectors that are null or empty, hold null or non-finite entries, or
    have another length than most have (ties: the greater length). Components whose eigenvalue is zero up to rounding
    have no whitened value and give no rows: equal vectors, or a table with one vector or none, give no rows at all.
    Rows with repeated or null ids are rows like any other; other columns are ignored.
    """
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    whole = F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT).cast("long"))
    used = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vec_col), lambda c: c.cast("double")).alias("v")).where(ok)
    table = materialize(used.select("id", whole.alias("x")))
    kind = table.schema["id"].dataType
    out = StructType([StructField("id", kind), StructField("x", ArrayType(LongType())), StructField("w", ArrayType(DoubleType()))])
    sizes = table.select(F.size("x").alias("width"), F.spark_partition_id().alias("task")).groupBy("width").agg(F.count("*").alias("n"), F.max("task").alias("last")).orderBy(F.desc("n"), F.desc("width")).first()
    width, n = (sizes["width"], sizes["n"]) if sizes else (0, 0)
    table = table.where(F.size("x") == width)
    k, scale, explained, error, sums, centred = 0, np.zeros((width, 0)), [], 0.0, np.zeros(0, np.int64), None
    if n:
        rows = Rows(table, n, width, sizes["last"] + 1)
        trace, sums, centred = rows.trace(), rows.sums, rows.centring()
        if trace > 0:
            e, q = eigenpairs(rows.product, width, components)
            k = int((e > 1e-13 * e[0]).sum())
            explained = [float(x) for x in e[:k] / trace]
            scale = q[:, :k] / np.sqrt(e[:k])
            error = float(np.abs(rows.covariance(scale) - np.eye(k)).max())

    def task(batches):
        for batch in batches:
            if batch.num_rows and k:
                w = centred(_rows_of(batch)) @ scale
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), made], ["id", "x", "w"])

    projected = mapped(table, task, out)
    wide = lambda c: c.cast("decimal(19,0)")
    gaps = F.zip_with("x", F.array(*[F.lit(int(s)).cast("long") for s in sums]).cast("array<bigint>"), lambda x, s: wide(x * F.lit(n).cast("long") - s))
    squares = F.aggregate(gaps, F.lit(0).cast("decimal(38,0)"), lambda total, g: (total + g * g).cast("decimal(38,0)"))
    share = F.element_at(F.array(*[F.lit(x) for x in explained]).cast("array<double>"), F.col("p") + 1)
    return projected.select("id", squares.alias("deviation"), F.posexplode("w").alias("p", "whitened")).select(
        F.col("id").alias(id_col), (F.col("p") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"),
    )
