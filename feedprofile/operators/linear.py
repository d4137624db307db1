"""Multinomial logistic regression of several traits at once over sparse features.

The loss is the one of ``pyspark.ml``'s regression without standardization. That one optimises in standardised
coordinates all the same, where rare terms make the penalty ill-conditioned: after 200 steps it is still far from its
optimum. Here steps are taken in the terms' own coordinates, and one job adds up the gradients of all traits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gradients of tasks go to the driver up to so many bytes; more are first added up in Spark.
GATHERED_BYTES = 64 << 20
#: Entries of rows that are worked on at a time.
ENTRIES = 1 << 18
#: Steps that the optimiser remembers.
MEMORY = 12
#: How often intercepts are settled, and in how many steps, at most.
ROUNDS = 6


@dataclass
class Linear:
    """Weights of a trait, ``classes x terms``, and the classes' intercepts."""

    weights: np.ndarray
    intercepts: np.ndarray


def sparse(batch: pa.RecordBatch, column: str = "features") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of sparse vectors as (entries of each row, terms, values)."""
    vectors = batch.column(column)
    indices, values = vectors.field("indices"), vectors.field("values")
    counts = np.diff(indices.offsets.to_numpy())
    return counts, indices.flatten().to_numpy(), values.flatten().to_numpy()


def pieces(counts: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Rows, and their entries, in pieces of some ENTRIES entries."""
    ends = np.cumsum(counts)
    s = 0
    while s < len(counts):
        first = ends[s] - counts[s]
        t = max(s + 1, int(np.searchsorted(ends, first + ENTRIES, "right")))
        yield slice(s, t), slice(int(first), int(ends[t - 1]))
        s = t


def _margins(counts: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), weights.shape[1]))
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        out[some] = np.add.reduceat(weights[terms] * values[:, None], starts, axis=0)
    return out


def margins(counts: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``rows x classes``: each row's entries times the weights, ``terms x classes``."""
    return np.concatenate([_margins(counts[r], terms[e], values[e], weights) for r, e in pieces(counts)] or [np.zeros((0, weights.shape[1]))])


def _loss(batch: pa.RecordBatch, traits: list[int], blocks: list[slice], theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed log loss of each trait, and its gradient by weights and, in the last row, intercepts."""
    counts, terms, values = sparse(batch)
    y = np.stack([batch.column(f"y{t}").to_numpy(zero_copy_only=False) for t in traits], axis=1)
    losses, slope = np.zeros(len(blocks)), np.zeros_like(theta)
    for rows, entries in pieces(counts):
        z = _margins(counts[rows], terms[entries], values[entries], theta[:-1]) + theta[-1]
        rest = np.zeros_like(z)
        for t, block in enumerate(blocks):
            known = np.flatnonzero(y[rows, t] >= 0)
            if not len(known):
                continue
            m = z[known, block]
            m -= m.max(axis=1, keepdims=True)
            p = np.exp(m)
            total = p.sum(axis=1, keepdims=True)
            hit = np.arange(len(known)), y[rows, t][known].astype(int)
            losses[t] += (np.log(total[:, 0]) - m[hit]).sum()
            p /= total
            p[hit] -= 1
            rest[known, block] = p
        owner = np.repeat(np.arange(len(z)), counts[rows])
        for k in range(z.shape[1]):
            slope[:-1, k] += np.bincount(terms[entries], weights=rest[owner, k] * values[entries], minlength=len(theta) - 1)
        slope[-1] += rest.sum(axis=0)
    return losses, slope


def total_loss(rows: DataFrame, traits: list[int], blocks: list[slice], theta: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """``_loss`` over all rows, one job."""
    shape = theta.shape

    def task(batches):
        losses, slope = np.zeros(len(blocks)), np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                more, steeper = _loss(batch, traits, blocks, theta)
                losses, slope = losses + more, slope + steeper
        yield pa.RecordBatch.from_pydict({"m": pa.array([np.concatenate((losses, slope.ravel())).tobytes()], pa.binary())})

    parts = rows.select("features", *[f"y{t}" for t in traits]).mapInArrow(task, "m binary")
    size = len(blocks) + theta.size
    if tasks * size * 8 > GATHERED_BYTES:

        def fold(some: pa.Table) -> pa.Table:
            return pa.table({"m": pa.array([sum((np.frombuffer(m) for m in some.column("m").to_pylist()), np.zeros(size)).tobytes()], pa.binary())})

        parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(tasks)))).alias("lane")).applyInArrow(fold, "m binary")
    added = sum((np.frombuffer(r["m"]) for r in parts.collect()), np.zeros(size))
    return added[: len(blocks)], added[len(blocks) :].reshape(shape)


def _squares(rows: DataFrame, terms: int) -> np.ndarray:
    """Summed squares of each term's values."""

    def task(batches):
        total = np.zeros(terms)
        for batch in batches:
            _, at, values = sparse(batch)
            total += np.bincount(at, weights=values * values, minlength=terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int32()), "s": pa.array(total[some], pa.float64())})

    out = np.zeros(terms)
    for r in rows.select("features").mapInArrow(task, "term int, s double").groupBy("term").agg(F.sum("s").alias("s")).collect():  # a row for each term
        out[r["term"]] = r["s"]
    return out


#: Asks for value and gradient at a point, and returns the last point.
Descent = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def descend(theta: np.ndarray, steps: int, curvature: np.ndarray, small: Callable[[np.ndarray], bool]) -> Descent:
    """Limited-memory quasi-Newton steps with backtracking, from a diagonal guess of the curvature, until the gradient is ``small``."""
    value, slope = yield theta
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if small(slope):
            break
        way, shares = slope.copy(), []
        for s, y in reversed(past):
            shares.append((s * way).sum() / (s * y).sum())
            way -= shares[-1] * y
        way /= curvature
        if past:
            way *= (past[-1][0] * past[-1][1]).sum() / (past[-1][1] ** 2 / curvature).sum()
        for (s, y), share in zip(past, reversed(shares), strict=True):
            way += (share - (y * way).sum() / (s * y).sum()) * s
        fall, rate = (slope * way).sum(), 1.0
        if fall <= 0:
            break
        while True:
            next_value, next_slope = yield theta - rate * way
            if next_value <= value - 1e-4 * rate * fall or rate < 1e-8:
                break
            rate /= 2
        if next_value >= value:
            break
        step, change = -rate * way, next_slope - slope
        theta, value, slope = theta + step, next_value, next_slope
        if (step * change).sum() > 0:
            past = [*past, (step, change)][-MEMORY:]
    return theta


def together(descents: list[Descent], evaluate: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray]]]) -> list[np.ndarray]:
    """Run several descents side by side: what they ask for in a round is evaluated at once."""
    asked = {k: next(d) for k, d in enumerate(descents)}
    found: dict[int, np.ndarray] = {}
    while asked:
        answers, now = evaluate(asked), {}
        for k, answer in answers.items():
            try:
                now[k] = descents[k].send(answer)
            except StopIteration as end:
                found[k] = end.value
        asked = now
    return [found[k] for k in range(len(descents))]


def _class_sizes(rows: DataFrame, thetas: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each trait the expected class sizes of its known rows, and their derivative by the intercepts; one job."""

    def task(batches):
        sums = [(np.zeros(at.shape[1]), np.zeros((at.shape[1], at.shape[1]))) for at in thetas]
        for batch in batches:
            counts, terms, values = sparse(batch)
            for t, at in enumerate(thetas):
                known = batch.column(f"y{t}").to_numpy(zero_copy_only=False) >= 0
                z = margins(counts, terms, values, at[:-1])[known] + at[-1]
                p = np.exp(z - z.max(axis=1, keepdims=True, initial=-1e300))
                p /= p.sum(axis=1, keepdims=True)
                sums[t] = sums[t][0] + p.sum(axis=0), sums[t][1] + np.diag(p.sum(axis=0)) - p.T @ p
        yield pa.RecordBatch.from_pydict({"m": pa.array([np.concatenate([np.concatenate((a, b.ravel())) for a, b in sums]).tobytes()], pa.binary())})

    parts = rows.select("features", *[f"y{t}" for t in range(len(thetas))]).mapInArrow(task, "m binary").collect()  # a few numbers of each task
    added = sum((np.frombuffer(r["m"]) for r in parts), np.zeros(sum(at.shape[1] * (at.shape[1] + 1) for at in thetas)))
    out, k = [], 0
    for at in thetas:
        n = at.shape[1]
        out.append((added[k : k + n], added[k + n : k + n + n * n].reshape(n, n)))
        k += n + n * n
    return out


def settle(rows: DataFrame, thetas: list[np.ndarray], sizes: list[np.ndarray], gap: float = 0.01) -> None:
    """Newton steps by the intercepts alone, in place, until all expected class sizes are within ``gap`` rows of the true ones."""
    if not any(at.shape[1] for at in thetas):
        return
    for _ in range(ROUNDS):
        gaps = [(some - expected, slope) for some, (expected, slope) in zip(sizes, _class_sizes(rows, thetas), strict=True)]
        if all(np.abs(g).max(initial=0.0) <= gap for g, _ in gaps):
            break
        for at, (g, slope) in zip(thetas, gaps, strict=True):
            if at.shape[1]:
                at[-1] += np.linalg.pinv(slope, hermitian=True) @ g


def fit_linear(rows: DataFrame, counts: list[list[int]], terms: int, tol: float, steps: int) -> list[Linear]:
    """One model for each trait of ``rows(features, y0, y1...)``, where ``yt`` is the class or -1 for unknown; ``counts`` are the class sizes.

    Mean log loss over the known rows of a trait plus half the squared weights over their number, so that each sum of
    losses has a penalty of half the squared weights. A trait is done when the gradient of each of its classes is ``tol``
    times that at the start, where weights are zero and intercepts fit the class sizes; then its intercepts are settled,
    so that expected class sizes are the true ones however many rows there are, and it goes on where that left a
    gradient too large. Traits that are not done yet share their jobs.
    """
    tasks = rows.select(F.spark_partition_id().alias("task")).agg(F.max("task").alias("last")).first()["last"]
    tasks = 1 + (tasks or 0)
    squares = _squares(rows, terms)

    def evaluate(asked: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        ends = np.cumsum([at.shape[1] for at in asked.values()])
        blocks = [slice(int(e) - at.shape[1], int(e)) for at, e in zip(asked.values(), ends, strict=True)]
        losses, slope = total_loss(rows, list(asked), blocks, np.concatenate(list(asked.values()), axis=1), tasks)
        out = {}
        for (t, at), block, loss in zip(asked.items(), blocks, losses, strict=True):
            steep = slope[:, block].copy()
            steep[:-1] += at[:-1]
            out[t] = (float(loss + 0.5 * (at[:-1] ** 2).sum()), steep)
        return out

    sizes = [np.array(some, float) for some in counts]
    thetas, curvatures, limits, used = [], [], {}, [0] * len(sizes)
    for some in sizes:
        theta = np.zeros((terms + 1, len(some)))
        shares = some / max(some.sum(), 1)
        theta[-1] = np.log(np.maximum(some, 0.5)) - np.log(np.maximum(some, 0.5)).mean()
        # the diagonal of the second derivative at the start: terms that many documents have are far steeper than rare ones
        spread = shares * (1 - shares)
        thetas.append(theta)
        curvatures.append(np.concatenate((1 + np.outer(squares, spread), np.maximum(some.sum() * spread, 1.0)[None])))

    def small(t: int) -> Callable[[np.ndarray], bool]:
        def judge(slope: np.ndarray) -> bool:
            now = np.linalg.norm(slope, axis=0)
            limits.setdefault(t, tol * now)  # the first gradient is that at the start
            used[t] += 1
            return bool((now <= limits[t]).all())

        return judge

    todo = list(range(len(thetas)))
    for _ in range(ROUNDS):
        found = together([descend(thetas[t], steps - used[t], curvatures[t], small(t)) for t in todo], lambda asked: {k: v for k, v in zip(asked, evaluate({todo[k]: at for k, at in asked.items()}).values(), strict=True)})
        for t, theta in zip(todo, found, strict=True):
            thetas[t] = theta
        settle(rows, thetas, sizes)
        slopes = evaluate(dict(enumerate(thetas)))
        todo = [t for t in slopes if not small(t)(slopes[t][1]) and used[t] < steps]
        if not todo:
            break
    return [Linear(theta[:-1].T.copy(), theta[-1].copy()) for theta in thetas]
