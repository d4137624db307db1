"""Whitening against a dense eigensolver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedprofile.llm import whitening
from feedprofile.llm.whitening import eigenpairs, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, d=40, seed=3):
    rng = np.random.default_rng(seed)
    return [(k, [float(c) for c in np.float32(rng.normal(0, 0.1, d) * np.linspace(2, 1, d))], k % 3) for k in range(n)]


def check(spark, rows, used, components=8, frame=None):
    got = {}
    for r in whiten(frame if frame is not None else spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["component"], []).append(r)
    x = np.floor(1024 * np.array([v for _, v in used], np.float64)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    y = (n * x - total) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    deviation = {k: sum(int(a) ** 2 for a in row) for (k, _), row in zip(used, n * x - total, strict=True)}
    assert sorted(got) == list(range(1, components + 1))
    for k, some in got.items():
        want = {i: w for (i, _), w in zip(used, y @ q[:, k - 1] / np.sqrt(e[k - 1]), strict=True)}
        sign = np.sign(sum(want[r["vec_id"]] * r["whitened"] for r in some))
        assert len(some) == n
        for r in some:
            assert r["n"] == n and int(r["deviation"]) == deviation[r["vec_id"]] and r["identity_error"] < 1e-10
            assert sign * r["whitened"] == pytest.approx(want[r["vec_id"]], abs=1e-9) and r["explained"] == pytest.approx(e[k - 1] / e.sum(), rel=1e-10)


def test_whitened_equal_dense_solution(spark):
    data = vectors()
    odd = [(900, None, 1), (901, [], 1), (902, [None, *[1.0] * 39], 1), (903, [float("nan")] * 40, 1), (904, [float("inf")] * 40, 1), (905, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(data + odd, SCHEMA).withColumns({c: F.lit(7) for c in ("x", "w", "id", "n", "component", "deviation")})
    check(spark, None, [(k, v) for k, v, _ in data], frame=frame)


def test_partial_sums_in_spark(spark, monkeypatch):
    """Matrices of many tasks are added up before the driver sees them."""
    monkeypatch.setattr(whitening, "GATHERED_BYTES", 0)
    data = vectors(80, 6)
    check(spark, data, [(k, v) for k, v, _ in data], components=6)


def test_repeated_rows_and_few_dimensions(spark):
    data = vectors(40, 3)
    got = whiten(spark.createDataFrame([*data, data[0], data[0]], SCHEMA)).collect()
    assert len(got) == 42 * 3 and {r["component"] for r in got} == {1, 2, 3}
    assert len({(r["component"], r["whitened"], r["deviation"]) for r in got if r["vec_id"] == 0}) == 3


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25], 1)], [(k, [0.5, 0.25], 1) for k in range(5)], [(1, None, 1)]])
def test_nothing_to_whiten(spark, rows):
    got = whiten(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_close_eigenvalues_are_certified():
    rng = np.random.default_rng(4)
    u, _ = np.linalg.qr(rng.normal(size=(120, 120)))
    true = np.sort(np.concatenate(([50.0, 10.01, 10.0], rng.uniform(1, 9.99, 117))))[::-1]
    a = (u * true) @ u.T
    e, q = eigenpairs(lambda b: a @ b, 120, 8)
    assert e == pytest.approx(true[:8], rel=1e-13)
    assert np.abs(np.abs((u.T @ q)[np.arange(8), np.arange(8)]) - 1).max() < 1e-12
