"""Vector operators against brute force."""

import numpy as np
from pyspark.sql import functions as F

from feedprofile.llm.components import connected_components
from feedprofile.llm.top_k import top_k
from feedprofile.llm.vector_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id int"


def rows(seed=0, n=240, d=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.1, (n, d))
    base[60:120] = base[0] + rng.normal(0, 0.006, (60, d))
    base[120:130] = base[1]
    out = [(k, [float(x) for x in v.astype(np.float32)], k % 2 if k < 230 else None, 5) for k, v in enumerate(base)]
    return out + [(1000, None, 1, 5), (1001, [], 1, 5), (1002, [0.0] * d, 1, 5), (1003, [None] + [1.0] * (d - 1), 1, 5), (1004, [float("nan")] * d, 1, 5), (1005, [float("inf")] * d, 1, 5), (1006, [1.0, 2.0], 1, 5)]


def test_near_vectors_equal_brute_force(spark):
    data = rows()
    good = [(k, np.array(v, np.float64), lab) for k, v, lab, _ in data if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {k: set() for k, *_ in data}
    for i, (a, x, la) in enumerate(good):
        for b, y, lb in good[:i]:
            if la == lb and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                links[a].add(b)
                links[b].add(a)
    low = {k: k for k in links}
    for _ in range(len(links)):
        low = {k: min([low[k], *(low[j] for j in js)]) for k, js in links.items()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {k: (len(js), low[k], low[k] == k) for k, js in links.items()}
    assert sum(n for n, *_ in got.values()) > 1000


def test_top_k_equal_brute_force(spark):
    data = rows(1)
    good = [(k, [int(np.floor(64 * float(x))) for x in v]) for k, v, _, _ in data if v is not None and None not in v and np.isfinite(v).all()]
    got = {}
    for r in top_k(spark.createDataFrame(data, SCHEMA), F.col("id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for k, q in good:
        if k % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != k)[:20]
            assert sorted(got[k]) == [(n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert set(got) == {k for k, _ in good if k % 20 == 0}


def test_top_k_keeps_repeated_ids_and_sparse_rows(spark):
    data = [(20, [1.0, 0.0, 0.0]), (1, [0.1, 0.0, 3.0]), (1, [2.0, 0.0, 0.0]), (2, [0.0, 5.0, 0.0]), (20, [3.0, 0.0, 0.0]), (4, [])]
    got = [tuple(r) for r in top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, 3).collect()]
    one = [(20, 1, 20, 3 * 64 * 64), (20, 2, 1, 2 * 64 * 64), (20, 3, 1, 6 * 64)]
    two = [(20, 1, 1, 6 * 64 * 64), (20, 2, 20, 3 * 64 * 64), (20, 3, 1, 18 * 64)]
    assert sorted(got) == sorted(one + two)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_vectors(empty).count() == 0 and top_k(empty, F.col("id") % 20 == 0).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (101, 101), (7, 6)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}
    assert connected_components(edges.where("u < 0")).count() == 0
