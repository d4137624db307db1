"""The classifier's optimum and its certificate, and the vocabulary's filter."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from feedprofile.operators import features, linear
from feedprofile.operators.model import Profiler, fit_profiler, model_weights, optimality, prepared

WORDS = "ball goal team song stage tune vote law court film actor scene common other thing".split()


def documents(spark, n=150):
    rnd = random.Random(3)
    rows = []
    for k in range(n):
        kind = k % 3
        some = rnd.choices(WORDS, [6 if i // 3 == kind else 1 for i in range(len(WORDS))], k=rnd.randint(0, 30))
        rows.append((k, " ".join(some), ("sports", "music", "state")[kind], None if k % 7 == 0 else ("a", "b")[rnd.random() < 0.3]))
    return spark.createDataFrame(rows, "id long, document string, topic string, side string")


@pytest.fixture(scope="module")
def fitted(spark):
    train = prepared(documents(spark))
    profiler = fit_profiler(train, ("topic", "side"), min_df=2, most=200, tol=1e-6, max_iter=300)
    n = train.count()
    vocabulary = model_weights(profiler)[0].select("term", ((1.0 + n) / F.exp(F.col("idf") - 1) - 1).alias("df"))
    return profiler, train, features.tfidf(train, vocabulary, n)


def test_certificate_of_an_optimum_and_of_none(fitted):
    profiler, train, rows = fitted
    got = {(r["trait"], r["class"]): r for r in optimality(profiler, train.select("id", "topic", "side"), rows).collect()}
    assert set(got) == {("topic", "music"), ("topic", "sports"), ("topic", "state"), ("side", "a"), ("side", "b")}
    for r in got.values():
        assert r["gradient"] < 1e-5 and r["expected"] == pytest.approx(r["documents"], abs=1e-4)
    assert got["topic", "music"]["documents"] == 50 and got["side", "a"]["documents"] + got["side", "b"]["documents"] == 128
    model, names = profiler.traits["topic"]
    off = Profiler(profiler.features, {"topic": (linear.Linear(model.weights * 1.2, model.intercepts + np.array([0.3, 0, 0])), names)})
    assert all(r["gradient"] > 0.02 for r in optimality(off, train.select("id", "topic"), rows).collect())


def test_certificate_equals_sql(spark, fitted):
    """The gradient by SQL, from the same weights and TF-IDF rows."""
    profiler, train, rows = fitted
    table, classes = model_weights(profiler)
    con = duckdb.connect()
    x, w, docs = rows.toPandas(), table.toPandas(), train.select("id", "topic").toPandas()
    ends = pd.DataFrame([(t, c, b, k + 1) for k, (t, c, b) in enumerate(classes) if t == "topic"], columns=["trait", "c", "b", "k"])
    for name, frame in (("x", x), ("w", w), ("docs", docs), ("ends", ends)):
        con.register(name, frame)
    sql = con.execute("""WITH z AS (
      SELECT d.id, e.c, e.k, any_value(e.b) + coalesce(sum(x.weight * w.w[e.k]), 0) AS z FROM docs d CROSS JOIN ends e LEFT JOIN x ON x.id = d.id LEFT JOIN w ON w.term = x.term GROUP BY d.id, e.c, e.k
    ), p AS (SELECT id, c, k, exp(z) / sum(exp(z)) OVER (PARTITION BY id) AS p FROM z),
    r AS (SELECT p.*, p.p - (d.topic = p.c)::integer AS gap FROM p JOIN docs d USING (id)),
    g AS (SELECT r.c, x.term, sum(x.weight * r.gap) + any_value(w.w[r.k]) AS g FROM r JOIN x USING (id) JOIN w ON w.term = x.term GROUP BY r.c, x.term),
    lengths AS (SELECT c, sum(g ** 2) AS g FROM g GROUP BY c)
    SELECT c, sum(p), sqrt(sum(gap) ** 2 + any_value(g)) FROM r JOIN lengths USING (c) GROUP BY c""").fetchall()
    zero = con.execute("""SELECT c, sqrt(sum(g ** 2)) FROM (SELECT e.c, x.term, sum(x.weight * (1 / 3 - (d.topic = e.c)::integer)) AS g FROM docs d CROSS JOIN ends e JOIN x USING (id) GROUP BY ALL) GROUP BY c""").fetchall()
    first = dict(zero)
    got = {r["class"]: r for r in optimality(profiler, train.select("id", "topic", "side"), rows).where("trait = 'topic'").collect()}
    assert len(sql) == 3
    for c, expected, length in sql:
        assert got[c]["expected"] == pytest.approx(expected, rel=1e-9) and got[c]["gradient"] == pytest.approx(length / first[c], abs=1e-9)


def test_gradient_and_sums_in_spark(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(Vectors.sparse(6, sorted(rng.choice(6, k, replace=False).tolist()), rng.random(k).tolist()), int(rng.integers(-1, 2)), int(rng.integers(0, 3))) for k in (0, 1, 2, 3, 4, 6, 2, 0, 5)]
    schema = StructType([StructField("features", VectorUDT()), StructField("y0", IntegerType()), StructField("y1", IntegerType())])
    frame = spark.createDataFrame(rows, schema).repartition(4)
    blocks, theta = [slice(0, 2), slice(2, 5)], rng.normal(size=(7, 5))
    losses, slope = linear.total_loss(frame, [0, 1], blocks, theta, 4)
    x = np.array([r[0].toArray() for r in rows])

    def plain(at):
        z = x @ at[:-1] + at[-1]
        out = 0.0
        for t, block in enumerate(blocks):
            for k, r in enumerate(rows):
                if r[1 + t] >= 0:
                    out += np.log(np.exp(z[k, block]).sum()) - z[k, block][r[1 + t]]
        return out

    assert losses.sum() == pytest.approx(plain(theta))
    for k in range(theta.size):
        step = np.zeros(theta.size)
        step[k] = 1e-6
        assert slope.ravel()[k] == pytest.approx((plain(theta + step.reshape(theta.shape)) - plain(theta - step.reshape(theta.shape))) / 2e-6, abs=1e-5)
    monkeypatch.setattr(linear, "ENTRIES", 3)
    monkeypatch.setattr(linear, "GATHERED_BYTES", 0)
    assert linear.total_loss(frame, [0, 1], blocks, theta, 4)[1] == pytest.approx(slope)


@pytest.mark.parametrize("most", [7, 40, 10_000])
def test_filter_loses_no_term(spark, monkeypatch, most):
    monkeypatch.setattr(features, "BUCKETS", 64)
    monkeypatch.setattr(features, "SAMPLE_DOCUMENTS", 20)
    words = features.word_table(documents(spark, 300))
    plain = list(map(tuple, features.vocabulary(words, 3, most).collect()))
    assert list(map(tuple, features.vocabulary(words, 3, most, filtered=True).collect())) == plain and plain
    if most == 7:
        assert features.heavy_buckets(words, 3, most).count() < 64


def test_no_documents(spark):
    words = features.word_table(spark.createDataFrame([], "id long, document string"))
    assert features.vocabulary(words).count() == 0 and features.vocabulary(words, filtered=True).count() == 0


def test_terms_are_counted_and_weighed_in_tasks(spark):
    """Terms are numbers until they are counted, and a document is weighed where it is read; rows of one id count as one document's."""
    rows = [(1, ["aa", "bb", "aa", "bb"]), (2, ["bb"]), (2, ["aa", "cc"]), (3, []), (4, None), (None, ["aa"]), (None, ["aa", "bb"])]
    words = spark.createDataFrame(rows, "id long, words array<string>")
    counts = features.term_counts(words).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    assert {tuple(r) for r in counts.collect()} == {("aa", 5, 4), ("bb", 4, 3), ("cc", 1, 1), ("aa bb", 3, 2), ("bb aa", 1, 1), ("aa cc", 1, 1)}
    plan = features.term_counts(words)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "zip_with" not in plan
    terms = spark.createDataFrame([("aa", 1), ("bb", 2), ("aa bb", 3)], "term string, df long")
    got = {(r["id"], r["term"]): r["weight"] for r in features.tfidf(words, terms, 7).collect()}
    idf = {t: math.log(8 / (1 + d)) + 1 for t, d in (("aa", 1), ("bb", 2), ("aa bb", 3))}
    want = {1: {"aa": 2, "bb": 2, "aa bb": 2}, 2: {"aa": 1, "bb": 1}, None: {"aa": 2, "bb": 1, "aa bb": 1}}
    expected = {(k, t): n * idf[t] / math.sqrt(sum((m * idf[u]) ** 2 for u, m in of.items())) for k, of in want.items() for t, n in of.items()}
    assert got == pytest.approx(expected)


def test_expected_sizes_are_true_ones_for_many_rows(spark):
    """The intercepts are settled to a share of a row, and the gradient of every class is small, not only that of all together."""
    docs = documents(spark).crossJoin(spark.range(150).select(F.col("id").alias("k"))).withColumn("id", F.col("id") * 150 + F.col("k")).drop("k")
    words = prepared(docs)
    traits = [c for c in docs.columns if c not in ("id", "document")]
    profiler = fit_profiler(words, traits)
    n = words.count()
    vocabulary = model_weights(profiler)[0].select("term", ((1.0 + n) / F.exp(F.col("idf") - 1) - 1).alias("df"))
    found = optimality(profiler, words.select("id", *traits), features.tfidf(words, vocabulary, n)).collect()
    assert found and max(r["documents"] for r in found) > 5000
    assert all(abs(r["expected"] - r["documents"]) < 0.05 and r["gradient"] < 0.0035 for r in found)
