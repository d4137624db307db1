import pytest
from pyspark.sql import functions as F

from feedprofile.operators import evaluate
from feedprofile.sources import sinks


def mean_scores(spark, truth, predicted, hit):
    rows = spark.createDataFrame(list(zip(predicted, truth, strict=True)), f"pred_x {'int' if isinstance(truth[0], int) else 'string'}, true_x {'int' if isinstance(truth[0], int) else 'string'}")
    r = evaluate.class_counts(rows, {"x": hit}).agg(F.avg("precision"), F.avg("recall")).first()
    return r[0], r[1]


@pytest.mark.parametrize(("truth", "predicted", "hit", "precision", "recall"), [
    (["male", "female", "binary"] * 3, ["male", "female", "binary", "female", "binary", "male", "binary", "male", "female"], evaluate.exact_hit, 1 / 3, 1 / 3),
    ([1938, 1988, 2008] * 3, [1929, 1984, 2006, 2006, 1929, 1984, 1984, 2008, 1929], evaluate.window_hit, 2.5 / 3, 1 / 3),
    ([2008, 2009, 2010, 2011, 2012], [2008] * 5, evaluate.window_hit, (1 / 3 + 2) / 5, 3 / 5),
    (list(range(1978, 1985)), [1978] * 7, evaluate.window_hit, 5.5 / 7, 6 / 7),
])
def test_golden_means(spark, truth, predicted, hit, precision, recall):
    assert mean_scores(spark, truth, predicted, hit) == (pytest.approx(precision, abs=1e-12), pytest.approx(recall, abs=1e-12))


def test_window_bounds(spark):
    cases = [(2008, 2008, True), (2006, 2008, True), (2010, 2008, True), (2011, 2008, False), (2005, 2008, False), (2008, 2010, True), (1988, 1988, True), (1984, 1988, True),
             (1992, 1988, True), (1983, 1988, False), (1993, 1988, False), (1929, 1938, True), (1947, 1938, True), (1928, 1938, False), (1948, 1938, False)]
    rows = spark.createDataFrame(cases, "p int, t int, want boolean")
    assert rows.where(evaluate.window_hit(F.col("p"), F.col("t")) != F.col("want")).count() == 0


def test_scores(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 5, 5), (0, 0, 6, 6)], "pred_a int, true_a int, pred_b int, true_b int")
    perfect = evaluate.scores(evaluate.class_counts(rows, {"a": evaluate.exact_hit, "b": evaluate.exact_hit}), {"a": "f1_a", "b": "f1_b"})
    assert [(r["key"], r["value"]) for r in perfect.collect()] == [("c_rank", 1.0), ("f1_a", 1.0), ("f1_b", 1.0)]
    wrong = rows.withColumn("pred_a", F.lit(7))
    got = {r["key"]: r["value"] for r in evaluate.scores(evaluate.class_counts(wrong, {"a": evaluate.exact_hit}), {"a": "f1_a"}).collect()}
    assert got == {"c_rank": 0.0, "f1_a": 0.0}
    sinks.append_metrics(perfect, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m"), wholetext=True).first()[0].startswith('measure{\n  key: "c_rank"\n  value: "1.0"\n}')


def test_validation_and_strict_join(spark):
    p = spark.createDataFrame([(1, '{"id":1,"gender":"m","occupation":"s","birthyear":1}'), (2, '{"id":2}'), (5, '{"id":5,"x":1}')], "id long, record string")
    t = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert tuple(evaluate.validation(p, t, "record", ("id", "gender", "occupation", "birthyear")).first()) == (1, 1, 2)
    assert evaluate.join_truth(p, t).count() == 2
    with pytest.raises(ValueError):
        evaluate.join_truth(p, t, strict=True)


def test_unknown_classes(spark):
    from feedprofile.functions import traits

    rows = spark.createDataFrame([("male",), ("female",), ("other",), ("other",), (None,)], "gender string")
    assert list(map(tuple, evaluate.unknown_classes(rows, "gender", traits.GENDER_CODES).collect())) == [("other", 2)]
    codes = rows.select(traits.encode(F.col("gender"), traits.GENDER_CODES).alias("c")).select("c", traits.decode(F.col("c"), traits.GENDER_CODES).alias("d"))
    assert list(map(tuple, codes.collect())) == [(0, "male"), (1, "female"), (None, None), (None, None), (None, None)]
