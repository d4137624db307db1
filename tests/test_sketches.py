"""Distributions as mergeable state."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedprofile.operators import distributions
from feedprofile.operators.distributions import box_stats, merge_sketches, rank_check, rank_error, sketched_boxes, sketches
from feedprofile.sources import sinks


def people(spark, n, seed=1):
    rnd = random.Random(seed)
    rows = [(k, ("a", "b", None)[k % 3], rnd.choice(("train", "test")), rnd.expovariate(1) ** 2, float(k % 7 == 0)) for k in range(n)]
    return spark.createDataFrame(rows, "id long, g string, split string, x double, y double")


def test_merged_splits_equal_the_whole(spark, tmp_path):
    """With fewer values than a sketch keeps, everything is exact: quartiles that occur, whiskers, outliers."""
    rows = people(spark, 900)
    sinks.write_table(sketches(rows, ("g",), ("x", "y"), by=["split"]), str(tmp_path / "s"), ["split"])
    stored = spark.read.parquet(str(tmp_path / "s"))
    boxes = sketched_boxes(merge_sketches(*[stored.where(F.col("split") == s).drop("split") for s in ("train", "test")]))
    got = {(r["group"], r["metric"]): r for r in boxes.collect()}
    assert len(got) == 6
    local = rows.toPandas()
    for (g, m), r in got.items():
        v = np.sort(local[local["g"].isna() if g is None else local["g"] == g][m].to_numpy())
        q1, med, q3 = (v[int(np.ceil(len(v) * p)) - 1] for p in (0.25, 0.5, 0.75))
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (r["n"], r["q1"], r["med"], r["q3"], r["n_outliers"]) == (len(v), q1, med, q3, len(v) - len(inside))
        assert (r["whisker_lo"], r["whisker_hi"]) == (min(inside[0], q1), max(inside[-1], q3))


def test_ranks_stay_within_the_stated_error(spark):
    rows = people(spark, 60_000)
    few = 200
    state = merge_sketches(*[sketches(rows.where(F.col("id") % 5 == k), ("g",), ("x",), values=few) for k in range(5)], values=few)
    assert state.agg(F.max(F.length("sketch"))).first()[0] < 20_000 and {r["n"] for r in state.collect()} == {20_000}
    boxes = sketched_boxes(state)
    assert all(r["q1_ok"] and r["med_ok"] and r["q3_ok"] for r in rank_check(rows, boxes, ("g",), ("x",), rank_error(few)).collect())
    off = boxes.withColumn("med", F.col("q3"))
    assert not any(r["med_ok"] for r in rank_check(rows, off, ("g",), ("x",), rank_error(few)).collect())
    exact = {r["group"]: r for r in box_stats(rows, ("g",), ("x",)).collect()}
    for r in boxes.collect():
        assert r["n_outliers"] == pytest.approx(exact[r["group"]]["n_outliers"], abs=2 * rank_error(few) * 20_000)


def test_odd_values_and_no_rows(spark):
    rows = spark.createDataFrame([("g", None), ("g", float("nan")), ("g", 2.0), ("h", None)], "d string, v double")
    got = sketched_boxes(sketches(rows, ("d",), ("v",))).collect()
    assert [tuple(r) for r in got] == [("d", "g", "v", 1, 2.0, 2.0, 2.0, 2.0, 2.0, 0)]
    assert sketched_boxes(merge_sketches(sketches(rows.limit(0), ("d",), ("v",)))).count() == 0
    assert distributions.rank_error(2000) < 0.0025


def test_ranks_are_one_literal(spark):
    """A column for each of 4,000 ranks took the driver's planner seconds, whatever the table's size."""
    rows = spark.createDataFrame([("g", 1.0)], "d string, v double")
    plan = sketched_boxes(sketches(rows, ("d",), ("v",)))._jdf.queryExecution().analyzed()
    assert plan.prettyJson().count("catalyst.expressions.Literal") < 200
