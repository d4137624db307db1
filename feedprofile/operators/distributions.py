"""Value counts and box-plot statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedprofile.sources.shared import kept


def value_counts(rows: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Rows ``(split, column, value, n)``; null is a value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(split, F.inline(pairs)).groupBy(split, "column", "value").agg(F.count("*").alias("n"))


def in_order(counts: DataFrame, by: str) -> DataFrame:
    """Value counts with their ``place`` within split and column: by ``n``, the most frequent first and ties by value, or by ``value``; null last."""
    if by not in ("n", "value"):
        raise ValueError(f"order by 'n' or 'value', not {by!r}")
    order = [F.asc_nulls_last("value")] if by == "value" else [F.desc("n"), F.asc_nulls_last("value")]
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("split", "column").orderBy(*order)))


KEYS = ("dimension", "group", "metric")


def _long(entities: DataFrame, dimensions: Sequence[str], metrics: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """Rows ``(dimension, group, metric, value)`` of every entity, beside the columns ``more``."""
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("group")) for d in dimensions])
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return entities.select(*more, F.explode(dims).alias("d"), each.alias("e")).select(*more, "d.dimension", "d.group", F.inline("e"))


def beside(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the columns of their group; a null group is one like any other."""
    other = groups.withColumnsRenamed({k: f"_{k}" for k in KEYS})
    return rows.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]).drop(*[f"_{k}" for k in KEYS])


def box_stats(entities: DataFrame, dimensions: Sequence[str], metrics: Sequence[str], exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and outlier counts: ``(dimension, group, metric, n, q1, med, q3,
    whisker_lo, whisker_hi, n_outliers)``.

    Values are counted first, so that memory follows the number of differing values. ``exact=False`` takes approximate
    quartiles, whose state is bounded.
    """
    keys = list(KEYS)
    long = _long(entities, dimensions, metrics)
    counts = long.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    if exact:
        counts = kept(counts)  # read twice, and made from texts
        quartiles = F.percentile("value", [0.25, 0.5, 0.75], F.col("n"))
        boxes = counts.groupBy(*keys).agg(quartiles.alias("q"), F.sum("n").alias("all"))
    else:
        boxes = long.groupBy(*keys).agg(F.percentile_approx("value", [0.25, 0.5, 0.75], accuracy).alias("q"), F.count("*").alias("all"))
    boxes = boxes.select(*keys, "all", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    ends = beside(counts, boxes).groupBy(*keys, "all", "q1", "med", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("lo"), F.max(F.when(inside, F.col("value"))).alias("hi"), F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers")
    )
    return ends.select(
        *keys, F.col("all").alias("n"), "q1", "med", "q3",
        F.least(F.coalesce("lo", "q1"), "q1").alias("whisker_lo"), F.greatest(F.coalesce("hi", "q3"), "q3").alias("whisker_hi"), "n_outliers",
    )


#: Values that a sketch keeps of each level; up to so many values it is exact.
SKETCH_VALUES = 2000


def rank_error(values: int = SKETCH_VALUES) -> float:
    """The sketch's error of a rank, as a share of all values, which it exceeds once in a hundred times (published for KLL sketches)."""
    return 2.296 / values**0.9021


def sketches(entities: DataFrame, dimensions: Sequence[str], metrics: Sequence[str], by: Sequence[str] = (), values: int = SKETCH_VALUES) -> DataFrame:
    """Distributions as mergeable state: ``(by..., dimension, group, metric, n, lo, hi, sketch)``.

    A row is a few ten thousand bytes at most, however many entities it stands for. Null and NaN values are left out; a
    group without any other value has no row. Store it by split, and merge what is asked for.
    """
    some = _long(entities, dimensions, metrics, by).withColumn("value", F.col("value").cast("double")).where("value IS NOT NULL AND NOT isnan(value)")
    state = F.kll_sketch_agg_double("value", F.lit(values)).alias("sketch")
    return some.groupBy(*by, *KEYS).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), state)


def merge_sketches(*parts: DataFrame, values: int = SKETCH_VALUES) -> DataFrame:
    """Distributions of the union of several parts (or of the rows of one, as read from several splits), from their state alone."""
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.kll_merge_agg_double("sketch", F.lit(values)).alias("sketch"))


def sketched_boxes(state: DataFrame, values: int = SKETCH_VALUES) -> DataFrame:
    """Box-plot statistics of sketches, with the columns of ``box_stats``.

    Quartiles are values that occur, the least whose share of values at or below reaches the quarter, so that they may lie
    below interpolated ones. Ranks are off by ``rank_error`` at most in all likelihood; without error while a
    distribution has no more values than a sketch keeps. Whiskers that reach the least or greatest value are exact.
    """
    q = lambda at: F.kll_sketch_get_quantile_double("sketch", at)
    # values at evenly spread ranks, two for each value that a sketch keeps of a level; one literal, as a column for each rank is planned for seconds
    grid = F.lit(np.arange(0.5, 2 * values) / (2 * values))
    rows = state.withColumns({"q1": q(F.lit(0.25)), "med": q(F.lit(0.5)), "q3": q(F.lit(0.75)), "spread": q(grid)})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    rows = rows.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    inside = F.filter("spread", lambda v: v.between(F.col("low"), F.col("high")))
    first = F.when(F.col("lo") >= F.col("low"), F.col("lo")).otherwise(F.array_min("inside"))
    last = F.when(F.col("hi") <= F.col("high"), F.col("hi")).otherwise(F.array_max("inside"))
    whole = (F.col("lo") >= F.col("low")) & (F.col("hi") <= F.col("high"))
    outside = F.round((1 - F.size("inside") / F.lit(2.0 * values)) * F.col("n")).cast("long")
    return rows.withColumn("inside", inside).select(
        *KEYS, "n", "q1", "med", "q3", F.least(F.coalesce(first, "q1"), "q1").alias("whisker_lo"), F.greatest(F.coalesce(last, "q3"), "q3").alias("whisker_hi"),
        F.when(whole, 0).otherwise(outside).alias("n_outliers"),
    )


def rank_check(entities: DataFrame, boxes: DataFrame, dimensions: Sequence[str], metrics: Sequence[str], error: float) -> DataFrame:
    """Whether the quartiles of ``boxes`` have the ranks that they should within ``error``, counted over all entities: ``(dimension, group, metric, q1_ok, med_ok, q3_ok)``."""
    joined = beside(_long(entities, dimensions, metrics).where("value IS NOT NULL"), boxes.select(*KEYS, "q1", "med", "q3"))
    quarters = {"q1": 0.25, "med": 0.5, "q3": 0.75}
    ranks = joined.groupBy(*KEYS).agg(F.count("*").alias("n"), *[c for q in quarters for c in (F.count_if(F.col("value") < F.col(q)).alias(f"{q}_b"), F.count_if(F.col("value") <= F.col(q)).alias(f"{q}_a"))])
    return ranks.select(*KEYS, *[((F.col(f"{q}_b") / F.col("n") <= at + error) & (F.col(f"{q}_a") / F.col("n") >= at - error)).alias(f"{q}_ok") for q, at in quarters.items()])
