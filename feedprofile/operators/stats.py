"""Statistics by trait group, their merge across splits, ratios, summaries and chart tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile_stats(entities: DataFrame, dimensions: Sequence[str], metrics: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """Sums by several single groupings in one pass: rows ``(dimension, group, entities, metrics...)``.

    ``metrics`` names columns to sum, or maps names to aggregates. Groups are strings; a null trait is a group of its own.
    """
    aggregates = {m: F.sum(m) for m in metrics} if not isinstance(metrics, Mapping) else dict(metrics)
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("group")) for d in dimensions])
    # the text work is done per entity before; only counters are expanded, and partial sums leave each task
    long = entities.withColumn("_d", F.explode(dims))
    return long.groupBy(F.col("_d.dimension").alias("dimension"), F.col("_d.group").alias("group")).agg(F.count("*").alias("entities"), *[a.alias(n) for n, a in aggregates.items()])


def merge_stats(*parts: DataFrame) -> DataFrame:
    """Statistics of several parts as those of their union."""
    both = reduce(DataFrame.unionByName, parts)
    counters = [c for c in both.columns if c not in ("dimension", "group")]
    return both.groupBy("dimension", "group").agg(*[F.sum(c).alias(c) for c in counters])


def ratio(above: str, below: str) -> Column:
    return F.try_divide(F.col(above), F.col(below))


def with_ratios(stats: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Ratios of sums; groups without posts are left out."""
    return stats.where((F.col("posts") > 0) & (F.col("entities") > 0)).withColumns({n: ratio(*r) for n, r in ratios.items()})


def summary(stats: DataFrame) -> DataFrame:
    """The printed summary: groups without posts stay, with zeros, and ratios have four decimals."""
    rounded = lambda a: F.round(F.coalesce(ratio(a, "posts"), F.lit(0.0)), 4)
    return stats.select("dimension", "group", "entities", "posts", rounded("emojis").alias("emojis_per_post"), rounded("posts_with_emoji").alias("share_with_emoji"))


#: Charts of the reports, by name: the two sums whose ratio is drawn.
CHARTS = {
    "posts_per_entity": ("posts", "entities"),
    "pronouns_per_post": ("pronouns", "posts"),
    "det_quant_per_post": ("det_quant", "posts"),
    "hashtags_per_post": ("hashtags", "posts"),
    "share_with_hashtag": ("posts_with_hashtag", "posts"),
    "links_per_post": ("links", "posts"),
    "share_with_link": ("posts_with_link", "posts"),
    "emojis_per_post": ("emojis", "posts"),
    "share_with_emoji": ("posts_with_emoji", "posts"),
}


def chart_table(stats: DataFrame, charts: Mapping[str, tuple[str, str]] = CHARTS) -> DataFrame:
    """Rows ``(chart, dimension, group, value)``; a chart leaves out groups whose divisor is zero."""
    values = F.array(*[F.struct(F.lit(n).alias("chart"), ratio(*r).alias("value")) for n, r in charts.items()])
    return stats.select("dimension", "group", F.inline(values)).where("value is not null").select("chart", "dimension", "group", "value")
