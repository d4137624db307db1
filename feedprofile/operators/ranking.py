"""Emoji frequencies and the most frequent ones of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedprofile.functions import text


def emoji_lists(feeds: DataFrame, posts: str = "posts") -> DataFrame:
    """Feeds with the emojis of their posts, ``emoji_list``, in place of the posts."""
    return feeds.withColumn("emoji_list", text.emojis(F.array_join(posts, "\n"))).drop(posts)


def emoji_frequencies(feeds: DataFrame, dimensions: Sequence[str], posts: str = "posts") -> DataFrame:
    """Rows ``(dimension, group, emoji, n)`` of feeds or what ``emoji_lists`` made of them. Emojis are counted per trait combination first, then by dimension."""
    lists = feeds if "emoji_list" in feeds.columns else emoji_lists(feeds, posts)
    found = lists.select(*dimensions, F.explode("emoji_list").alias("emoji"))
    few = found.groupBy(*dimensions, "emoji").agg(F.count("*").alias("n"))
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("group")) for d in dimensions])
    return few.select("emoji", "n", F.inline(dims)).groupBy("dimension", "group", "emoji").agg(F.sum("n").alias("n"))


def top_n(frequencies: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent items of each group, ties by item; Spark cuts each task's candidates before the shuffle."""
    order = Window.partitionBy("dimension", "group").orderBy(F.desc("n"), F.asc("emoji"))
    return frequencies.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
