"""Per-entity feature counts: one row per feed, no shuffle. Every statistic reads this table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedprofile.functions import text

COUNTS = text.COUNTED
#: Labels are broadcast up to this number, some 10 MB.
BROADCAST_LABELS = 250_000


def entity_counts(feeds: DataFrame, posts: str = "posts") -> DataFrame:
    """Add the COUNTS of an array of posts. Entities without posts stay, with zeros."""
    rows = feeds.withColumn("_counts", text.post_counts(F.col(posts))).drop(posts)
    return rows.withColumns({c: F.col("_counts")[c] for c in COUNTS}).drop("_counts")


def few(labels: DataFrame) -> bool:
    """Whether labels are counted to be few enough for a broadcast."""
    return labels.count() <= BROADCAST_LABELS


def labelled(feeds: DataFrame, labels: DataFrame, key: str = "id", work: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Feeds that have a label, with their traits, after ``work``, which takes features of each feed and drops its texts.

    Few labels are broadcast before the work, so that only labelled feeds cost any. Where there are more, the work goes
    first and its features are joined, so that no text is shuffled. ``work`` goes row by row and leaves ``key`` alone, so
    rows are the same either way; an id with several labels comes once for each. Without ``work`` feeds are joined as
    they are.
    """
    if work is None:
        return feeds.join(labels, key, "inner")
    if few(labels):
        return work(feeds.join(F.broadcast(labels), key))
    return work(feeds).join(labels, key)


def unlabelled(feeds: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    return feeds.join(labels, key, "left_anti")


def rates(entities: DataFrame) -> DataFrame:
    """Emojis, hashtags and links per post of each entity with posts."""
    some = entities.where("posts > 0")
    return some.withColumns({f"{c}_per_post": F.col(c) / F.col("posts") for c in ("emojis", "hashtags", "links")})
