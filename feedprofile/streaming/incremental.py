"""Statistics kept up to date over a growing folder of feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedprofile.functions.text import posts_of
from feedprofile.operators.entity import COUNTS, entity_counts, labelled
from feedprofile.operators.stats import profile_stats
from feedprofile.sources.feeds import MEMBER_FEED
from feedprofile.sources.shared import kept


def stream_feeds(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(MEMBER_FEED).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def streaming_stats(feeds: DataFrame, labels: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Grouped sums of a stream of feeds; state is one row for each group. Labels are read once, as the stream is set up."""
    posts = feeds.select("id", posts_of(F.col("text")).alias("posts"))
    return profile_stats(entity_counts(labelled(posts, kept(labels))), dimensions, COUNTS)


def run_available(stats: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Work off what is there and keep the totals in a table in memory (one row for each group)."""
    return stats.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
