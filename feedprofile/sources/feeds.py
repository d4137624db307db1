"""Sources: labels, feeds, predictions, previews, and the catalogue of a data set's splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The birth year may be a number or a numeric string on disk, so it is read as a string and cast.
LABELS = "id long, gender string, occupation string, birthyear string"
MEMBER_FEED = "id long, text array<array<string>>"
OWN_FEED = "id long, text array<string>"
SPLITS = ("train", "supplement", "test")
FILES = {"labels": "labels.ndjson", "members": "follower-feeds.ndjson", "own": "celebrity-feeds.ndjson"}
PREDICTION_KEYS = ("birthyear", "gender", "id", "occupation")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all cores, where their files give fewer tasks than there are cores; large tables stay as they are.

    A file of one row group is one task, which would leave the other cores idle throughout the text work.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Column of the place of a row in what was loaded.
LOADED = "_loaded"


def in_load_order(spark: SparkSession, paths: str | Sequence[str], read: Callable[[str], DataFrame]) -> DataFrame:
    """The rows that ``read`` makes of each path with their place, LOADED: path as listed, file by name, then line by line.

    Tasks number their own lines as they read: a task reads a block of a file in order, and Spark's row numbers grow
    within a task, so block start and row number order a file without any sort or count.
    """
    parts = []
    for k, path in enumerate([paths] if isinstance(paths, str) else paths):
        place = F.struct(F.lit(k).alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        parts.append(read(path).select("*", place.alias(LOADED)))
    return reduce(DataFrame.unionByName, parts)


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row for each key: the one with the greatest ``position``; null is the least, and rows of one position are told apart by value.

    One aggregate: each task keeps its last row of a key, so that no key is gathered or sorted anywhere, however often it occurs.
    """
    others = [c for c in rows.columns if c != key]
    place = F.struct(F.col(position), F.xxhash64(*others))
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), place).alias("_last"))
    return last.select(*[F.col(key) if c == key else F.col("_last")[c].alias(c) for c in rows.columns])


def _records(spark: SparkSession, path: str | Sequence[str], schema: str, repeated: str) -> DataFrame:
    """JSON lines; of a repeated id the last line stays (``repeated`` is "last") or all do ("all"). Rows without id all stay."""
    if repeated not in ("last", "all"):
        raise ValueError(f"repeated must be 'last' or 'all', not {repeated!r}")
    rows = in_load_order(spark, path, lambda p: spark.read.schema(schema).json(p))
    if repeated == "last":
        rows = last_wins(rows.where("id IS NOT NULL"), "id", LOADED).unionByName(rows.where("id IS NULL"))
    return rows.drop(LOADED)


def read_labels(spark: SparkSession, path: str | Sequence[str], repeated: str = "last") -> DataFrame:
    """Typed labels; blank lines are skipped, a birth year that is no number is null, the last line of an id wins."""
    return _records(spark, path, LABELS, repeated).withColumn("birthyear", F.expr("try_cast(birthyear as int)"))


def read_predictions(spark: SparkSession, path: str | Sequence[str], repeated: str = "last") -> DataFrame:
    """Predictions or their truth, ``(id, birthyear, gender, occupation, record)``; the last line of an id wins. ``record`` is the line as it stands."""
    lines = in_load_order(spark, path, lambda p: spark.read.text(p)).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", LABELS).alias("r"), F.col("value").alias("record"), LOADED).select("r.*", "record", LOADED)
    if repeated == "last":
        rows = last_wins(rows.where("id IS NOT NULL"), "id", LOADED)
    elif repeated != "all":
        raise ValueError(f"repeated must be 'last' or 'all', not {repeated!r}")
    return rows.select("id", F.expr("try_cast(birthyear as int)").alias("birthyear"), "gender", "occupation", "record")


def read_gender(spark: SparkSession, path: str) -> DataFrame:
    return read_labels(spark, path).select("id", "gender")


def read_trait_frame(spark: SparkSession, path: str) -> DataFrame:
    """Gender, ``age`` (which holds the birth year) and occupation of every line; missing ones are null."""
    return read_labels(spark, path, "all").select("gender", F.col("birthyear").alias("age"), "occupation")


def read_feeds(spark: SparkSession, path: str, feed: str = "members") -> DataFrame:
    """Nested posts ``(id, text)``; an own feed is lifted to one member. ``feed`` is "members" or "own"."""
    if feed == "members":
        return spark.read.schema(MEMBER_FEED).json(path)
    if feed == "own":
        return spark.read.schema(OWN_FEED).json(path).withColumn("text", F.array("text"))
    raise ValueError(f"feed must be 'members' or 'own', not {feed!r}")


def dataset(spark: SparkSession, root: str, splits: Sequence[str] = ("train", "test"), feed: str = "members") -> tuple[DataFrame, DataFrame]:
    """Labels and feeds of some splits, each with a ``split`` column."""
    labels = feeds = None
    for split in splits:
        if split not in SPLITS:
            raise ValueError(f"unknown split {split!r}")
        one = read_labels(spark, f"{root}/{split}/{FILES['labels']}").withColumn("split", F.lit(split))
        two = read_feeds(spark, f"{root}/{split}/{FILES[feed]}", feed).withColumn("split", F.lit(split))
        labels = one if labels is None else labels.unionByName(one)
        feeds = two if feeds is None else feeds.unionByName(two)
    return labels, feeds


def preview(spark: SparkSession, path: str, schema: str, most: int = 100) -> DataFrame:
    """The first lines as JSON, or as they stand where they don't parse."""
    lines = spark.read.text(path).limit(most)
    parsed = F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.withColumn("r", parsed).select(F.when(F.col("r._corrupt_record").isNull() & F.col("r").isNotNull(), F.to_json("r")).otherwise(F.col("value")).alias("record"))


def preview_rows(rows: DataFrame, key: str, most: int = 100) -> DataFrame:
    """The first rows by a key, as compact JSON."""
    return rows.orderBy(key).limit(most).select(F.col(key), F.to_json(F.struct("*")).alias("record"))
