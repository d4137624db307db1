"""The driver's tables as feeds, labels, predictions and truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedprofile.functions.traits import age_band
from feedprofile.sources.feeds import spread

DIMENSIONS = ("quality", "source", "age_band")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def birthyear() -> Column:
    return (F.lit(1940) + F.col("n_chars") % 70).cast("int")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as persons with traits; ``posts`` are the lines, decorated so that every text feature occurs."""
    docs = spread(table(spark, sf_dir, "documents"))
    lang, source, doc = F.col("lang"), F.col("source"), F.col("doc_id").cast("string")

    def decorated(post: Column, i: Column) -> Column:
        none = F.lit("")
        return F.concat(
            post,
            F.when(i % 3 == 0, F.concat(F.lit(" #"), lang, i.cast("string"))).otherwise(none),
            F.when(i % 4 == 1, F.concat(F.lit(" http://x.io/"), source)).otherwise(none),
            F.when(i % 5 == 2, F.lit(" \U0001f44d\U0001f3fd❤️")).when(i % 7 == 3, F.lit(" \U0001f1e9\U0001f1ea")).otherwise(none),
            F.when(i % 3 == 1, F.concat(F.lit(" @u"), doc, F.lit(" hi"))).otherwise(none),
            F.when(i % 4 == 2, F.lit(" 10:30 x")).otherwise(none),
            F.when(i % 5 == 4, F.lit(" :) y")).otherwise(none),
            F.when(i % 4 == 3, F.lit(" http://x.io/a z")).otherwise(none),
        )

    return docs.select(
        F.col("doc_id").alias("id"), "lang", "source", birthyear().alias("birthyear"),
        F.transform(F.split("text", "\n"), decorated).alias("posts"),
    ).withColumn("age_band", age_band(F.col("birthyear")))


def conversations(spark: SparkSession, sf_dir: str, most_posts: int = 10_000) -> DataFrame:
    """Conversations as nested feeds: roles are members, their turns are posts, of which a member has ``most_posts`` at most."""
    order = Window.partitionBy("conv_id", "role").orderBy("turn", "text")
    turns = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(order)).where(F.col("k") <= most_posts)
    members = turns.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    nested = members.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("role", F.transform("t", lambda x: x["text"]).alias("posts")))).alias("m"))
    return nested.select(F.col("conv_id").alias("id"), F.transform("m", lambda x: x["posts"]).alias("text"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with some traits flipped, beside the unflipped truth."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars", birthyear().alias("true_birthyear"))
    rows = docs.join(labels(spark, sf_dir), "id")
    flip = lambda c, n: F.when(F.col("n_chars") % n == 0, 1 - F.col(c)).otherwise(F.col(c))
    return rows.select(
        "id", "n_chars", F.col("quality").alias("true_quality"), flip("quality", 4).alias("pred_quality"), F.col("toxic").alias("true_toxic"), flip("toxic", 5).alias("pred_toxic"),
        "true_birthyear", (F.col("true_birthyear") + F.col("id") % 9 - 4).cast("int").alias("pred_birthyear"),
    )
