"""Statistics of a growing folder of feeds and labels in which a later line of an id replaces the earlier one.

State holds, for each id, its last counters and its last traits. When either comes again, the id's former part of the
statistics is taken back and the new one added; an id counts once it has both. Each micro-batch is written under its own
number, so that a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from feedprofile.functions.text import posts_of
from feedprofile.operators.entity import COUNTS, entity_counts
from feedprofile.operators.stats import profile_stats
from feedprofile.sources.feeds import LABELS, MEMBER_FEED

_STATE = "feed_at string, counts array<bigint>, label_at string, traits array<string>"


def _numbered(batches) -> Iterator[pa.RecordBatch]:
    """Number the rows of a task; a task reads a block of a file in order."""
    n = 0
    for batch in batches:
        yield batch.append_column("row", pa.array(range(n, n + batch.num_rows), pa.int64()))
        n += batch.num_rows


def _in_order(lines: DataFrame) -> DataFrame:
    """``lines`` with ``at``, which grows with the file's time, its name and the line; ids that are null go."""
    meta = "_metadata"
    at = [F.lpad(F.unix_micros(F.col(f"{meta}.file_modification_time")).cast("string"), 20, "0"), F.col(f"{meta}.file_path"), F.lpad(F.col(f"{meta}.file_block_start").cast("string"), 20, "0")]
    placed = lines.select("*", F.concat_ws("\t", *at).alias("file")).where("id IS NOT NULL")
    numbered = placed.mapInArrow(_numbered, StructType([*placed.schema.fields, StructField("row", LongType())]))
    return numbered.withColumn("at", F.concat_ws("\t", "file", F.lpad(F.col("row").cast("string"), 20, "0"))).drop("file", "row")


def stream_counts(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of counters, ``(id, at, counts)``, of the feeds in a folder."""
    lines = _in_order(spark.readStream.schema(MEMBER_FEED).option("maxFilesPerTrigger", files_per_trigger).json(folder))
    counted = entity_counts(lines.select("id", "at", posts_of(F.col("text")).alias("posts")))
    return counted.select("id", "at", F.array(*COUNTS).alias("counts"))


def stream_traits(spark: SparkSession, folder: str, traits: Sequence[Column], files_per_trigger: int = 100) -> DataFrame:
    """A stream of traits, ``(id, at, traits)``, of the labels in a folder; ``traits`` are expressions over their columns."""
    lines = _in_order(spark.readStream.schema(LABELS).option("maxFilesPerTrigger", files_per_trigger).json(folder))
    typed = lines.withColumn("birthyear", F.expr("try_cast(birthyear as int)"))
    return typed.select("id", "at", F.array(*[t.cast("string") for t in traits]).alias("traits"))


class Replace(StatefulProcessor):
    """Signed parts of an id: the former one taken back, the new one added."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        feed_at, counts, label_at, traits = self.last.get() if self.last.exists() else (None, None, None, None)
        before = (traits, counts) if feed_at and label_at else None
        changed = False
        for batch in rows:
            for at, some, names in zip(batch["at"], batch["counts"], batch["traits"], strict=True):
                if some is not None and (feed_at is None or at > feed_at):
                    feed_at, counts, changed = at, [int(c) for c in some], True
                if names is not None and (label_at is None or at > label_at):
                    label_at, traits, changed = at, [None if pd.isna(n) else str(n) for n in names], True
        if changed:
            self.last.update((feed_at, counts, label_at, traits))
        after = (traits, counts) if feed_at and label_at else None
        parts = [(-1, *before)] if before else []
        parts += [(1, *after)] if after else []
        if before is None or after is None or [*map(list, before)] != [*map(list, after)]:
            for sign, names, numbers in parts:
                yield pd.DataFrame({"sign": [sign], "traits": [list(names)], "counts": [list(numbers)]})

    def close(self) -> None:
        pass


def signed_parts(counts: DataFrame, traits: DataFrame) -> DataFrame:
    """A stream of ``(sign, traits, counts)`` whose signed sums are those of the ids' last lines."""
    both = counts.withColumn("traits", F.lit(None).cast("array<string>")).unionByName(traits.withColumn("counts", F.lit(None).cast("array<bigint>")))
    schema = StructType([StructField("sign", IntegerType()), StructField("traits", ArrayType(StringType())), StructField("counts", ArrayType(LongType()))])
    return both.groupBy("id").transformWithStateInPandas(Replace(), schema, "append", "none")


def _summed(parts: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    rows = parts.select("sign", *[F.col("traits")[k].alias(d) for k, d in enumerate(dimensions)], *[F.col("counts")[k].alias(c) for k, c in enumerate(COUNTS)])
    sums = {"signed": F.sum("sign"), **{c: F.sum(F.col("sign") * F.col(c)) for c in COUNTS}}
    return profile_stats(rows, dimensions, sums).drop("entities").withColumnRenamed("signed", "entities")


def run_available(parts: DataFrame, dimensions: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Work off what is there; ``path`` gets a few rows for each batch, whose sums ``totals`` are. Needs the RocksDB state store."""

    def write(batch: DataFrame, number: int) -> None:
        _summed(batch, dimensions).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return parts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Statistics as of the last batch: ``(dimension, group, entities, counters...)``; groups that all ids have left are gone."""
    rows = spark.read.parquet(path)
    return rows.groupBy("dimension", "group").agg(*[F.sum(c).alias(c) for c in ("entities", *COUNTS)]).where("entities > 0")
