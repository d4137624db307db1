"""JSON records of unknown shape: read as variants, their keys and types counted, their common schema found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a type is called, by the beginning of its name; any other is a number.
_KINDS = (("VOID", "null"), ("BOOLEAN", "boolean"), ("STRING", "string"), ("OBJECT", "object"), ("ARRAY", "array"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Lines as ``(line, record)``; ``record`` is a variant, null for a line that does not start with JSON (what stands behind a value is ignored). Blank lines are skipped."""
    return parsed(spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line")))


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.withColumn("record", F.try_parse_json(line))


def kind(value: Column) -> Column:
    """null, boolean, string, object, array or number."""
    name = F.schema_of_variant(value)
    out = F.lit("number")
    for start, what in reversed(_KINDS):
        out = F.when(name.startswith(start), F.lit(what)).otherwise(out)
    return out


def key_types(records: DataFrame, depth: int = 4, record: str = "record") -> DataFrame:
    """Rows ``(path, type, n)``: how often each path of keys holds each type, arrays as ``[]``, down to ``depth`` steps.

    Values below are not opened. Records are opened where they lie; only counts by path and type are shuffled.
    """
    spark = records.sparkSession
    level = records.where(F.col(record).isNotNull()).select(F.lit("$").alias("path"), F.col(record).alias("v"))
    levels = [level.select("path", kind(F.col("v")).alias("type"))]
    for _ in range(depth):
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), F.lit("[]")).otherwise(F.concat(F.lit("."), F.col("key")))
        level = inner.select(F.concat("path", step).alias("path"), F.col("value").alias("v"))
        levels.append(level.select("path", kind(F.col("v")).alias("type")))
    return reduce(DataFrame.unionByName, levels).groupBy("path", "type").agg(F.count("*").alias("n"))


def common_schema(records: DataFrame, record: str = "record") -> str:
    """The schema that holds all records, in Spark's words; keys of mixed types are variants in it."""
    return records.agg(F.schema_of_variant_agg(record).alias("s")).first()["s"]


def field(path: str, kind: str, record: str = "record") -> Column:
    """A value by its path, ``$.a.b[0]``, cast to a type; null where it is missing or does not fit."""
    return F.try_variant_get(record, path, kind)


def with_other_keys(records: DataFrame, keys: tuple[str, ...], record: str = "record") -> DataFrame:
    """Records whose keys are not exactly ``keys``, whatever their values are; what is no object counts as such a record."""
    found = F.array_sort(F.map_keys(F.try_variant_get(record, "$", "map<string,variant>")))
    return records.where(~F.coalesce(found == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False)))
