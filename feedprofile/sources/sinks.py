"""Sinks: top-N reports, predictions, metrics and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedprofile.sources.committed import write_lines


def top_report(groups: DataFrame, top: DataFrame, keys: tuple[str, str] = ("dimension", "group")) -> DataFrame:
    """One text block for each group, groups without items included: ``[group]``, then ``item TAB count`` in rank order."""
    lines = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", F.format_string("%s\t%d", F.col("emoji"), F.col("n")).alias("line")))).alias("ls"))
    body = F.coalesce(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("No emojis found."))
    return groups.select(*keys).distinct().join(lines, list(keys), "left").select(*keys, F.concat(F.lit("["), F.col(keys[1]), F.lit("]\n"), body, F.lit("\n")).alias("value"))


def write_top_report(report: DataFrame, path: str) -> None:
    report.select("value").write.mode("overwrite").text(path)


def write_predictions(predictions: DataFrame, path: str, run: str | None = None) -> None:
    """Predictions as JSON lines in place of what ``path`` holds, or as a ``run`` of a committed sink."""
    rows = predictions.select("id", "birthyear", "gender", "occupation")
    if run is None:
        rows.write.mode("overwrite").json(path)
    else:
        write_lines(rows.select(F.to_json(F.struct("*")).alias("value")), path, run)


def metric_lines(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.format_string('measure{\n  key: "%s"\n  value: "%s"\n}', F.col("key"), F.col("value").cast("string")).alias("value"))


def append_metrics(metrics: DataFrame, path: str, run: str | None = None) -> str:
    """Add metric lines to ``path`` as a run, whose name is returned; written again under its name, a run is replaced and not doubled."""
    return write_lines(metric_lines(metrics).coalesce(1), path, run)  # a row for each metric


def write_table(table: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    table.write.mode("overwrite").partitionBy(*partition_by or []).parquet(path)
