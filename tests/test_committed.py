"""Runs of lines are published as a whole, or not at all."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from feedprofile.sources import committed, feeds, sinks
from feedprofile.sources.committed import LineWriter, read_lines, write_lines


def lines(spark, n, tag):
    return spark.range(n).repartition(4).select(F.concat(F.lit(f"{tag}-"), F.col("id").cast("string")).alias("value"))


def found(spark, path):
    return sorted((r["run"], r["value"]) for r in read_lines(spark, path).collect())


def test_a_rerun_replaces_and_another_run_adds(spark, tmp_path):
    path = str(tmp_path / "out")
    assert found(spark, path) == []
    for _ in range(2):
        assert write_lines(lines(spark, 30, "a"), path, "one") == "one"
    assert found(spark, path) == sorted(("one", f"a-{k}") for k in range(30))
    write_lines(lines(spark, 5, "b"), path, "two")
    write_lines(lines(spark, 3, "c"), path, "one")
    assert found(spark, path) == sorted([("two", f"b-{k}") for k in range(5)] + [("one", f"c-{k}") for k in range(3)])
    assert len([p for p in (tmp_path / "out" / "run=one").iterdir() if p.name.startswith("part-")]) <= 4
    write_lines(lines(spark, 0, "d"), path, "two")
    assert {r for r, _ in found(spark, path)} == {"one"}


def test_a_failed_write_leaves_the_former_lines(spark, tmp_path):
    path = str(tmp_path / "out")
    write_lines(lines(spark, 8, "a"), path, "one")
    broken = lines(spark, 40, "b").withColumn("value", F.when(F.col("value") == "b-39", F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(PySparkException):
        write_lines(broken, path, "one")
    assert found(spark, path) == sorted(("one", f"a-{k}") for k in range(8))
    write_lines(lines(spark, 2, "b"), path, "one")
    assert found(spark, path) == [("one", "b-0"), ("one", "b-1")]


def test_pieces_of_lost_attempts_are_never_read(spark, tmp_path):
    """A task may write twice: killed after its piece, or run speculatively. Only the piece that it reports counts."""
    path = str(tmp_path / "out")
    writer = LineWriter(path, "one")
    rows = spark.createDataFrame([("x",), (None,), ("y",)], "value string").collect()
    writer.write(iter(rows))
    kept = writer.write(iter(rows))
    assert found(spark, path) == []  # nothing is published yet
    writer.commit([kept, None])
    assert found(spark, path) == [("one", ""), ("one", "x"), ("one", "y")]
    later = writer.write(iter(rows))
    writer.abort([later, None])
    assert found(spark, path) == [("one", ""), ("one", "x"), ("one", "y")]
    assert sorted(p.name for p in (tmp_path / "out" / "run=one").iterdir()) == ["_manifest.json", kept.name]


def test_long_pieces_and_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(committed, "HELD_BYTES", 10)
    path = f"file://{tmp_path}/out"
    write_lines(lines(spark, 200, "é"), path, "r.1-x_y")
    assert found(spark, path) == sorted(("r.1-x_y", f"é-{k}") for k in range(200))
    with pytest.raises(PySparkException):
        write_lines(lines(spark, 1, "a"), path, "../up")


def test_metrics_and_predictions(spark, tmp_path):
    metrics = spark.createDataFrame([("c_rank", 0.5), ("f1_age", 1.0)], "key string, value double")
    for _ in range(2):
        sinks.append_metrics(metrics, str(tmp_path / "m"), "night-1")
    assert [r["value"] for r in read_lines(spark, str(tmp_path / "m")).collect()].count("measure{") == 2
    sinks.append_metrics(metrics, str(tmp_path / "m"))
    assert [r["value"] for r in read_lines(spark, str(tmp_path / "m")).collect()].count("measure{") == 4
    rows = spark.createDataFrame([(1, 1950, "f", "sports"), (2, None, "m", None)], "id long, birthyear int, gender string, occupation string")
    for _ in range(2):
        sinks.write_predictions(rows, str(tmp_path / "p"), "run1")
    again = feeds.read_predictions(spark, str(tmp_path / "p" / "run=run1"), "all")
    assert sorted((r["id"], r["birthyear"], r["gender"]) for r in again.collect()) == [(1, 1950, "f"), (2, None, "m")]
