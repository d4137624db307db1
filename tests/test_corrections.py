"""A stream with corrections equals the batch in which the last line of an id wins."""

import json
import os

import pytest
from pyspark.sql import functions as F

from feedprofile.functions import traits
from feedprofile.functions.text import posts_of
from feedprofile.operators import entity, stats
from feedprofile.sources import feeds
from feedprofile.streaming import corrections

DIMENSIONS = ("gender", "age_band")


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, old)


def put(folder, name, rows, time):
    path = folder / name
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(path, (time, time))


def batch(spark, folder, feeds_order, labels_order):
    labels = feeds.read_labels(spark, [str(folder / "labels" / n) for n in labels_order]).withColumn("age_band", traits.age_band(F.col("birthyear")))
    lines = feeds.in_load_order(spark, [str(folder / "feeds" / n) for n in feeds_order], lambda p: feeds.read_feeds(spark, p))
    last = feeds.last_wins(lines, "id", feeds.LOADED).select("id", posts_of(F.col("text")).alias("posts"))
    rows = stats.profile_stats(entity.entity_counts(entity.labelled(last, labels)), DIMENSIONS, entity.COUNTS)
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_corrections_equal_batch(spark, tmp_path, rocksdb):
    for name in ("feeds", "labels"):
        (tmp_path / name).mkdir()

    def run():
        counts = corrections.stream_counts(spark, str(tmp_path / "feeds"), 1)
        names = corrections.stream_traits(spark, str(tmp_path / "labels"), [F.col("gender"), traits.age_band(F.col("birthyear"))], 1)
        corrections.run_available(corrections.signed_parts(counts, names), DIMENSIONS, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        got = corrections.totals(spark, str(tmp_path / "out"))
        return sorted((tuple(r) for r in got.select("dimension", "group", "entities", *entity.COUNTS).collect()), key=str)

    put(tmp_path / "feeds", "z", [{"id": 1, "text": [["the #a", "b"]]}, {"id": 2, "text": [["you http://x.y"]]}, {"id": 1, "text": [["again the #x #y"]]}, {"id": 9, "text": [["no label"]]}], 1000)
    put(tmp_path / "labels", "z", [{"id": 1, "gender": "m", "birthyear": 1950}, {"id": 2, "gender": "f", "birthyear": "1990"}, {"id": 3, "gender": "f", "birthyear": 2004}, {"gender": "x"}], 1000)
    assert run() == batch(spark, tmp_path, ["z"], ["z"])
    # a label is corrected, a feed comes again, an unlabelled id gets its label, a trait becomes unknown
    put(tmp_path / "feeds", "a", [{"id": 2, "text": [["we", "all"]]}, {"id": 3, "text": [["new"]]}], 2000)
    put(tmp_path / "labels", "a", [{"id": 1, "gender": "f", "birthyear": 1950}, {"id": 9, "gender": "m"}, {"id": 1, "gender": None, "birthyear": 1971}], 2000)
    want = batch(spark, tmp_path, ["z", "a"], ["z", "a"])
    assert run() == want and ("gender", None) in {r[:2] for r in want}
    # the same lines once more change nothing
    put(tmp_path / "feeds", "b", [{"id": 2, "text": [["we", "all"]]}], 3000)
    assert run() == want
