import json

import pytest
from pyspark.sql import functions as F

from feedprofile.functions import traits
from feedprofile.functions.text import posts_of
from feedprofile.operators import distributions, entity, ranking, stats
from feedprofile.sources import feeds, sinks

LABELS = [{"id": 1, "gender": "male", "occupation": "sports", "birthyear": 1985}, {"id": 2, "gender": "female", "occupation": "creator", "birthyear": "1999"},
          {"id": 3, "gender": "female", "occupation": "politics", "birthyear": 1950}, {"id": 4, "gender": "male", "occupation": "performer", "birthyear": 2005}]
FEEDS = [{"id": 1, "text": [["I love the #Goal https://t.co/a1", "You and my dog 👍🏽👍🏽"], ["it’s all"]]}, {"id": 2, "text": [["no signals here"]]},
         {"id": 3, "text": [[], []]}, {"id": 9, "text": [["dropped #x"]]}]


@pytest.fixture
def root(tmp_path):
    for split, rows in (("train", FEEDS), ("test", FEEDS[:1])):
        (tmp_path / split).mkdir()
        (tmp_path / split / "labels.ndjson").write_text("\n \n".join(json.dumps(x) for x in LABELS) + "\n")
        (tmp_path / split / "follower-feeds.ndjson").write_text("\n".join(json.dumps(x) for x in rows))
        (tmp_path / split / "celebrity-feeds.ndjson").write_text(json.dumps({"id": 1, "text": ["a", "b"]}))
    return str(tmp_path)


@pytest.fixture
def entities(spark, root):
    labels = feeds.read_labels(spark, f"{root}/train/labels.ndjson").withColumn("age_band", traits.age_band(F.col("birthyear")))
    rows = feeds.read_feeds(spark, f"{root}/train/follower-feeds.ndjson").select("id", posts_of(F.col("text")).alias("posts"))
    return entity.entity_counts(entity.labelled(rows, labels))


def test_entity_counts(entities):
    got = {r["id"]: tuple(r[c] for c in entity.COUNTS) + (r["age_band"],) for r in entities.collect()}
    assert got == {1: (3, 4, 3, 1, 1, 2, 1, 1, 1, "30-39"), 2: (1, 0, 0, 0, 0, 0, 0, 0, 0, "20-29"), 3: (0, 0, 0, 0, 0, 0, 0, 0, 0, "50+")}


def test_stats_keep_entities_without_posts(entities):
    got = {(r["dimension"], r["group"]): (r["entities"], r["posts"]) for r in stats.profile_stats(entities, ("gender", "age_band"), entity.COUNTS).collect()}
    assert got[("gender", "female")] == (2, 1) and got[("gender", "male")] == (1, 3) and got[("age_band", "50+")] == (1, 0)
    sums = stats.profile_stats(entities, ("age_band",), entity.COUNTS)
    assert {r["group"] for r in stats.with_ratios(sums, {"r": ("emojis", "posts")}).collect()} == {"30-39", "20-29"}
    assert {r["group"]: r["emojis_per_post"] for r in stats.summary(sums).collect()}["50+"] == 0.0
    assert not stats.chart_table(sums, {"x": ("emojis", "posts")}).where(F.col("group") == "50+").count()


@pytest.mark.parametrize("most", [250_000, 0])
def test_labels_are_joined_with_features(spark, monkeypatch, most):
    """Rows are the same whether labels are few or many, and no text is shuffled where they are many."""
    monkeypatch.setattr(entity, "BROADCAST_LABELS", most)
    rows = spark.createDataFrame([(1, ["i #a \U0001f600", None], 5), (1, ["she"], 6), (2, None, 7), (3, [], 8), (None, ["you"], 9)], "id long, posts array<string>, gender_hint int")
    labels = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (4, "x"), (None, "z")], "id long, gender string")
    plain = entity.entity_counts(entity.labelled(rows, labels))
    got = entity.labelled(rows, labels, work=entity.entity_counts).select(plain.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect())) and got.count() == 5
    lists = entity.labelled(rows, labels, work=ranking.emoji_lists)
    assert sorted(map(repr, ranking.emoji_frequencies(lists, ("gender",)).collect())) == sorted(map(repr, ranking.emoji_frequencies(entity.labelled(rows, labels), ("gender",)).collect()))
    assert entity.labelled(rows, labels.where("id > 9"), work=entity.entity_counts).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = entity.labelled(rows, labels, work=ranking.emoji_lists)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [node for node in plan.split("\n\n") if ") Exchange\n" in node]
    assert not any("posts#" in node for node in moved) and len(moved) == (0 if most else 2)


def test_merge_equals_union(entities):
    whole = stats.profile_stats(entities, ("gender",), entity.COUNTS)
    parts = stats.merge_stats(*[stats.profile_stats(entities.where(F.col("id") % 2 == k), ("gender",), entity.COUNTS) for k in (0, 1)])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.select(*whole.columns).collect()))


def test_top_emojis_and_report(spark, root, tmp_path):
    labels = feeds.read_labels(spark, f"{root}/train/labels.ndjson")
    rows = feeds.read_feeds(spark, f"{root}/train/follower-feeds.ndjson").select("id", posts_of(F.col("text")).alias("posts"))
    people = entity.labelled(rows, labels)
    top = ranking.top_n(ranking.emoji_frequencies(people, ("gender",)), 10)
    assert [(r["group"], r["emoji"], r["n"], r["rank"]) for r in top.collect()] == [("male", "👍🏽", 2, 1)]
    groups = stats.profile_stats(people.withColumn("one", F.lit(1)), ("gender",), ("one",))
    report = sinks.top_report(groups, top)
    assert {r["group"]: r["value"] for r in report.collect()} == {"male": "[male]\n👍🏽\t2\n", "female": "[female]\nNo emojis found.\n"}
    sinks.write_top_report(report, str(tmp_path / "top"))


def test_splits_and_modes(spark, root):
    labels, rows = feeds.dataset(spark, root)
    assert rows.groupBy("split").count().orderBy("split").collect() == [("test", 1), ("train", 4)]
    assert labels.count() == 8
    assert feeds.read_feeds(spark, f"{root}/train/celebrity-feeds.ndjson", "own").first()["text"] == [["a", "b"]]
    with pytest.raises(ValueError):
        feeds.read_feeds(spark, root, "other")
    with pytest.raises(ValueError):
        feeds.dataset(spark, root, ("dev",))


def test_preview_shows_bad_lines(spark, tmp_path):
    path = tmp_path / "x.ndjson"
    path.write_text('{"id":1,"gender":"male"}\n{bad json\n')
    got = [r["record"] for r in feeds.preview(spark, str(path), feeds.LABELS).collect()]
    assert json.loads(got[0]) == {"id": 1, "gender": "male"} and got[1] == "{bad json"


def test_last_label_wins(spark):
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 2)], "id long, v string, pos long")
    assert sorted((r["id"], r["v"]) for r in feeds.last_wins(rows, "id", "pos").collect()) == [(1, "b"), (2, "c")]


def test_trait_classes(spark):
    years = [2001, 2000, 1991, 1990, 1981, 1980, 1971, 1970, None]
    got = [r[0] for r in spark.createDataFrame([(y,) for y in years], "y int").select(traits.age_band(F.col("y"))).collect()]
    assert got == ["<20", "20-29", "20-29", "30-39", "30-39", "40-49", "40-49", "50+", None]
    years = [1939, 1940, 1955, 1956, 1969, 1970, 1980, 1981, 1989, 1990, 1999, 2000]
    got = [r[0] for r in spark.createDataFrame([(y,) for y in years], "y int").select(traits.birthyear_class(F.col("y"))).collect()]
    assert got == [None, 1947, 1947, 1963, 1963, 1975, 1975, 1985, 1985, 1994, 1994, None]
    bands = spark.createDataFrame([("x",), ("50+",), ("<20",), ("20-29",)], "g string")
    assert [r["g"] for r in bands.orderBy(traits.band_order(F.col("g")), "g").collect()] == ["<20", "20-29", "50+", "x"]


def test_box_stats(spark):
    rows = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 100)] + [("h", float(v)) for v in (1, 2, 4, 8, 16, 3.5)], "d string, v double")
    got = {r["group"]: r for r in distributions.box_stats(rows, ("d",), ("v",)).collect()}
    assert tuple(got["g"][c] for c in ("q1", "med", "q3", "whisker_lo", "whisker_hi", "n_outliers")) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)
    assert tuple(got["h"][c] for c in ("q1", "med", "q3")) == (2.375, 3.75, 7.0)
    assert {r["group"]: r["n"] for r in distributions.box_stats(rows, ("d",), ("v",), exact=False).collect()} == {"g": 5, "h": 6}


def test_streamed_stats_equal_batch(spark, root, tmp_path):
    from feedprofile.streaming import incremental

    labels = feeds.read_labels(spark, f"{root}/train/labels.ndjson")
    folder = tmp_path / "in"
    folder.mkdir()
    for k, row in enumerate(FEEDS):
        (folder / f"{k}.json").write_text(json.dumps(row))
    streamed = incremental.streaming_stats(incremental.stream_feeds(spark, str(folder), 1), labels, ("gender",))
    incremental.run_available(streamed, "stats_now", str(tmp_path / "cp")).awaitTermination(120)
    rows = feeds.read_feeds(spark, str(folder)).select("id", posts_of(F.col("text")).alias("posts"))
    batch = stats.profile_stats(entity.entity_counts(entity.labelled(rows, labels)), ("gender",), entity.COUNTS)
    assert sorted(map(tuple, spark.table("stats_now").collect())) == sorted(map(tuple, batch.collect()))
