"""Of a repeated id the last line loaded wins, whatever tasks read the lines."""

import json

import pytest
from pyspark.sql import functions as F

from feedprofile.operators import evaluate
from feedprofile.operators.model import profile
from feedprofile.sources import feeds


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_last_line_wins_across_blocks_and_files(spark, tmp_path, small_blocks):
    one = [{"id": k % 97, "gender": f"g{k}", "birthyear": str(1940 + k % 60)} for k in range(600)]
    two = [{"id": k % 50 + 90, "gender": f"h{k}", "birthyear": None if k % 2 else 1950} for k in range(200)]
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "b.ndjson", two)
    write(tmp_path / "d" / "a.ndjson", one)
    assert spark.read.text(str(tmp_path / "d")).rdd.getNumPartitions() > 8

    def want(rows):
        return {r["id"]: (r["gender"], None if r["birthyear"] is None else int(r["birthyear"])) for r in rows}

    def got(rows):
        out = [(r["id"], (r["gender"], r["birthyear"])) for r in rows.collect()]
        assert len(out) == len(dict(out))
        return dict(out)

    assert got(feeds.read_labels(spark, str(tmp_path / "d"))) == want(one + two)
    # paths in the order that the caller gives
    paths = [str(tmp_path / "d" / "b.ndjson"), str(tmp_path / "d" / "a.ndjson")]
    assert got(feeds.read_labels(spark, paths)) == want(two + one)
    assert {r["id"]: r["gender"] for r in feeds.read_gender(spark, paths).collect()} == {k: g for k, (g, _) in want(two + one).items()}
    assert feeds.read_labels(spark, paths, "all").count() == 800 and feeds.read_trait_frame(spark, paths).count() == 800
    with pytest.raises(ValueError):
        feeds.read_labels(spark, paths, "first")


def test_rows_without_id_stay_and_the_whole_record_counts(spark, tmp_path):
    path = write(tmp_path / "l", [{"id": 1, "gender": "a", "occupation": "x"}, {"gender": "b"}, {"gender": "c"}, {"id": 1, "gender": None}, {"id": 2, "gender": "d"}])
    rows = sorted(((r["id"], r["gender"], r["occupation"]) for r in feeds.read_labels(spark, path).collect()), key=str)
    assert rows == [(1, None, None), (2, "d", None), (None, "b", None), (None, "c", None)]


def test_last_wins_by_position(spark):
    rows = spark.createDataFrame([(1, "a", 3), (1, "b", None), (1, "c", 2), (2, "d", None), (None, "e", 1), (None, "f", 0), (3, "g", 5), (3, "g", 5)], "id long, v string, pos long")
    assert sorted(map(tuple, feeds.last_wins(rows, "id", "pos").collect()), key=str) == [(1, "a", 3), (2, "d", None), (3, "g", 5), (None, "e", 1)]
    assert "Window" not in feeds.last_wins(rows, "id", "pos")._jdf.queryExecution().toString()
    tied = spark.createDataFrame([(1, "x", 0), (1, "y", 0)], "id long, v string, pos long")
    assert len({feeds.last_wins(t, "id", "pos").first()["v"] for t in (tied, tied.orderBy(F.desc("v")))}) == 1


def test_predictions_and_truth(spark, tmp_path):
    guesses = write(tmp_path / "p", [{"id": 1, "gender": "m", "birthyear": "1950"}, {"id": 2, "gender": "f"}, {"id": 1, "gender": "f", "extra": 1}])
    truth = write(tmp_path / "t", [{"id": 1, "gender": "m"}, {"id": 2, "gender": "m"}, {"id": 2, "gender": "f"}, {"id": 1, "gender": "f"}])
    p, t = feeds.read_predictions(spark, guesses), feeds.read_predictions(spark, truth)
    assert {r["id"]: (r["gender"], r["birthyear"], json.loads(r["record"])) for r in p.collect()} == {1: ("f", None, {"id": 1, "gender": "f", "extra": 1}), 2: ("f", None, {"id": 2, "gender": "f"})}
    pairs = evaluate.join_truth(p.select("id", F.col("gender").alias("p")), t.select("id", F.col("gender").alias("t")), strict=True)
    assert {tuple(r) for r in pairs.collect()} == {(1, "f", "f"), (2, "f", "f")}
    one = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "id long, p string, at long")
    two = spark.createDataFrame([(1, "c", 5), (1, "d", 4)], "id long, t string, at long")
    assert [tuple(r) for r in evaluate.join_truth(one, two, position="at").collect()] == [(1, "b", "c")]


def test_profile_counts_each_id_once(spark, tmp_path):
    """A label given twice must not weigh twice, and its last value is the one that is learned."""
    people = [(k, ("male", "female")[k % 2]) for k in range(40)]
    first = [{"id": k, "gender": ("female", "male")[k % 2], "occupation": "sports", "birthyear": 1950} for k, _ in people]
    last = [{"id": k, "gender": g, "occupation": ("sports", "creator")[k % 2], "birthyear": 1950 + 35 * (k % 2)} for k, g in people]
    labels = feeds.read_labels(spark, write(tmp_path / "l", first + last))
    posts = spark.createDataFrame([(k, [[f"{g} word talk", f"{g} again"]]) for k, g in people], "id long, text array<array<string>>")
    learned, predicted = profile(labels, posts, posts, max_iter=20)
    assert labels.count() == 40 and predicted.count() == 40
    assert {r["id"]: r["gender"] for r in predicted.collect()} == dict(people)
    assert learned.traits["occupation"][1] == ["creator", "sports"]
