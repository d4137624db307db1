import json

import pytest
from pyspark.sql import functions as F

from feedprofile.functions import text
from feedprofile.operators import distributions, evaluate, features
from feedprofile.operators.model import TRAITS, Profiler, fit_profiler, profile, register_preprocessor
from feedprofile.sources import feeds, sinks


def documents(spark):
    rows = [(k, ("ball goal team match " if k % 2 else "song stage music tune ") * (1 + k % 3) + f"filler{k % 4} word", "sports" if k % 2 else "performer", None if k % 5 == 0 else 1947 + k % 2) for k in range(40)]
    return spark.createDataFrame(rows, "id long, document string, occupation string, birthyear int")


def test_fit_predict_save_load(spark, tmp_path):
    docs = documents(spark)
    profiler = fit_profiler(docs, ("occupation", "birthyear"), max_iter=20)
    got = profiler.predict(docs).join(docs.select("id", F.col("occupation").alias("want")), "id")
    assert got.where("occupation <> want").count() == 0
    assert {r["birthyear"] for r in got.collect()} == {"1947", "1948"}
    profiler.save(str(tmp_path / "m"))
    again = Profiler.load(spark, str(tmp_path / "m")).predict(docs)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, profiler.predict(docs).collect()))


def test_tfidf_rows_have_length_one(spark):
    docs = documents(spark)
    words = features.word_table(docs)
    terms = features.vocabulary(words, 3, 50)
    assert terms.count() <= 50
    assert {r["term"]: (r["tf"], r["df"]) for r in terms.collect()}["ball goal"] == (sum(1 + k % 3 for k in range(1, 40, 2)), 20)
    lengths = features.tfidf(words, terms, 40).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s"))
    assert lengths.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0 and lengths.count() == 40


def test_vectors_equal_the_saved_features(spark):
    """Vectors are made in tasks from the words; they are those of the feature stages that a model saves."""
    docs = documents(spark)
    words = features.word_table(docs.unionByName(spark.createDataFrame([(90, "none of these", None, None), (91, "", None, None)], docs.schema)))
    stages = fit_profiler(docs, ("occupation",), max_iter=2).features
    got = features.vectors(words, stages.stages[0].vocabulary, stages.stages[1].getScalingVec(), ["id"])
    want = stages.transform(words.select("id", text.ngrams_of(F.col("words")).alias("terms")))
    plain = {r["id"]: dict(zip(r["features"].indices.tolist(), r["features"].values.tolist(), strict=True)) for r in want.collect()}
    found = {r["id"]: dict(zip(r["features"]["indices"], r["features"]["values"], strict=True)) for r in got.collect()}
    assert set(found) == set(plain) and all(found[k] == pytest.approx(plain[k]) for k in plain) and found[91] == {}


def test_a_model_keeps_its_preprocessor(spark, tmp_path):
    register_preprocessor("first_word", lambda d: F.substring_index(d, " ", 1))
    docs = documents(spark)
    profiler = fit_profiler(docs, ("occupation",), max_iter=5, preprocessor="first_word")
    assert set(profiler.features.stages[0].vocabulary) == {"ball", "song"}
    profiler.save(str(tmp_path / "m"))
    assert Profiler.load(spark, str(tmp_path / "m")).preprocessor == "first_word"
    with pytest.raises(ValueError):
        fit_profiler(docs, ("occupation",), preprocessor="unheard of")


def test_profile_from_files_to_scores(spark, tmp_path):
    """Feeds and labels as NDJSON, predictions as a file, and their scores."""
    for split, ids in (("train", range(60)), ("test", range(100, 120))):
        (tmp_path / split).mkdir()
        people = [(k, ("male", "female")[k % 2], ("sports", "creator")[k // 2 % 2], (1950, 1985)[k // 4 % 2]) for k in ids]
        lines = [json.dumps({"id": k, "gender": g, "occupation": o, "birthyear": y}) for k, g, o, y in people]
        (tmp_path / split / "labels.ndjson").write_text("\n".join(lines) + "\n\n")
        posts = [json.dumps({"id": k, "text": [[f"{g} word", f"{o} talk http://a.bc/d"], [f"year {'old' if y < 1960 else 'new'} times"]]}) for k, g, o, y in people]
        (tmp_path / split / "follower-feeds.ndjson").write_text("\n".join(posts) + "\n")
    labels, nested = feeds.dataset(spark, str(tmp_path))
    train, test = (nested.where(F.col("split") == s).select("id", "text") for s in ("train", "test"))
    learned, predicted = profile(labels.where("split = 'train'").drop("split"), train, test, max_iter=30)
    sinks.write_predictions(predicted, str(tmp_path / "out"))
    again = spark.read.schema("id long, birthyear int, gender string, occupation string").json(str(tmp_path / "out"))
    assert again.count() == 20 and learned.preprocessor == "normalise"
    truth = labels.where("split = 'test'").select("id", *[F.col(t).alias(f"true_{t}") for t in TRAITS])
    pairs = evaluate.join_truth(again.select("id", *[F.col(t).alias(f"pred_{t}") for t in TRAITS]), truth, strict=True)
    hits = {"gender": evaluate.exact_hit, "occupation": evaluate.exact_hit, "birthyear": evaluate.window_hit}
    scores = evaluate.scores(evaluate.class_counts(pairs, hits), {"gender": "f1_gender", "occupation": "f1_occupation", "birthyear": "f1_age"})
    assert {r["key"]: r["value"] for r in scores.collect()} == pytest.approx({"c_rank": 1.0, "f1_gender": 1.0, "f1_occupation": 1.0, "f1_age": 1.0})
    sinks.append_metrics(scores.where("key = 'f1_age'"), str(tmp_path / "metrics"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "metrics")).collect()] == ["measure{", '  key: "f1_age"', '  value: "1.0"', "}"]


def test_other_sources_and_unions(spark, tmp_path):
    (tmp_path / "labels.ndjson").write_text('{"id": 1, "gender": "male", "birthyear": "1950"}\n\n{"id": 2, "occupation": "sports", "birthyear": "n/a"}\n')
    path = str(tmp_path / "labels.ndjson")
    assert sorted(map(tuple, feeds.read_gender(spark, path).collect())) == [(1, "male"), (2, None)]
    frame = feeds.read_trait_frame(spark, path)
    assert frame.columns == ["gender", "age", "occupation"] and sorted((tuple(r) for r in frame.collect()), key=str) == [("male", 1950, None), (None, None, "sports")]
    (tmp_path / "lines").write_text('{"id": 1, "text": [["a"]]}\nno json\n   \n')
    assert [r["record"] for r in feeds.preview(spark, str(tmp_path / "lines"), feeds.MEMBER_FEED).collect()][:2] == ['{"id":1,"text":[["a"]]}', "no json"]
    rows = spark.createDataFrame([("train", "b"), ("train", "b"), ("train", "a"), ("train", None)], "split string, gender string")
    counts = distributions.value_counts(rows, ("gender",))
    assert [r["value"] for r in distributions.in_order(counts, "n").orderBy("place").collect()] == ["b", "a", None]
    assert [r["value"] for r in distributions.in_order(counts, "value").orderBy("place").collect()] == ["a", "b", None]
    both = distributions.value_counts(rows.unionByName(rows), ("gender",))
    assert {r["value"]: r["n"] for r in both.collect()} == {"a": 2, "b": 4, None: 2}
