"""A kept model is used for what it was fitted on, and for nothing else."""

import pytest
from pyspark.sql import functions as F

from feedprofile.operators import model, provenance
from feedprofile.operators.model import register_preprocessor
from feedprofile.operators.provenance import StaleModel, fingerprint, fit_or_load

TRAITS = ("topic",)


def documents(spark, n=40):
    return spark.createDataFrame([(k, ("ball goal team" if k % 2 else "song stage tune") + f" word{k % 5}", "sports" if k % 2 else "music") for k in range(n)], "id long, document string, topic string")


def test_fingerprint_is_of_rows_and_not_of_order(spark):
    docs = documents(spark)
    same = [docs.orderBy(F.desc("id")), docs.repartition(7), docs.select("topic", "id", "document")]
    assert all(fingerprint(d) == fingerprint(docs) for d in same)
    other = [docs.limit(39), docs.unionByName(docs.limit(1)), docs.withColumn("topic", F.when(F.col("id") == 3, None).otherwise(F.col("topic"))), docs.withColumnRenamed("topic", "side"),
             docs.withColumn("document", F.when(F.col("id") == 3, "").otherwise(F.col("document"))), docs.select("id", F.col("topic").alias("document"), F.col("document").alias("topic"))]
    prints = [str(fingerprint(d)) for d in [docs, *other]]
    assert len(set(prints)) == len(prints)
    nulls = spark.createDataFrame([(1, None, "a"), (1, "a", None), (1, "", "a")], "id long, x string, y string")
    assert len({str(fingerprint(nulls.where(F.col("x").eqNullSafe(F.lit(x)) & F.col("y").eqNullSafe(F.lit(y))))) for x, y in ((None, "a"), ("a", None), ("", "a"))}) == 3
    assert fingerprint(docs.limit(0))["rows"] == "0"


def test_fit_then_load(spark, tmp_path, monkeypatch):
    docs, path = documents(spark), str(tmp_path / "m")
    first, fitted = fit_or_load(docs, TRAITS, path, max_iter=10)
    assert fitted
    monkeypatch.setattr(provenance, "fit_profiler", lambda *a: pytest.fail("fitted again"))
    again, fitted = fit_or_load(docs.orderBy(F.desc("id")).repartition(3), TRAITS, path, max_iter=10)
    assert not fitted and sorted(map(tuple, again.predict(docs).collect())) == sorted(map(tuple, first.predict(docs).collect()))


def test_a_stale_model_is_refused(spark, tmp_path):
    docs, path = documents(spark), str(tmp_path / "m")
    register_preprocessor("shout", lambda d: F.upper(d))
    fit_or_load(docs, TRAITS, path, max_iter=5, preprocessor="shout")
    with pytest.raises(StaleModel, match="rows"):
        fit_or_load(docs.where("id > 0"), TRAITS, path, max_iter=5, preprocessor="shout")
    with pytest.raises(StaleModel, match="settings"):
        fit_or_load(docs, TRAITS, path, max_iter=6, preprocessor="shout")
    with pytest.raises(StaleModel, match="preprocessor, steps"):
        fit_or_load(docs, TRAITS, path, max_iter=5)
    # another function under the name of the old one
    register_preprocessor("shout", lambda d: F.upper(F.trim(d)))
    with pytest.raises(StaleModel, match="in steps$"):
        fit_or_load(docs, TRAITS, path, max_iter=5, preprocessor="shout")
    _, fitted = fit_or_load(docs, TRAITS, path, stale="refit", max_iter=5)
    assert fitted and not fit_or_load(docs, TRAITS, path, max_iter=5)[1]
    with pytest.raises(ValueError):
        fit_or_load(docs, TRAITS, path, stale="ignore")


def test_a_model_that_broke_off_is_replaced(spark, tmp_path, monkeypatch):
    docs, path = documents(spark), str(tmp_path / "m")

    def broken(self, where):
        self.features.write().overwrite().save(f"{where}/features")
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(model.Profiler, "save", broken)
        with pytest.raises(OSError):
            fit_or_load(docs, TRAITS, path, max_iter=5)
    assert provenance.made_of(spark, path) == "" and provenance.made_of(spark, str(tmp_path / "none")) is None
    _, fitted = fit_or_load(docs, TRAITS, path, max_iter=5)
    assert fitted and provenance.made_of(spark, path)
