"""Evaluation of predicted traits: validation, per-class precision and recall, scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedprofile.sources.feeds import last_wins

Hit = Callable[[Column, Column], Column]


def exact_hit(predicted: Column, truth: Column) -> Column:
    return predicted == truth


def window_width(year: Column) -> Column:
    return F.lit(-0.1) * year + F.lit(202.8)


def window_hit(predicted: Column, truth: Column, width: Callable[[Column], Column] = window_width) -> Column:
    """Whether a predicted year lies in a window around the true one; the window's ends are cut to whole years."""
    p, t = predicted.cast("int"), truth.cast("int")
    m = width(t)
    return p.between((t - m).cast("int"), (t + m).cast("int"))


def class_counts(pairs: DataFrame, hits: Mapping[str, Hit], predicted: str = "pred_{}", truth: str = "true_{}") -> DataFrame:
    """Rows ``(trait, class, n_truth, n_pred, n_hit, precision, recall)`` for the classes of the truth.

    A hit counts for the true class, a miss for the predicted one. One shuffle for all traits.
    """
    rows = []
    for trait, hit in hits.items():
        p, t = F.col(predicted.format(trait)), F.col(truth.format(trait))
        ok = F.coalesce(hit(p, t), F.lit(False))
        for value, is_truth in ((t, 1), (F.when(ok, t.cast("string")).otherwise(p.cast("string")), 0)):
            rows.append(F.struct(F.lit(trait).alias("trait"), value.cast("string").alias("class"), F.lit(is_truth).alias("t"), (ok & F.lit(bool(is_truth))).cast("int").alias("h")))
    counts = pairs.select(F.inline(F.array(*rows))).groupBy("trait", "class").agg(
        F.sum("t").alias("n_truth"), F.sum(1 - F.col("t")).alias("n_pred"), F.sum("h").alias("n_hit")
    ).where("n_truth > 0")
    return counts.withColumn("precision", F.coalesce(F.try_divide("n_hit", "n_pred"), F.lit(0.0))).withColumn("recall", F.try_divide("n_hit", "n_truth"))


def harmonic(values: Column) -> Column:
    """Harmonic mean of an array; 0.0 if any value is 0 (the limit)."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.try_divide(F.lit(1.0), x))
    return F.coalesce(F.try_divide(F.size(values), total), F.lit(0.0))


def scores(classes: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rows ``(key, value)``: the rank score, then the F1 of each trait, named by ``names``."""
    means = classes.groupBy("trait").agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"))
    f1 = means.select("trait", harmonic(F.array("p", "r")).alias("f"))
    every = f1.agg(F.map_from_entries(F.collect_list(F.struct("trait", "f"))).alias("m"))  # a row for each trait
    got = {n: F.coalesce(F.try_element_at("m", F.lit(t)), F.lit(0.0)) for t, n in names.items()}
    pairs = [F.struct(F.lit("c_rank").alias("key"), harmonic(F.array(*got.values())).alias("value"))]
    pairs += [F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in got.items()]
    return every.select(F.inline(F.array(*pairs)))


def unknown_classes(rows: DataFrame, column: str, codes: Mapping[str, int]) -> DataFrame:
    """Class names of a column that have no code, with their number of rows."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*codes)).groupBy(column).agg(F.count("*").alias("n"))


def join_truth(predictions: DataFrame, truth: DataFrame, key: str = "id", strict: bool = False, position: str | None = None) -> DataFrame:
    """Predictions with their truth; with ``strict``, a predicted id without truth is an error.

    Ids are unique on both sides, as readers of files make them; where they aren't, ``position`` names the column of both
    sides by which the last row of an id wins.
    """
    if position is not None:
        predictions, truth = (last_wins(rows, key, position).drop(position) for rows in (predictions, truth))
    if strict and not predictions.join(truth, key, "left_anti").isEmpty():
        raise ValueError("predictions hold ids that the truth lacks")
    return predictions.join(truth, key)


def validation(predictions: DataFrame, truth: DataFrame, record: str, keys: tuple[str, ...], key: str = "id") -> DataFrame:
    """One row of counts: ids without prediction, ids without truth, and records with other keys than expected."""
    both = predictions.select(key, F.lit(1).alias("p"), record).join(truth.select(key, F.lit(1).alias("t")), key, "full_outer")
    has = F.array_sort(F.map_keys(F.from_json(record, "map<string,string>")))
    want = F.array(*[F.lit(k) for k in sorted(keys)])
    return both.agg(
        F.count_if(F.col("p").isNull()).alias("missing_pred"), F.count_if(F.col("t").isNull()).alias("extra_pred"),
        F.count_if(F.col("p").isNotNull() & ~F.coalesce(has == want, F.lit(False))).alias("bad_keys"),
    )
