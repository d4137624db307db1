"""Models that know what they were made of: a kept model is taken only for the rows and settings that it was fitted with."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedprofile.operators.features import MAX_FEATURES, MIN_DF
from feedprofile.operators.model import PREPROCESSORS, Profiler, fit_profiler


class StaleModel(ValueError):
    """A kept model was fitted on other rows, or with other settings, than are asked for."""


def fingerprint(rows: DataFrame) -> dict[str, str]:
    """Number and digests of rows, whatever their order, partitions and order of columns; repeated rows count.

    Two independent sums of row hashes, made in one aggregate without a sort. Equal tables agree always, and tables that
    differ hardly ever do.
    """
    columns = sorted(rows.columns)
    # a null and an empty value, or values that change places, differ
    values = [F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}) for c in columns]
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    r = rows.agg(F.count("*").alias("n"), wide(F.xxhash64(F.lit(1), *values)).alias("a"), wide(F.xxhash64(F.lit(2), *values)).alias("b")).first()
    return {"columns": ",".join(columns), "rows": str(r["n"]), "a": str(r["a"]), "b": str(r["b"])}


def provenance(documents: DataFrame, traits: Sequence[str], settings: dict, preprocessor: str) -> str:
    """What a model is made of, as text: training rows, traits, settings, and the preprocessor's name and expression."""
    if preprocessor not in PREPROCESSORS:
        raise ValueError(f"unknown preprocessor {preprocessor!r}")
    steps = documents.select(PREPROCESSORS[preprocessor](F.col("document"))).columns[0]
    made = {
        "rows": fingerprint(documents.select("id", "document", *traits)), "traits": list(traits), "settings": settings,
        "preprocessor": preprocessor, "steps": hashlib.sha256(steps.encode()).hexdigest(),
    }
    return json.dumps(made, sort_keys=True)


def _note(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "made_of string").coalesce(1).write.mode("overwrite").parquet(f"{path}/provenance")


def made_of(spark: SparkSession, path: str) -> str | None:
    """What the model at ``path`` says that it is made of; empty for one that was not written to its end, None where there is none."""
    try:
        rows = spark.read.parquet(f"{path}/provenance").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows[0]["made_of"] if rows else ""


def differences(one: str, other: str) -> list[str]:
    """Names of what differs between two provenances."""
    a, b = (json.loads(x) for x in (one, other))
    return [k for k in sorted({*a, *b}) if a.get(k) != b.get(k)]


def fit_or_load(
    documents: DataFrame, traits: Sequence[str], path: str, stale: str = "refuse",
    min_df: int = MIN_DF, most: int = MAX_FEATURES, max_iter: int = 100, preprocessor: str = "none", tol: float = 3e-3,
) -> tuple[Profiler, bool]:
    """The model at ``path`` if it is made of these documents, traits and settings, else a new one that is kept there; and whether it was fitted.

    A model made of anything else is refused with ``StaleModel``, or replaced with ``stale="refit"``. One whose writing
    broke off is always replaced.
    """
    if stale not in ("refuse", "refit"):
        raise ValueError(f"stale must be 'refuse' or 'refit', not {stale!r}")
    spark = documents.sparkSession
    want = provenance(documents, traits, {"min_df": min_df, "most": most, "max_iter": max_iter, "tol": tol}, preprocessor)
    have = made_of(spark, path)
    if have == want:
        return Profiler.load(spark, path), False
    if have and stale == "refuse":
        raise StaleModel(f"the model at {path} differs in {', '.join(differences(have, want))}")
    profiler = fit_profiler(documents, traits, min_df, most, max_iter, preprocessor, tol)
    _note(spark, path, "")  # until all of it stands
    profiler.save(path)
    _note(spark, path, want)
    return profiler, True
