"""Operators as filters and rewrites of a table of documents: the decisions take effect on the rows.

All stages keep the columns of ``docs``, whatever they are called, and rows with null or repeated ids; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedprofile.llm.language import UNKNOWN, identify
from feedprofile.llm.mixing import mix
from feedprofile.llm.pii import sanitize
from feedprofile.llm.storage import fresh, materialize
from feedprofile.llm.text_dedup import BROADCAST_IDS, text_components

#: Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.2


def _aside(docs: DataFrame, names: Collection[str]) -> dict[str, str]:
    """Other names for those columns of ``docs`` that an operator's own columns would replace."""
    lower, taken = {n.lower() for n in names}, [*docs.columns, *names]
    return {c: fresh(f"{c}_own", taken) for c in docs.columns if c.lower() in lower}


def with_language(docs: DataFrame, languages: Collection[str] | None = None, least_score: float = LEAST_SCORE) -> DataFrame:
    """Documents whose text is in one of ``languages`` (None: any that could be learned); ``lang`` becomes what the text says.

    Learned from rows with a ``lang``. Texts that are null, empty or without a letter (``und``) go, and so do those whose
    language is less sure than ``least_score``.
    """
    other = _aside(docs, ("lang_pred", "score"))
    named = identify(docs.withColumnsRenamed(other), learn=F.col("lang").isNotNull())
    kept = named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    if languages is not None:
        kept = kept.where(F.col("lang_pred").isin(*languages))
    return kept.select(*[F.col("lang_pred" if c == "lang" else other.get(c, c)).alias(c) for c in docs.columns])


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least ``doc_id``. Rows without an id stay.

    Rows are told apart by id and text, so that a repeated id with unlike texts stays once for each group of its texts.
    """
    found = text_components(docs, 5, 80).where("component is not null")
    keys = materialize(found.groupBy("component", "component_id", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    h, k = fresh("_h", docs.columns), fresh("_k", docs.columns)
    heads = keys.where("doc_id = component_id")
    first = heads.groupBy("component").agg(F.min("text_hash").alias("first"))
    others = heads.join(first, "component").where("text_hash <> first")
    dropped = keys.where("doc_id <> component_id").select("doc_id", "text_hash").unionByName(others.select("doc_id", "text_hash"))
    dropped = materialize(dropped.select("doc_id", F.col("text_hash").alias(h)))
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    rest = docs.withColumn(h, F.xxhash64("text")).join(dropped, ["doc_id", h], "left_anti")
    repeated = materialize(heads.where("n > 1").select("doc_id", F.col("text_hash").alias(h)))
    if repeated.isEmpty():
        return rest.select(*docs.columns)
    if repeated.count() <= BROADCAST_IDS:
        repeated = F.broadcast(repeated)
    order = Window.partitionBy("doc_id", h).orderBy(*[c for c in docs.columns if c != "doc_id"])
    once = rest.join(repeated, ["doc_id", h], "left_semi").withColumn(k, F.row_number().over(order)).where(F.col(k) == 1)
    return rest.join(repeated, ["doc_id", h], "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def without_personal_data(docs: DataFrame) -> DataFrame:
    """Documents with personal data and disclosing terms generalised; ``n_chars`` follows the new text."""
    clean = sanitize(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def mixed(docs: DataFrame) -> DataFrame:
    """Documents repeated, or left out, as the target mix of sources takes them; repeats are equal rows."""
    other = _aside(docs, ("size", "source_size", "target", "rate", "copies", "taken"))
    taken = mix(docs.withColumnsRenamed(other)).where("copies > 0")
    copy = fresh("_copy", taken.columns)
    again = taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*[F.col(other.get(c, c)).alias(c) for c in docs.columns])
