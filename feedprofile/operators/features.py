"""TF-IDF features over word one- and two-grams.

Terms are counted in Arrow batches as numbers, codes of words and of pairs of words; strings are made of what is left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from feedprofile.functions import text
from feedprofile.sources.shared import kept

MIN_DF, MAX_FEATURES = 3, 10_000
#: Buckets of the filter, which bounds what it broadcasts, the pieces that their sums are added up in, and about how many documents suggest frequent terms.
BUCKETS, PIECES, SAMPLE_DOCUMENTS = 1 << 20, 64, 5_000
#: Documents from which on the filter is used by default.
FILTERED_FROM = 10_000
#: Words that are worked on at a time.
WORDS = 1 << 20


class Coded(NamedTuple):
    """Words of some rows as codes of ``names``, the row of each, and the places of words that another follows in their row."""

    names: pa.Array
    codes: np.ndarray
    owner: np.ndarray
    pairs: np.ndarray


def _coded(lists: pa.Array) -> Coded:
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return Coded(coded.dictionary, codes, owner, np.flatnonzero(owner[:-1] == owner[1:]))


def _parts(batches) -> Iterator[pa.RecordBatch]:
    """Batches with ``words`` in parts of some WORDS words; a row of more is a part of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")))
            yield batch.slice(at, to - at)
            at = to


def _buckets(words: Coded, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets below ``n`` of all words and of all pairs."""
    hashed = pd.util.hash_array(words.names.to_numpy(zero_copy_only=False).astype(object), categorize=False)[words.codes]
    both = (hashed[words.pairs] * np.uint64(0x9E3779B97F4A7C15)) ^ hashed[words.pairs + 1]
    mixed = [h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44) for h in (hashed ^ (hashed >> np.uint64(31)), both ^ (both >> np.uint64(31)))]
    return mixed[0].astype(np.int64) % n, mixed[1].astype(np.int64) % n


def _tally(owner: np.ndarray, key: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each key below ``n_keys`` occurs, and in how many rows."""
    return np.bincount(key, minlength=n_keys), np.bincount(np.unique(owner * n_keys + key) % max(n_keys, 1), minlength=n_keys)


class Lookup:
    """Finds the occurrences of given terms, words or pairs of words with a space between."""

    def __init__(self, terms: Sequence[str]) -> None:
        split = [t.split(" ") for t in terms]
        self.n = len(terms)
        self.names = pa.array(sorted({w for s in split for w in s}), pa.string())
        place = {w: k for k, w in enumerate(self.names.to_pylist())}
        self.single = np.full(len(place) + 1, -1)  # the last one stands for words of no term
        keys, which = [], []
        for k, s in enumerate(split):
            if len(s) == 1:
                self.single[place[s[0]]] = k
            else:
                keys.append(place[s[0]] * (len(place) + 1) + place[s[1]])
                which.append(k)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.which = np.array(keys, np.int64)[order], np.array(which, np.int64)[order]

    def find(self, words: Coded) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers of the terms that occur, once for each occurrence."""
        none = len(self.names)
        known = pc.fill_null(pc.index_in(words.names, value_set=self.names.cast(words.names.type)), none).to_numpy(zero_copy_only=False).astype(np.int64)
        place = known[words.codes]
        one = np.flatnonzero(self.single[place] >= 0)
        two = words.pairs[(place[words.pairs] < none) & (place[words.pairs + 1] < none)]
        key = place[two] * (none + 1) + place[two + 1]
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = np.flatnonzero(self.keys[at] == key) if len(self.keys) else np.zeros(0, np.int64)
        return np.concatenate((words.owner[one], words.owner[two[hit]])), np.concatenate((self.single[place[one]], self.which[at[hit]] if len(hit) else hit))


def word_table(documents: DataFrame, document: Column | None = None) -> DataFrame:
    """``documents`` with the words of their text, ``words``, in its place. The text work is done once and kept for all passes that follow."""
    given = F.col("document") if document is None else document
    return kept(documents.withColumn("words", text.long_words(given)).drop("document"))


def _rows(terms: pa.Array, tf: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"term": terms.cast(pa.string()), "tf": pa.array(tf.astype(np.int64)), "df": pa.array(df.astype(np.int64))})


def term_counts(rows: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """Rows ``(term, tf, df)`` that add up to the counts of all terms of ``rows(words)``, or of those in some ``buckets``."""
    heavy = None
    if buckets is not None:
        heavy = np.zeros(BUCKETS, bool)
        heavy[buckets.toArrow()["bucket"].to_numpy()] = True  # at most BUCKETS whole numbers

    def task(batches):
        for batch in _parts(batches):
            words = _coded(batch.column("words"))
            one, two = np.arange(len(words.codes)), words.pairs
            if heavy is not None:
                of_words, of_pairs = _buckets(words, len(heavy))
                one, two = one[heavy[of_words]], two[heavy[of_pairs]]
            seen, key = np.unique(words.codes[one], return_inverse=True)
            yield _rows(words.names.take(pa.array(seen)), *_tally(words.owner[one], key, len(seen)))
            seen, key = np.unique(words.codes[two] * len(words.names) + words.codes[two + 1], return_inverse=True)
            first, second = (words.names.take(pa.array(k)) for k in np.divmod(seen, max(len(words.names), 1)))
            yield _rows(pc.binary_join_element_wise(first, second, " "), *_tally(words.owner[two], key, len(seen)))

    return rows.select("words").mapInArrow(task, "term string, tf long, df long")


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _top(counts: DataFrame, min_df: int, most: int) -> DataFrame:
    return counts.where(F.col("df") >= min_df).orderBy(F.desc("tf"), F.asc("term")).limit(most)


def heavy_buckets(words: DataFrame, min_df: int, most: int, seed: int = 5) -> DataFrame:
    """Buckets of terms, ``(bucket)``, outside of which no term can be among the most frequent ``most``.

    A sample suggests terms. One pass then counts these exactly and of all terms sums by bucket, so that a task shuffles a
    number for each bucket and suggested term, however many terms there are. The count of the last of the best ``most``
    suggested terms is a floor: the true last one is at least as frequent, and a bucket below the floor can't hold it.
    """
    n = words.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(n, 1))
    likely = _top(_summed(term_counts(words.sample(share, seed) if share < 1 else words)), 1, 2 * most).select("term").collect()  # at most twice the vocabulary
    known = Lookup([r["term"] for r in likely])
    n_buckets, size = BUCKETS, BUCKETS // PIECES

    def task(batches):
        sums, tf, df = np.zeros(n_buckets, np.int64), np.zeros(known.n, np.int64), np.zeros(known.n, np.int64)
        for batch in _parts(batches):
            coded = _coded(batch.column("words"))
            for buckets in _buckets(coded, n_buckets):
                sums += np.bincount(buckets, minlength=n_buckets)
            more, rows = _tally(*known.find(coded), known.n)
            tf, df = tf + more, df + rows
        blobs = [sums[k * size : (k + 1) * size].tobytes() for k in range(PIECES)] + [tf.tobytes(), df.tobytes()]
        yield pa.RecordBatch.from_pydict({"piece": pa.array(np.arange(PIECES + 2), pa.int32()), "m": pa.array(blobs, pa.binary())})

    def added(some: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(m.as_py(), np.int64) for m in some.column("m")), np.int64(0))
        return pa.table({"piece": some.column("piece").slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})

    parts = words.select("words").mapInArrow(task, "piece int, m binary")
    parts = kept(parts.groupBy("piece").applyInArrow(added, "piece int, m binary"))
    told = {r["piece"]: np.frombuffer(r["m"], np.int64) for r in parts.where(F.col("piece") >= PIECES).collect()}  # a number for each suggested term
    best = np.sort(told[PIECES][told[PIECES + 1] >= min_df])[::-1][:most] if told else []
    floor = int(best[-1]) if len(best) == most else min_df

    def heavy(batches):
        for batch in batches:
            for k, m in zip(batch.column("piece").to_pylist(), batch.column("m"), strict=True):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(k * size + np.flatnonzero(np.frombuffer(m.as_py(), np.int64) >= floor), pa.int32())})

    return parts.where(F.col("piece") < PIECES).mapInArrow(heavy, "bucket int")


def vocabulary(words: DataFrame, min_df: int = MIN_DF, most: int = MAX_FEATURES, filtered: bool | None = None) -> DataFrame:
    """The most frequent terms of enough documents, ties by term: ``(term, tf, df)``.

    With ``filtered``, terms that can't be among them are left out before terms are shuffled (``heavy_buckets``), which
    costs a pass; by default that is done from FILTERED_FROM documents on. The result is exact either way.
    """
    if words.limit(FILTERED_FROM).count() == FILTERED_FROM if filtered is None else filtered:
        return _top(_summed(term_counts(words, heavy_buckets(words, min_df, most))), min_df, most)
    return _top(_summed(term_counts(words)), min_df, most)


def _weighted(lists: pa.Array, lookup: Lookup, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, count and weight of each term of each row, in this order; a row's weights have length one."""
    owner, term = lookup.find(_coded(lists))
    keys, n = np.unique(owner * max(lookup.n, 1) + term, return_counts=True)
    owner, term = np.divmod(keys, max(lookup.n, 1))
    weight = n * idf[term]
    return owner, term, n, weight / np.sqrt(np.bincount(owner, weight * weight, len(lists)))[owner]


def vectors(words: DataFrame, terms: Sequence[str], idf: Sequence[float], keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` of ``words`` and ``features``, the TF-IDF vector of each row as its terms' numbers, ascending, and their values."""
    lookup, scale = Lookup(terms), np.array(idf, float)

    def task(batches):
        for batch in _parts(batches):
            owner, term, _, weight = _weighted(batch.column("words"), lookup, scale)
            ends = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.StructArray.from_arrays(lists, ["indices", "values"])], [*keep, "features"])

    shape = StructType([StructField("indices", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType()))])
    rows = words.select(*keep, "words")
    return rows.mapInArrow(task, StructType([*[rows.schema[c] for c in keep], StructField("features", shape)]))


def tfidf(words: DataFrame, terms: DataFrame, n_documents: int, key: str = "id") -> DataFrame:
    """Rows ``(id, term, weight)``: counts times ln((1 + n) / (1 + df)) + 1, scaled to length one per document.

    A row of ``words`` is weighed where it is read, with the vocabulary of at most MAX_FEATURES terms. Only the rows of ids
    that stand in several rows are gathered by id.
    """
    known = terms.select("term", (F.log((F.lit(1.0) + n_documents) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf")).toArrow()
    lookup, idf, names = Lookup(known["term"].to_pylist()), known["idf"].to_numpy(), known["term"].combine_chunks()

    def task(batches):
        for batch in _parts(batches):
            owner, term, n, weight = _weighted(batch.column("words"), lookup, idf)
            at = pa.array(term)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner)), names.take(at), pa.array(n.astype(np.int64)), pa.array(idf[term]), pa.array(weight)], [key, "term", "n", "idf", "weight"])

    given = words.select(key, "words")
    rows = given.mapInArrow(task, StructType([given.schema[key], StructField("term", StringType()), StructField("n", LongType()), StructField("idf", DoubleType()), StructField("weight", DoubleType())]))
    repeated = kept(words.groupBy(F.col(key).alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id"))
    if repeated.isEmpty():
        return rows.select(key, "term", "weight")
    same = F.col(key).eqNullSafe(F.col("_id"))
    raw = rows.join(repeated, same, "left_semi").repartition(key).groupBy(key, "term").agg((F.sum("n") * F.first("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return rows.join(repeated, same, "left_anti").select(key, "term", "weight").unionByName(raw.select(key, "term", (F.col("w") / norm).alias("weight")))
