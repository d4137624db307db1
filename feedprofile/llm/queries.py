"""Queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedprofile.sources.feeds import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out to all cores where its files give fewer tasks than there are cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedprofile.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedprofile.llm.text_dedup import near_texts

    return near_texts(table(spark, sf_dir, "documents"), size=4, percent=80)


def fold(n: int):
    """The fold of a document, by its id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedprofile.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedprofile.llm.pii import digest, find_personal_data

    return digest(find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedprofile.llm.toxicity import score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = score_toxicity(docs, labels, learn=fold(5) != 0, keep=["doc_id"])
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedprofile.llm.lm_scoring import score_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, learn=fold(5) != 1, keep=["doc_id"])
    return scored.select("doc_id", (fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedprofile.llm.language import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = identify(docs, learn=fold(3) != 1, keep=["doc_id"])
    return named.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedprofile.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedprofile.llm.vector_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedprofile.llm.top_k import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedprofile.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedprofile.llm.quality import score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = score_quality(docs, labels, learn=fold(4) != 2, keep=["doc_id"])
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedprofile.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_text_dedup": op2_text_dedup,
    "op3_repeats": op3_repeats,
    "op4_personal_data": op4_personal_data,
    "op5_toxicity": op5_toxicity,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_language": op7_language,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_top_k": op9_top_k,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_quality": op12_quality,
    "op13_whitening": op13_whitening,
}

_OP2_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::varchar[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM tokens
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common WHERE 100 * m >= 80 * (na + nb - m)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT sets.doc_id, len(s) AS n_shingles, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN low ON low.a = sets.doc_id
"""

_OP8_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98::double
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e JOIN low ON low.a = e.vec_id
"""

_OP9_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::bigint AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r, vec_id, score FROM scored
)
SELECT query_id, r::integer AS rank, vec_id, score FROM ranked WHERE r <= 20
"""

#: The crc32 is worked out over a word's bytes: its table of 256 entries by its rule, then one step for each byte.
_OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(i))
), runs AS (
  SELECT d, run, count(*) AS k FROM (
    SELECT doc_id::varchar AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents)
  GROUP BY d, run
), hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(d || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::bigint] ELSE [192 + (unicode(c) >> 6)::bigint, 128 + (unicode(c) & 63)::bigint] END))), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS h
  FROM runs, steps
), vocabulary AS (
  SELECT word, sum(k)::bigint AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::integer) || substr(run, (h % length(run))::integer + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1))::integer AS i FROM vocabulary)
), near AS (
  SELECT DISTINCT * FROM (
    SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM gaps a JOIN vocabulary b ON a.short = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM gaps a JOIN vocabulary b ON a.short = b.word)
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n, min(other) FILTER (n = most) AS best FROM (SELECT *, max(n) OVER (PARTITION BY word) AS most FROM near) GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN forms f ON f.word = c.next
)
SELECT f.word, n, n_near, f.form, form_n, c.root FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""

ORACLE_SQL: dict[str, str] = {
    "op2_text_dedup": _OP2_SQL,
    "op8_vector_dedup": _OP8_SQL,
    "op9_top_k": _OP9_SQL,
    "op11_spelling": _OP11_SQL,
}
