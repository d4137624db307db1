"""Registered queries of the profile reports, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedprofile.functions import text, traits
from feedprofile.operators import distributions, entity, evaluate, features, ranking, stats
from feedprofile.plans import bindings, sql_literals
from feedprofile.plans.bindings import DIMENSIONS, table
from feedprofile.sources import feeds, posts, records, shared, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- shared parts of the SQL forms

_BAND = "CASE WHEN 2020 - birthyear < 20 THEN '<20' WHEN 2020 - birthyear < 30 THEN '20-29' WHEN 2020 - birthyear < 40 THEN '30-39' WHEN 2020 - birthyear < 50 THEN '40-49' WHEN birthyear IS NOT NULL THEN '50+' END"
_PEOPLE = f"""
people AS (
  SELECT *, {_BAND} AS age_band FROM (
    SELECT doc_id AS id, lang, source, (1940 + n_chars % 70)::integer AS birthyear,
      list_transform(string_split(text, chr(10)), lambda p, k: p
        || CASE WHEN (k - 1) % 3 = 0 THEN ' #' || lang || (k - 1) ELSE '' END
        || CASE WHEN (k - 1) % 4 = 1 THEN ' http://x.io/' || source ELSE '' END
        || CASE WHEN (k - 1) % 5 = 2 THEN ' \U0001f44d\U0001f3fd❤️' WHEN (k - 1) % 7 = 3 THEN ' \U0001f1e9\U0001f1ea' ELSE '' END
        || CASE WHEN (k - 1) % 3 = 1 THEN ' @u' || doc_id || ' hi' ELSE '' END
        || CASE WHEN (k - 1) % 4 = 2 THEN ' 10:30 x' ELSE '' END
        || CASE WHEN (k - 1) % 5 = 4 THEN ' :) y' ELSE '' END
        || CASE WHEN (k - 1) % 4 = 3 THEN ' http://x.io/a z' ELSE '' END) AS posts
    FROM documents)
)"""


def _words(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _hits(pattern: str, of: str = "p") -> str:
    return f"len(regexp_extract_all({of}, '{pattern}'))"


_TOKENS = f"list_transform(posts, lambda p: regexp_extract_all(lower(p), '{sql_literals.TOKEN}'))"
_SUM = "coalesce(list_sum(list_transform(posts, lambda p: {})), 0)::bigint"
_ENTITIES = f"""
{_PEOPLE}, entities AS (
  SELECT id, quality::varchar AS quality, source, age_band, birthyear, len(posts) AS posts,
    {_SUM.format(f"len(list_filter(regexp_extract_all(lower(p), '{sql_literals.TOKEN}'), lambda w: w IN ({_words(sql_literals.PRONOUNS)})))")} AS pronouns,
    {_SUM.format(f"len(list_filter(regexp_extract_all(lower(p), '{sql_literals.TOKEN}'), lambda w: w IN ({_words(sql_literals.DETERMINERS_AND_QUANTIFIERS)})))")} AS det_quant,
    {_SUM.format(_hits(sql_literals.HASHTAG))} AS hashtags, {_SUM.format(_hits(sql_literals.LINK))} AS links, {_SUM.format(_hits(sql_literals.EMOJI))} AS emojis,
    len(list_filter(posts, lambda p: regexp_matches(p, '{sql_literals.HASHTAG}'))) AS posts_with_hashtag,
    len(list_filter(posts, lambda p: regexp_matches(p, '{sql_literals.LINK}'))) AS posts_with_link,
    len(list_filter(posts, lambda p: regexp_matches(p, '{sql_literals.EMOJI}'))) AS posts_with_emoji
  FROM people JOIN labels ON labels.doc_id = people.id
)"""


def _grouped(columns: tuple[str, ...], rows: str = "entities") -> str:
    sums = "".join(f", sum({c})::bigint AS {c}" for c in columns)
    return " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS \"group\", count(*) AS entities{sums} FROM {rows} GROUP BY {d}" for d in DIMENSIONS)


_STATS = f"WITH {_ENTITIES}, stats AS ({_grouped(entity.COUNTS)})"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.labelled(bindings.people(spark, sf_dir), bindings.labels(spark, sf_dir), work=entity.entity_counts)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.profile_stats(_entities(spark, sf_dir), DIMENSIONS, entity.COUNTS)


# ---- sources, traits and tokens


@query("SELECT doc_id AS id, quality::varchar AS gender, (1940 + doc_id % 70)::integer AS birthyear FROM labels")
def labels_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("gender"), (F.lit(1940) + F.col("doc_id") % 70).cast("string").alias("birthyear"))).alias("line"))
    parsed = rows.select(F.inline(F.array(F.from_json("line", feeds.LABELS))))
    return parsed.select("id", "gender", F.expr("try_cast(birthyear as int)").alias("birthyear"))


@query("SELECT conv_id AS id, count(DISTINCT role) AS members, count(*) AS posts FROM conversations GROUP BY conv_id")
def feed_posts_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted without gathering a conversation's turns, so that a very long one is no single row."""
    by_member = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id"), "role").agg(F.count("*").alias("n"))
    return by_member.groupBy("id").agg(F.count("*").alias("members"), F.sum("n").alias("posts"))


@query("""SELECT conv_id AS id, (dense_rank() OVER (PARTITION BY conv_id ORDER BY role) - 1)::integer AS member, (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) - 1)::integer AS post, text
FROM conversations""")
def feed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines of nested posts, read back as posts from pieces of these lines."""
    path = shared.scratch(spark)
    bindings.conversations(spark, sf_dir).select(F.to_json(F.struct("id", "text")).alias("value")).write.text(path)
    return posts.read_posts(spark, path)


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.unlabelled(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), bindings.labels(spark, sf_dir).select("id"))


@query("SELECT id, doc_id FROM (SELECT doc_id % 50 AS id, doc_id, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id DESC) AS k FROM labels) WHERE k = 1")
def label_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("id"), "doc_id")
    return feeds.last_wins(rows, "id", "doc_id")


def _as_files(rows: DataFrame, order: str, line) -> str:
    """Rows as JSON lines in several files, whose names and lines follow ``order``."""
    path = shared.scratch(rows.sparkSession)
    rows.repartitionByRange(8, order).sortWithinPartitions(order).select(line.alias("value")).write.text(path)
    return path


_REPEATED = "doc_id // 4 * 2 + doc_id % 2"


@query(f"""SELECT id, gender, birthyear FROM (
  SELECT {_REPEATED} AS id, quality::varchar AS gender, (1940 + n_chars % 70)::integer AS birthyear, row_number() OVER (PARTITION BY {_REPEATED} ORDER BY doc_id DESC) AS k
  FROM labels JOIN documents USING (doc_id)) WHERE k = 1""")
def labels_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as files with repeated ids, read back: the last line of an id wins, across files too."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    line = F.to_json(F.struct(F.expr("doc_id DIV 4 * 2 + doc_id % 2").alias("id"), F.col("quality").cast("string").alias("gender"), bindings.birthyear().alias("birthyear")))
    return feeds.read_labels(spark, _as_files(rows, "doc_id", line)).select("id", "gender", "birthyear")


@query(f"""WITH lines AS (
  SELECT doc_id, {_REPEATED} AS id, quality AS truth, CASE WHEN n_chars % 4 = 0 THEN 1 - quality ELSE quality END AS pred FROM labels JOIN documents USING (doc_id)
), truth AS (
  SELECT id, arg_max(truth, doc_id) AS t FROM lines GROUP BY id
), pred AS (
  SELECT id, arg_max(pred, -doc_id) AS p FROM lines GROUP BY id
), pairs AS (SELECT t, p FROM truth JOIN pred USING (id))
SELECT 'gender' AS trait, c::varchar AS "class", n_truth, coalesce(n_pred, 0) AS n_pred, n_hit, coalesce(n_hit::double / n_pred, 0) AS "precision", n_hit::double / n_truth AS recall
FROM (SELECT t AS c, count(*) AS n_truth, count(*) FILTER (p = t) AS n_hit FROM pairs GROUP BY t) LEFT JOIN (SELECT p AS c, count(*) AS n_pred FROM pairs GROUP BY p) USING (c)""")
def eval_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and truth as files with repeated ids; predictions are written in the opposite order."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("back", -F.col("doc_id"))
    known = F.expr("doc_id DIV 4 * 2 + doc_id % 2").alias("id")
    guess = F.when(F.col("n_chars") % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).cast("string")
    truth = feeds.read_predictions(spark, _as_files(rows, "doc_id", F.to_json(F.struct(known, F.col("quality").cast("string").alias("gender")))))
    guesses = feeds.read_predictions(spark, _as_files(rows, "back", F.to_json(F.struct(known, guess.alias("gender")))))
    pairs = evaluate.join_truth(guesses.select("id", F.col("gender").alias("pred_gender")), truth.select("id", F.col("gender").alias("true_gender")), strict=True)
    return evaluate.class_counts(pairs, {"gender": evaluate.exact_hit})


@query(f"SELECT age_band, count(*) AS n FROM (SELECT {_BAND} AS age_band FROM (SELECT 1940 + n_chars % 70 AS birthyear FROM documents)) GROUP BY age_band")
def age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(traits.age_band(bindings.birthyear()).alias("age_band"))
    return rows.groupBy("age_band").agg(F.count("*").alias("n"))


_CLASS = """CASE WHEN birthyear BETWEEN 1940 AND 1955 THEN 1947 WHEN birthyear BETWEEN 1956 AND 1969 THEN 1963 WHEN birthyear BETWEEN 1970 AND 1980 THEN 1975
  WHEN birthyear BETWEEN 1981 AND 1989 THEN 1985 WHEN birthyear BETWEEN 1990 AND 1999 THEN 1994 END"""


@query(f"SELECT doc_id AS id, birthyear, {_CLASS} AS birthyear_class FROM (SELECT doc_id, (1935 + n_chars % 70)::integer AS birthyear FROM documents)")
def birthyear_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (F.lit(1935) + F.col("n_chars") % 70).cast("int")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), year.alias("birthyear"), traits.birthyear_class(year).alias("birthyear_class"))


@query(
    "SELECT id, occupation, CASE occupation WHEN 'sports' THEN 0 WHEN 'performer' THEN 1 WHEN 'creator' THEN 2 WHEN 'politics' THEN 3 END AS code, occupation AS decoded "
    "FROM (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'sports' WHEN 1 THEN 'performer' WHEN 2 THEN 'creator' ELSE 'politics' END AS occupation FROM labels)"
)
def class_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in traits.OCCUPATION_CODES]), (F.col("doc_id") % 4 + 1).cast("int"))
    code = traits.encode(F.col("occupation"), traits.OCCUPATION_CODES)
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), name.alias("occupation"))
    return rows.withColumn("code", code).withColumn("decoded", traits.decode(F.col("code"), traits.OCCUPATION_CODES))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{sql_literals.TOKEN}')) AS token FROM documents) GROUP BY token")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.spread(table(spark, sf_dir, "documents")).select(F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# ---- statistics by trait


def _ratio_sql(names: tuple[str, ...], charts: tuple[str, ...]) -> str:
    cols = "".join(f", {n}" for n in names) + "".join(f", {stats.CHARTS[c][0]}::double / {stats.CHARTS[c][1]} AS {c}" for c in charts)
    return f'{_STATS} SELECT dimension, "group", entities{cols} FROM stats WHERE posts > 0'


def _report(spark: SparkSession, sf_dir: str, names: tuple[str, ...], charts: tuple[str, ...]) -> DataFrame:
    sums = stats.profile_stats(_entities(spark, sf_dir), DIMENSIONS, names)
    return stats.with_ratios(sums, {c: stats.CHARTS[c] for c in charts})


_LANGUAGE = (("posts", "pronouns", "det_quant"), ("posts_per_entity", "pronouns_per_post", "det_quant_per_post"))
_TAGS = (("posts", "hashtags", "links", "posts_with_hashtag", "posts_with_link"), ("hashtags_per_post", "share_with_hashtag", "links_per_post", "share_with_link"))
_EMOJIS = (("posts", "emojis", "posts_with_emoji"), ("emojis_per_post", "share_with_emoji"))


@query(_ratio_sql(*_LANGUAGE))
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, *_LANGUAGE)


@query(_ratio_sql(*_TAGS))
def hashtag_link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, *_TAGS)


@query(_ratio_sql(*_EMOJIS))
def emoji_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, *_EMOJIS)


_FOUND = f"""WITH {_PEOPLE}, found AS (
  SELECT id, quality::varchar AS quality, source, age_band, unnest(flatten(list_transform(posts, lambda p: regexp_extract_all(p, '{sql_literals.EMOJI}')))) AS emoji
  FROM people JOIN labels ON labels.doc_id = people.id
), counts AS (""" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS \"group\", emoji, count(*) AS n FROM found GROUP BY {d}, emoji" for d in DIMENSIONS) + ")"


@query(f'{_FOUND} SELECT * FROM (SELECT dimension, "group", emoji, n, row_number() OVER (PARTITION BY dimension, "group" ORDER BY n DESC, emoji)::integer AS rank FROM counts) WHERE rank <= 10')
def emoji_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = entity.labelled(bindings.people(spark, sf_dir), bindings.labels(spark, sf_dir), work=ranking.emoji_lists)
    return ranking.top_n(ranking.emoji_frequencies(people, DIMENSIONS), 10)


@query(f'{_STATS} SELECT dimension, "group", entities, {", ".join(entity.COUNTS)} FROM stats')
def merge_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entities(spark, sf_dir)
    return stats.merge_stats(*[stats.profile_stats(rows.where(F.col("id") % 2 == k), DIMENSIONS, entity.COUNTS) for k in (0, 1)])


@query(f"WITH {_ENTITIES} SELECT id, emojis / posts AS emojis_per_post, hashtags / posts AS hashtags_per_post, links / posts AS links_per_post FROM entities WHERE posts > 0")
def entity_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.rates(_entities(spark, sf_dir)).select("id", "emojis_per_post", "hashtags_per_post", "links_per_post")


_METRICS = ("emojis_per_post", "hashtags_per_post", "links_per_post")
_LONG = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS \"group\", '{m}' AS metric, ({m.split('_')[0]} / posts)::double AS value FROM entities WHERE posts > 0" for d in DIMENSIONS for m in _METRICS)


@query(f"""WITH {_ENTITIES}, long AS ({_LONG}), boxes AS (
  SELECT dimension, "group", metric, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY ALL
), ends AS (
  SELECT b.dimension, b."group", b.metric, b.n, q1, med, q3,
    min(value) FILTER (value BETWEEN q1 - 1.5::double * (q3 - q1) AND q3 + 1.5::double * (q3 - q1)) AS lo,
    max(value) FILTER (value BETWEEN q1 - 1.5::double * (q3 - q1) AND q3 + 1.5::double * (q3 - q1)) AS hi,
    count(*) FILTER (NOT value BETWEEN q1 - 1.5::double * (q3 - q1) AND q3 + 1.5::double * (q3 - q1)) AS n_outliers
  FROM long l JOIN boxes b ON l.dimension = b.dimension AND l."group" IS NOT DISTINCT FROM b."group" AND l.metric = b.metric GROUP BY ALL
) SELECT dimension, "group", metric, n, q1, med, q3, least(coalesce(lo, q1), q1) AS whisker_lo, greatest(coalesce(hi, q3), q3) AS whisker_hi, n_outliers FROM ends""")
def entity_box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.box_stats(entity.rates(_entities(spark, sf_dir)), DIMENSIONS, _METRICS)


@query(f"""WITH {_ENTITIES}, long AS ({_LONG})
SELECT dimension, "group", metric, count(*) AS n, min(value) AS lo, max(value) AS hi, true AS q1_ok, true AS med_ok, true AS q3_ok FROM long GROUP BY dimension, "group", metric""")
def merged_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions stored by split and merged from their state; quartiles must have their ranks within the stated error."""
    people = shared.kept(entity.rates(_entities(spark, sf_dir)).withColumn("split", F.element_at(F.array(*[F.lit(x) for x in feeds.SPLITS]), (F.col("id") % 3 + 1).cast("int"))))
    path = shared.scratch(spark)
    sinks.write_table(distributions.sketches(people, DIMENSIONS, _METRICS, by=["split"]), path, ["split"])
    state = shared.kept(distributions.merge_sketches(*[spark.read.parquet(path).where(F.col("split") == x).drop("split") for x in feeds.SPLITS]))
    checked = distributions.rank_check(people, distributions.sketched_boxes(state), DIMENSIONS, _METRICS, distributions.rank_error())
    return distributions.beside(state, checked).select(*distributions.KEYS, "n", "lo", "hi", "q1_ok", "med_ok", "q3_ok")


_SPLIT = "CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'supplement' ELSE 'test' END"


@query(" UNION ALL ".join(
    f"SELECT split, '{c}' AS \"column\", {c}::varchar AS value, count(*) AS n FROM (SELECT {_SPLIT} AS split, quality, toxic, (1940 + n_chars % 70)::integer AS birthyear FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY split, {c}"
    for c in ("quality", "toxic", "birthyear")
))
def trait_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value_counts(spark, sf_dir)


def _value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    split = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "supplement").otherwise("test")
    return distributions.value_counts(docs.select(split.alias("split"), "quality", "toxic", bindings.birthyear().alias("birthyear")), ("quality", "toxic", "birthyear"))


_ORDERED = " UNION ALL ".join(
    f"SELECT split, '{c}' AS \"column\", {c}::varchar AS value, count(*) AS n FROM (SELECT {_SPLIT} AS split, quality, toxic, (1940 + n_chars % 70)::integer AS birthyear FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY split, {c}"
    for c in ("quality", "toxic", "birthyear")
)
_PLACE = 'SELECT split, "column", value, n, row_number() OVER (PARTITION BY split, "column" ORDER BY {} NULLS LAST)::integer AS place FROM (' + _ORDERED + ")"


@query(_PLACE.format("n DESC, value"))
def value_counts_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.in_order(_value_counts(spark, sf_dir), "n")


@query(_PLACE.format("value"))
def value_counts_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.in_order(_value_counts(spark, sf_dir), "value")


@query(f'{_STATS} SELECT dimension, "group", entities, posts, round(coalesce(emojis::double / nullif(posts, 0), 0), 4) AS emojis_per_post, round(coalesce(posts_with_emoji::double / nullif(posts, 0), 0), 4) AS share_with_emoji FROM stats')
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(_stats(spark, sf_dir))


@query(f"{_STATS} " + " UNION ALL ".join(f"SELECT '{n}' AS chart, dimension, \"group\", {a}::double / {b} AS value FROM stats WHERE {b} > 0" for n, (a, b) in stats.CHARTS.items()))
def chart_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chart_table(_stats(spark, sf_dir))


@query(f"SELECT page_id, len(regexp_extract_all(url || ' ' || html, '{sql_literals.LINK}')) AS links FROM pages")
def page_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.link_count(F.concat_ws(" ", "url", "html")).cast("long").alias("links"))


# ---- features and models


def _normal_sql(column: str) -> str:
    out = f"lower({column})"
    for kind, what, by in sql_literals.NORMALISER:
        quoted = what.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{by}', 'g')" if kind == "re" else f"replace({out}, {'chr(10)' if what == chr(10) else repr(what)}, '{by}')"
    return f"trim({out})"


_NORMAL = f"WITH {_PEOPLE}, normal AS (SELECT id, source, {_normal_sql('array_to_string(posts, chr(10))')} AS document FROM people)"


def _raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = traits.birthyear_class(F.col("birthyear")).alias("birthyear")
    return bindings.people(spark, sf_dir).select("id", "source", "lang", year, F.array_join("posts", "\n").alias("document"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_documents(spark, sf_dir).select("id", text.normalise(F.col("document")).alias("document"))


@query(f"{_NORMAL} SELECT id, document FROM normal")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("id", "document")


@query("""WITH posts AS (
  SELECT conv_id, role, list(text ORDER BY turn, text) AS posts FROM conversations GROUP BY conv_id, role
), members AS (
  SELECT conv_id, list(array_to_string(posts[1:10000], ' <eotweet> ') ORDER BY role) AS members FROM posts GROUP BY conv_id
) SELECT conv_id AS id, array_to_string(members[1:10], ' <eofollower> ') AS document FROM members""")
def assembled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.conversations(spark, sf_dir).select("id", text.assemble(F.col("text")).alias("document"))


_TERMS = f"""{_NORMAL}, words AS (
  SELECT id, regexp_extract_all(document, '{sql_literals.WORD_OF_TWO}') AS w FROM normal
), terms AS (
  SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS term FROM words
), counts AS (
  SELECT id, term, count(*) AS tf FROM terms GROUP BY id, term
), vocabulary AS (
  SELECT term, sum(tf)::bigint AS tf, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 3 ORDER BY tf DESC, term LIMIT 10000
)"""


@query(f"{_TERMS} SELECT term, tf, df FROM vocabulary")
def vocabulary_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.vocabulary(features.word_table(_documents(spark, sf_dir)))


@query(f"{_TERMS} SELECT term, tf, df FROM vocabulary")
def vocabulary_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vocabulary by the way of large corpora: terms of light buckets go before any term is shuffled."""
    return features.vocabulary(features.word_table(_documents(spark, sf_dir)), filtered=True)


@query(f"""{_TERMS}, n AS (SELECT count(*) AS n FROM documents), raw AS (
  SELECT c.id, c.term, c.tf * (ln((1 + n.n)::double / (1 + v.df)) + 1) AS w FROM counts c JOIN vocabulary v ON v.term = c.term, n
) SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw""")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = features.word_table(_documents(spark, sf_dir))
    return features.tfidf(words, features.vocabulary(words), words.count())


_LEARNED = ("quality", "lang", "birthyear")


def _taught(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents as words, and the labelled ones with their traits."""
    from feedprofile.operators.model import prepared

    # traits that stand beside the text come along; only labels are joined
    words = prepared(_raw_documents(spark, sf_dir).drop("source"), "normalise")
    labels = bindings.labels(spark, sf_dir).select("id", "quality")
    return words, words.join(F.broadcast(labels) if entity.few(labels) else labels, "id").select("id", "words", *_LEARNED)


@query()
def predicted_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifiers learned on labelled documents predict the traits of all documents."""
    from feedprofile.operators.model import fit_profiler

    words, train = _taught(spark, sf_dir)
    return fit_profiler(train, _LEARNED, preprocessor="normalise").predict(words)


@query(f"""WITH known AS (
  SELECT quality::varchar AS quality, lang, ({_CLASS})::varchar AS birthyear FROM (SELECT doc_id, quality FROM labels) JOIN (SELECT doc_id, lang, (1940 + n_chars % 70)::integer AS birthyear FROM documents) USING (doc_id)
), classes AS (
  SELECT 'quality' AS trait, quality AS "class" FROM known UNION ALL SELECT 'lang', lang FROM known UNION ALL SELECT 'birthyear', birthyear FROM known
) SELECT trait, "class", count(*) AS documents, count(*) AS expected, 0.0::double AS gradient FROM classes WHERE "class" IS NOT NULL GROUP BY trait, "class" """)
def trait_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificate that the learned weights are the optimum: expected class sizes equal the true ones, and the gradient is nought, to two decimals."""
    from feedprofile.operators.model import fit_profiler, model_weights, optimality

    _, train = _taught(spark, sf_dir)
    train = shared.kept(train)
    profiler = fit_profiler(train, _LEARNED, max_iter=200, preprocessor="normalise")
    n = train.count()
    vocabulary = model_weights(profiler)[0].select("term", ((1.0 + n) / F.exp(F.col("idf") - 1) - 1).alias("df"))
    rows = shared.kept(features.tfidf(train, vocabulary, n))
    found = optimality(profiler, train.select("id", *_LEARNED), rows)
    return found.select("trait", "class", "documents", F.round("expected").cast("long").alias("expected"), F.abs(F.round("gradient", 2)).alias("gradient"))


# ---- evaluation and previews

_HITS = {"quality": evaluate.exact_hit, "toxic": evaluate.exact_hit, "birthyear": evaluate.window_hit}
_PRED = """pred AS (
  SELECT doc_id AS id, n_chars, quality AS true_quality, CASE WHEN n_chars % 4 = 0 THEN 1 - quality ELSE quality END AS pred_quality,
    toxic AS true_toxic, CASE WHEN n_chars % 5 = 0 THEN 1 - toxic ELSE toxic END AS pred_toxic,
    1940 + n_chars % 70 AS true_birthyear, 1940 + n_chars % 70 + doc_id % 9 - 4 AS pred_birthyear
  FROM documents JOIN labels USING (doc_id)
), pairs AS (
  SELECT 'quality' AS trait, pred_quality AS p, true_quality AS t, pred_quality = true_quality AS hit FROM pred
  UNION ALL SELECT 'toxic', pred_toxic, true_toxic, pred_toxic = true_toxic FROM pred
  UNION ALL SELECT 'birthyear', pred_birthyear, true_birthyear,
    pred_birthyear BETWEEN trunc(true_birthyear - (-0.1::double * true_birthyear + 202.8::double)) AND trunc(true_birthyear + (-0.1::double * true_birthyear + 202.8::double)) FROM pred
), truths AS (
  SELECT trait, t AS c, count(*) AS n_truth, count(*) FILTER (hit) AS n_hit FROM pairs GROUP BY trait, t
), guesses AS (
  SELECT trait, CASE WHEN hit THEN t ELSE p END AS c, count(*) AS n_pred FROM pairs GROUP BY ALL
), classes AS (
  SELECT trait, c::varchar AS "class", n_truth, coalesce(n_pred, 0) AS n_pred, n_hit, coalesce(n_hit::double / n_pred, 0) AS "precision", n_hit::double / n_truth AS recall
  FROM truths LEFT JOIN guesses USING (trait, c)
)"""


@query(f'WITH {_PRED} SELECT trait, "class", n_truth, n_pred, n_hit, "precision", recall FROM classes')
def eval_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_counts(bindings.predictions(spark, sf_dir), _HITS)


@query(f"""WITH {_PRED}, f AS (
  SELECT trait, CASE WHEN avg("precision") = 0 OR avg(recall) = 0 THEN 0 ELSE 2 / (1 / avg("precision") + 1 / avg(recall)) END AS f FROM classes GROUP BY trait
) SELECT 'f1_' || trait AS key, f AS value FROM f
UNION ALL SELECT 'c_rank', CASE WHEN min(f) = 0 THEN 0 ELSE count(*) / sum(1 / f) END FROM f""")
def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = evaluate.class_counts(bindings.predictions(spark, sf_dir), _HITS)
    return evaluate.scores(classes, {t: f"f1_{t}" for t in _HITS})


@query("""WITH p AS (SELECT doc_id FROM documents WHERE n_chars % 6 <> 0)
SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM p)) AS missing_pred,
  (SELECT count(*) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS extra_pred,
  (SELECT count(*) FROM p WHERE doc_id % 7 = 0) AS bad_keys""")
def prediction_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("n_chars % 6 <> 0")
    gender = F.when(F.col("doc_id") % 7 != 0, F.lit("female"))  # null fields leave the record
    record = F.to_json(F.struct(F.col("doc_id").alias("id"), F.lit("sports").alias("occupation"), bindings.birthyear().alias("birthyear"), gender.alias("gender")))
    predictions = docs.select(F.col("doc_id").alias("id"), record.alias("record"))
    return evaluate.validation(predictions, bindings.labels(spark, sf_dir), "record", feeds.PREDICTION_KEYS)


_MIXED = """CASE doc_id % 6
  WHEN 0 THEN '{"id": ' || doc_id || ', "lang": "' || lang || '", "size": ' || n_chars || '}'
  WHEN 1 THEN '{"id": "' || doc_id || '", "size": {"chars": ' || n_chars || ', "unit": null}}'
  WHEN 2 THEN '{"id": ' || doc_id || '.5, "tags": ["' || lang || '", ' || n_chars || ', {"deep": [true]}]}'
  WHEN 3 THEN '[' || doc_id || ', "' || lang || '"]'
  WHEN 4 THEN '{"id": ' || doc_id || ', "lang": '
  ELSE '{"lang": ' || CASE WHEN n_chars % 2 = 0 THEN 'null' ELSE 'false' END || '}' END"""


@query(f"""WITH lines AS (SELECT {_MIXED} AS line FROM documents), nodes AS (
  SELECT regexp_replace(fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type
  FROM (SELECT line FROM lines WHERE json_valid(line)) l, json_tree(l.line)
) SELECT path, type, count(*) AS n FROM nodes GROUP BY path, type""")
def record_key_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of unknown, nested and mixed shape, read back from lines without a schema: how often each path holds each type."""
    path = shared.scratch(spark)
    table(spark, sf_dir, "documents").select(F.expr(_MIXED).alias("value")).where("value IS NOT NULL").write.text(path)
    return records.key_types(records.read_records(spark, path))


@query("SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars})::varchar AS record FROM documents ORDER BY doc_id LIMIT 100")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.preview_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
