import random

import pytest
from pyspark.sql import functions as F

from feedprofile.functions import lexicon, text


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "tokens", "hashtags", "links"), [
    ("it’s über #größe #日本 ²x ½ a_b", ["it", "s", "über", "größe", "日本", "²x", "½", "a_b"], 2, 0),
    ("##foo #a#b http http://a.b/c xhttps://q HTTP://x", ["foo", "a", "b", "http", "http", "a", "b", "c", "xhttps", "q", "http", "x"], 3, 2),
    ("", [], 0, 0),
])
def test_tokens_hashtags_links(spark, value, tokens, hashtags, links):
    assert one(spark, text.tokens, value) == tokens
    assert one(spark, text.hashtag_count, value) == hashtags
    assert one(spark, text.link_count, value) == links


def test_emojis_are_whole(spark):
    value = "hi 👍🏽 👨‍👩‍👧‍👦 🇩🇪🇫🇷 1️⃣ ❤️ © 12 # ok 🤝🤝"
    assert one(spark, text.emojis, value) == ["👍🏽", "👨‍👩‍👧‍👦", "🇩🇪", "🇫🇷", "1️⃣", "❤️", "©", "🤝", "🤝"]


@pytest.mark.parametrize(("value", "expected"), [
    ("Check https://t.co/ab1 @Bob hi #Cool 10:30 👍 it’s 42 ok :) <3", "check <URL> <USER> hi <HASHTAG> cool <TIME> it <EMOJI> s <NUMBER> ok <EMOTICON> <EMOTICON>"),
    ("https://www.foo.com/x end @bob", "https://www.foo.com/x end @bob"),
    ("a\nb 13", "ab 13"),
    ("@a @b x", "<USER> @b x"),
    ("café あ", "caf <EMOJI>"),
    ("http://a." + "b" * 20_000, "<URL>"),
])
def test_normalise(spark, value, expected):
    assert one(spark, text.normalise, value) == expected


def test_ngrams_and_assembly(spark):
    assert one(spark, text.ngrams, "ab c de fg") == ["ab", "de", "fg", "ab de", "de fg"]
    assert one(spark, text.ngrams, "") == []
    rows = spark.createDataFrame([([["a", "b"], ["c"]],), ([],), (None,)], "m array<array<string>>")
    assert [r[0] for r in rows.select(text.assemble(F.col("m"))).collect()] == ["a <eotweet> b <eofollower> c", "", None]
    assert [r[0] for r in rows.select(F.size(text.posts_of(F.col("m")))).collect()] == [3, 0, 0]


def test_text_work_is_done_by_arrow_and_equals_spark_patterns(spark):
    """Texts of odd characters give what Spark's own patterns give; these took some five times as long."""
    rnd = random.Random(7)
    parts = ["I", "you", "ihr", "the", "THE", "a_b", "é", "½", " ", "  ", "\t", "\n", "\x1c", " ", " ", "#", "@", "@u ", "10:30", "3.5'", "7", ":)", "<3", "http://a.b/c", "https://é.x ", "\U0001f44d\U0001f3fd", "\U0001f1e9\U0001f1ea", "©", "1️⃣", ",", "x"]
    rows = [("".join(rnd.choices(parts, k=rnd.randint(0, 30))), [None if rnd.random() < 0.1 else "".join(rnd.choices(parts, k=rnd.randint(0, 9))) for _ in range(rnd.randint(0, 4))]) for _ in range(400)]
    docs = spark.createDataFrame([*rows, (None, None), ("", [])], "t string, p array<string>")
    plain = F.lower("t")
    for kind, what, by in text.NORMALISER:
        plain = F.regexp_replace(plain, what, by) if kind == "re" else F.replace(plain, F.lit(what), F.lit(by))
    got = docs.select(text.normalise(F.col("t")).alias("a"), F.trim(plain).alias("b"), text.long_words(F.col("t")).alias("c"), F.regexp_extract_all("t", F.lit(text.WORD + "{2,}"), F.lit(0)).alias("d"))
    assert got.where("NOT (a <=> b) OR NOT (c <=> d)").count() == 0 and got.where("a IS NULL AND c IS NULL").count() == 1
    each = F.filter(F.coalesce("p", F.array().cast("array<string>")), lambda p: p.isNotNull())
    joined = F.array_join(each, "\n")
    counts = [F.size(each), *[text.count_in(text.tokens(joined), words) for words in (lexicon.PRONOUNS, lexicon.DETERMINERS_AND_QUANTIFIERS)], *[F.regexp_count(joined, F.lit(p)) for p in (text.HASHTAG, text.LINK, text.EMOJI)]]

    def having(pattern):
        return F.size(F.filter(each, lambda p: p.rlike(pattern)))

    counts += [having(p) for p in (text.HASHTAG, text.LINK, text.EMOJI)]
    both = docs.select(text.post_counts(F.col("p")).alias("a"), F.struct(*[c.cast("long").alias(n) for n, c in zip(text.COUNTED, counts, strict=True)]).alias("b"))
    assert both.where("NOT (a <=> b)").count() == 0
    plan = docs.select(text.normalise(F.col("t")), text.long_words(F.col("t")), text.post_counts(F.col("p")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_" not in plan
