"""Text expressions: tokens, hashtags, links, emojis and the normaliser.

Character classes are spelled out, because ``\\w`` and ``\\s`` differ between regular-expression engines. No group is
repeated over single characters, so long texts cannot exhaust the matcher's stack. What goes over every character of
every text, the normaliser, long words and the counts of posts, takes Arrow's patterns in tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from feedprofile.functions.lexicon import DETERMINERS_AND_QUANTIFIERS, PRONOUNS

WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
SPACES = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

TOKEN = WORD + "+"
HASHTAG = "#" + WORD + "+"
LINK = f"http[^{SPACES}]+"

# fixed values: code points that may start an emoji (emoji-data of Unicode 15), as ranges
EMOJI_RANGES = (
    (0x00A9, 0x00A9), (0x00AE, 0x00AE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139),
    (0x2194, 0x21AA), (0x231A, 0x23FF), (0x24C2, 0x24C2), (0x25AA, 0x25FE), (0x2600, 0x27BF), (0x2934, 0x2935),
    (0x2B05, 0x2B55), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299),
    (0x1F000, 0x1F1E5), (0x1F200, 0x1FAFF),
)


def emoji_pattern(ranges: Sequence[tuple[int, int]] = EMOJI_RANGES) -> str:
    """Flags, keycaps, and base emojis with variation selector, skin tone, tags and joined parts, each as one match."""
    base = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"
    unit = base + r"(?:\x{FE0F}|[\x{1F3FB}-\x{1F3FF}])?[\x{E0020}-\x{E007F}]*"
    return rf"[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[0-9#*]\x{{FE0F}}?\x{{20E3}}|{unit}(?:\x{{200D}}{unit})*"


EMOJI = emoji_pattern()


def tokens(text: Column) -> Column:
    """Lower-cased word runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def count_in(words: Column, lexicon: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*lexicon)))


def hashtag_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HASHTAG))


def link_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LINK))


def emojis(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMOJI), F.lit(0))


#: The normaliser's steps in order, as (pattern or None for a plain replacement, what, by what).
NORMALISER = (
    ("re", rf"http(?:s)*://{WORD}+\.[\p{{L}}\p{{N}}_/]*(?:[{SPACES}]|$)", " <URL> "),
    ("plain", "\n", ""),
    ("plain", "#", " <HASHTAG> "),
    ("re", rf"(?:^|{NON_WORD})@{WORD}*{NON_WORD}", " <USER> "),
    ("re", r":\)|;\)|:-\)|;-\)|:\(|:-\(|:-o|:o|<3", " <EMOTICON> "),
    ("re", r"[\x{a9}\x{ae}\x{2000}-\x{3300}]", " <EMOJI> "),
    ("re", r"(?:^|\P{Nd})\p{Nd}+:\p{Nd}+", " <TIME> "),
    ("re", r"(?:^|\P{Nd})\p{Nd}+[.'\p{Nd}]*\P{Nd}", " <NUMBER> "),
    ("re", r"[^\x{00}-\x{7F}]+", ""),
    ("re", rf"[{SPACES}]+", " "),
)


def _normalised(texts: pa.Array) -> pa.Array:
    for kind, what, by in NORMALISER[:-1]:
        texts = pc.replace_substring_regex(texts, what, by) if kind == "re" else pc.replace_substring(texts, what, by)
    # the last step, where it changes anything: a single space stays
    _, spaces, by = NORMALISER[-1]
    texts = pc.replace_substring_regex(texts, f"{spaces[:-1]}{{2,}}|[\\t-\\r\\x{{1c}}-\\x{{1f}}]", by)
    return pc.utf8_trim(texts, " ")


def normalise(text: Column) -> Column:
    """Lower-case, put placeholders for links, hashtags, mentions and numbers, keep ASCII, collapse white space."""
    return F.arrow_udf(_normalised, StringType())(F.lower(text))


def assemble(members: Column, most_members: int = 10, most_posts: int = 10_000) -> Column:
    """One document of nested posts: posts joined by ``<eotweet>``, members by ``<eofollower>``, both capped."""
    joined = F.transform(F.slice(members, 1, most_members), lambda m: F.array_join(F.slice(m, 1, most_posts), " <eotweet> "))
    return F.array_join(joined, " <eofollower> ")


def _long_words(texts: pa.Array) -> pa.Array:
    # separators become spaces; most are single spaces already
    lists = pc.split_pattern(pc.replace_substring_regex(texts, r"[^\p{L}\p{N}_ ]+", " "), " ")
    words = lists.flatten()
    long = pc.greater_equal(pc.utf8_length(words), 2)
    before = np.concatenate(([0], np.cumsum(long.to_numpy(zero_copy_only=False))))
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
    return pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), words.filter(long), mask=lists.is_null())


def long_words(text: Column) -> Column:
    """Words of two characters or more, in order."""
    return F.arrow_udf(_long_words, ArrayType(StringType()))(text)


#: What ``post_counts`` counts.
COUNTED = ("posts", "pronouns", "det_quant", "hashtags", "links", "emojis", "posts_with_hashtag", "posts_with_link", "posts_with_emoji")


def _post_counts(lists: pa.Array) -> pa.Array:
    posts = lists.flatten()
    # every word stands between spaces of its own
    apart = pc.replace_substring_regex(pc.replace_substring(pc.utf8_lower(posts), " ", "  "), r"[^\p{L}\p{N}_ ]", "  ")
    apart = pc.binary_join_element_wise("", apart, "", " ")
    found = {n: pc.count_substring_regex(apart, f" (?:{'|'.join(words)}) ") for n, words in (("pronouns", PRONOUNS), ("det_quant", DETERMINERS_AND_QUANTIFIERS))}
    found |= {n: pc.count_substring_regex(posts, p) for n, p in (("hashtags", HASHTAG), ("links", LINK), ("emojis", EMOJI))}
    each = {n: pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64) for n, c in found.items()}
    each |= {f"posts_with_{n}": (each[f"{n}s"] > 0).astype(np.int64) for n in ("hashtag", "link", "emoji")}
    each["posts"] = posts.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
    sums = {n: np.concatenate(([0], np.cumsum(each[n])))[ends] for n in COUNTED}
    return pa.StructArray.from_arrays([pa.array(np.diff(sums[n])) for n in COUNTED], list(COUNTED))


def post_counts(posts: Column) -> Column:
    """Counts of an array of posts, a struct of COUNTED; null posts are left out, and a null array has none."""
    return F.arrow_udf(_post_counts, StructType([StructField(n, LongType()) for n in COUNTED]))(posts)


def ngrams_of(words: Column) -> Column:
    """Words, and pairs of neighbours among them."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def ngrams(text: Column) -> Column:
    """Words of two characters or more, and pairs of neighbours among them."""
    return ngrams_of(long_words(text))


def posts_of(members: Column) -> Column:
    """All posts of nested members; null members and posts are left out, null is empty."""
    kept = F.filter(F.coalesce(members, F.array().cast("array<array<string>>")), lambda m: m.isNotNull())
    return F.filter(F.flatten(kept), lambda p: p.isNotNull())
