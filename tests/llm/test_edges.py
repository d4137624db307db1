"""Very long texts, repeated rows, clashing columns and tables that teach nothing."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_learned import text
from test_texts import brute_components, brute_repeats, plain_spans

from feedprofile.llm.language import identify
from feedprofile.llm.lm_scoring import score_texts
from feedprofile.llm.mixing import mix
from feedprofile.llm.packing import pack
from feedprofile.llm.pii import digest, find_personal_data
from feedprofile.llm.repeats import remove_repeats
from feedprofile.llm.text_dedup import near_texts
from feedprofile.llm.tokens import tokenizer_path

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def long_texts():
    """A text of 200,000 words, a near copy, one word of a megabyte twice, and short ones."""
    rnd = random.Random(31)
    one = [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 5000)}" for _ in range(200_000)]
    other = list(one)
    for k in range(0, 200_000, 50):
        other[k] = "changed"
    return [" ".join(one), " ".join(other), "x" * (1 << 20), "x" * (1 << 20), "short text", None]


def test_near_texts_take_whole_long_texts(spark, long_texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_texts(spark.createDataFrame(list(enumerate(long_texts)), DOCS), 4, 80).collect()}
    assert got == dict(enumerate(brute_components(long_texts, 4, 80))) and got[1][1] == 0 and got[3][1] == 2


def test_repeats_in_long_texts(spark, long_texts):
    rnd = random.Random(32)
    passage = " ".join(f"p{rnd.randint(0, 10**6)}" for _ in range(80))
    long = long_texts[0][:300_000]
    texts = [long[:150_000] + passage + long[150_000:], "before " + passage, long[200_000:200_900], None]
    docs = spark.createDataFrame([*enumerate(texts), (9, texts[3])], DOCS + "").withColumns({"key": F.lit(1), "seg": F.lit("s")})
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in remove_repeats(docs).collect()}
    want = brute_repeats([(t or "").encode() for t in texts])
    assert got == {**dict(enumerate(want)), 9: (0, 0, 0, hashlib.sha256(b"").hexdigest())} and want[0][2] == 2


def test_mixing_of_long_texts_and_clashing_columns(spark, long_texts):
    rows = [(k, t, "a" if k < 3 else "b", 7, "r") for k, t in enumerate(long_texts)] + [(None, "x y", "b", 7, "r")] * 3
    docs = spark.createDataFrame(rows, DOCS + ", source string, _rank int, rate string")
    got = mix(docs).collect()
    assert len(got) == len(rows) and {r["_rank"] for r in got} == {7} and {r["size"] for r in got} == {200_000, 1, 2, 0}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)


def test_language_of_long_texts(spark):
    rnd = random.Random(33)
    rows = [(k, text(rnd, lang), lang) for k, lang in enumerate(["en", "de", "fr"] * 40)]
    rows += [(1000, text(rnd, "fr", 120_000), None), (1001, "é" * 400_000, None), (1002, "1 " * 400_000, None)]
    got = {r["doc_id"]: r["lang_pred"] for r in identify(spark.createDataFrame(rows, DOCS + ", lang string"), F.lit(True)).collect()}
    assert got[1000] == "fr" and got[1001] != "und" and got[1002] == "und"


def test_lm_scores_without_training_rows_and_with_clashing_columns(spark):
    texts = ["one two", None, "", "one two", "z" * 300_000]
    docs = spark.createDataFrame([(k % 3, t, 4.5, "r") for k, t in enumerate(texts)], DOCS + ", score double, _row string")
    got = score_texts(docs, F.lit(False), ["doc_id", "score", "_row"]).collect()
    assert len(got) == len(texts) and {r["_row"] for r in got} == {"r"} and {r["train_tokens"] for r in got} == {0}
    assert {r["n_known"] for r in got} == {0} and sorted(r["n_tokens"] for r in got) == [1, 1, 2, 3, 3]
    by = sorted(r["score"] for r in got)
    assert by == pytest.approx(sorted(-(len(t or "") + 1) * math.log10(256) for t in texts), rel=1e-6)
    # repeated rows teach as often as they stand there, and score alike
    twice = score_texts(docs, F.lit(True), ["doc_id"]).where("n_tokens = 3").collect()
    assert len(twice) == 2 and twice[0]["score"] == twice[1]["score"] > by[0] and twice[0]["train_tokens"] == 10


def test_personal_data_in_repeated_rows_and_long_texts(spark):
    texts = ["call +1 555 123 4567 or a@b.org", "w " * 200_000 + "a@b.org " + "v " * 100_000 + "10.1.2.3"]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (2, texts[1]), (None, texts[0])], DOCS)
    got = digest(find_personal_data(docs)).collect()
    assert len(got) == 4
    for r in got:
        spans = ",".join(f"{k}:{a}:{b}" for a, _, k, b in plain_spans(texts[r["doc_id"] == 2]))
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()


def test_packing_of_repeated_rows_and_long_texts(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(34)
    texts = ["a b c. " * 40, " ".join(rnd.choice(("lorem", "ipsum", "dolor", "sit")) for _ in range(60_000))]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (2, texts[1])], DOCS).coalesce(1)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    rows = sorted(pack(docs).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    whole = {1: 2 * len(ids[0]), 2: len(ids[1])}
    assert {k: sum(r["length"] for r in rows if r["doc_id"] == k) for k in whole} == whole
    for r in rows:
        own = ids[r["doc_id"] - 1]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
