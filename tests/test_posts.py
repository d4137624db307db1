"""Posts from pieces of lines equal those of whole lines."""

import json
import random

import pytest
from pyspark.sql import functions as F

from feedprofile.sources import feeds
from feedprofile.sources.posts import read_posts

NASTY = ['say "hi"', "back\\slash", "ends with \\", '\\"', "", " ", "[x], [y]", '": [', "line\nfeed\ttab", "ü👍🏽", "{\"id\": 9}", "id", "text", "a, b", "'", " ", "x" * 300, '"' * 40]


def records(n, seed):
    rnd = random.Random(seed)
    for k in range(n):
        members = [[rnd.choice(NASTY) if rnd.random() < 0.5 else f"post {rnd.randint(0, 999)}" for _ in range(rnd.randint(0, 6))] for _ in range(rnd.randint(0, 5))]
        if rnd.random() < 0.2 and members:
            members[rnd.randrange(len(members))] = None
        members = [m if m is None or rnd.random() < 0.8 else [None, *m, None] for m in members]
        yield k, members


def lines(n, seed):
    rnd = random.Random(seed)
    out = []
    for k, members in records(n, seed):
        parts = [("id", str(k) if rnd.random() < 0.3 else k), ("text", members), ("name", rnd.choice([None, 1.5, "n, [", True]))]
        rnd.shuffle(parts)
        out.append(json.dumps(dict(parts), ensure_ascii=rnd.random() < 0.5, separators=rnd.choice([(",", ":"), (", ", ": "), (" , ", " : ")])))
    return out


def plain(spark, path, feed="members"):
    # ids may be numbers or strings
    nested = spark.read.schema((feeds.MEMBER_FEED if feed == "members" else feeds.OWN_FEED).replace("id long", "id string")).json(path)
    nested = nested.select(F.expr("try_cast(id as long)").alias("id"), "text" if feed == "members" else F.array("text").alias("text"))
    rows = nested.select("id", F.posexplode("text").alias("member", "m")).select("id", "member", F.posexplode("m").alias("post", "text"))
    return sorted((tuple(r) for r in rows.where("text IS NOT NULL").collect()), key=str)


def pieces(spark, path, feed="members"):
    return sorted((tuple(r) for r in read_posts(spark, path, feed).collect()), key=str)


@pytest.fixture(params=[64, 777, 10_000_000])
def blocks(spark, request):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def test_equal_to_whole_lines(spark, tmp_path, blocks):
    n = 12 if blocks == 64 else 60
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.ndjson").write_text("\n".join(lines(n, 1)) + "\n\n", encoding="utf-8")
    (tmp_path / "f" / "b.ndjson").write_text("\n\n" + "\n".join(lines(n, 2)), encoding="utf-8")
    path = str(tmp_path / "f")
    want = plain(spark, path)
    assert pieces(spark, path) == want and len(want) > n


def test_own_feeds_and_broken_lines(spark, tmp_path, blocks):
    own = tmp_path / "own"
    own.write_text("\n".join(json.dumps({"id": k, "text": [f"p{k}", None, 'q"', "r"] * (k % 3)}) for k in range(9)))
    assert pieces(spark, str(own), "own") == plain(spark, str(own), "own")
    broken = tmp_path / "broken"
    broken.write_text('{"id": 1, "text": [["a"]]}\n{"id": 2, "text": [["b", "never ends\n{"id": 3, "text": [["c"]]}\n{"text": [["no id"]]}\n')
    assert pieces(spark, str(broken)) == sorted([(1, 0, 0, "a"), (2, 0, 0, "b"), (3, 0, 0, "c"), (None, 0, 0, "no id")], key=str)
    with pytest.raises(ValueError):
        read_posts(spark, str(broken), "other")


def test_a_long_line_is_many_rows(spark, tmp_path):
    """One line of 30 MB in blocks of 1 MB; its id stands at the end."""
    path = tmp_path / "long"
    with path.open("w") as f:
        f.write('{"text": [')
        for m in range(30):
            f.write((", " if m else "") + json.dumps([f"m{m} p{k} " + "word " * 190 for k in range(1000)]))
        f.write('], "id": 77}\n{"id": 78, "text": [["short"]]}\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        got = read_posts(spark, str(path))
        assert got.count() == 30_001 and got.where("id = 77").agg(F.countDistinct("member", "post")).first()[0] == 30_000
        assert got.where("id = 77 AND NOT startswith(text, concat('m', member, ' p', post, ' '))").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
