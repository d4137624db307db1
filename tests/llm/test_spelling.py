"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedprofile.llm import spelling
from feedprofile.llm.spelling import Tree, Words, near_words, roots, spelling_variants


def brute_near(words):
    near = collections.defaultdict(set)
    gaps = collections.defaultdict(list)
    for w in words:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            gaps[short, k].append(w)
            if short in words:
                near[w].add(short)
                near[short].add(w)
    for some in gaps.values():
        for a in some:
            near[a].update(b for b in some if b != a)
    return near


def brute(docs, loss):
    counts = collections.Counter()
    for doc_id, text in docs:
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % loss == 0 else run
            counts[word] += len(word) >= 6
    n = {w: c for w, c in counts.items() if c >= 5}
    near = brute_near(n)
    best = {w: min(near[w], key=lambda x: (-n[x], x.encode())) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abcdeÿÀß") for _ in range(rnd.randint(6, 9))) for _ in range(60)]
    out = []
    for k in range(150):
        words = rnd.choices(stems, [1 / (i + 1) for i in range(60)], k=rnd.randint(0, 120))
        out.append((k, rnd.choice(" ,-\n7").join(w.title() if rnd.random() < 0.2 else w for w in words)))
    out += [(300 + k, "chainaaa " * 40 + "chainaab " * 6 + "chainabb") for k in range(40)]
    return [*out, out[7], out[7], (None, "ababab " * 9), (200, None), (201, ""), (202, "ab" * 50_000), (203, " ".join(["ab" * 900] * 6 + ["ab" * 900 + "c"] * 30))]


def test_variants_equal_brute_force(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "best", "kind", "part", "box")})
    got = {tuple(r) for r in spelling_variants(frame, loss=7).collect()}
    assert got == brute(docs, 7)
    assert any(r[3] for r in got) and any(r[5] not in (r[0], r[3]) for r in got) and any(len(r[0]) > 1000 and r[3] for r in got)


def test_small_boxes_and_blocks_lose_no_neighbour(spark):
    """Every bound is met: a small sample, boxes of one letter count, blocks of a box."""
    rnd = random.Random(6)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(6, 8))) for _ in range(1500)}
    n = {w: rnd.randint(5, 50) for w in words}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    near = brute_near(words)
    want = {(w, len(near[w]), max(n[x] for x in near[w]), min(near[w], key=lambda x: (-n[x], x))) for w in words if near[w]}
    assert {tuple(r) for r in near_words(table, sample=200, box=16, block=8).collect()} == want
    assert {tuple(r) for r in near_words(table).collect()} == want


def test_searches_reach_every_box_within_reach():
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 4, (400, 5)).astype(np.int32)
    tree = Tree(counts, 10)
    assert sorted(np.concatenate(tree.boxes)) == list(range(400)) and len(tree.boxes) > 30
    for up, down in ((1, 1), (1, 0), (0, 1), (0, 0)):
        met = collections.defaultdict(set)
        for box, rows in tree.search(counts, up, down):
            for r in rows:
                assert not met[r] & set(tree.boxes[box])
                met[r].update(tree.boxes[box])
        gap = counts[None] - counts[:, None]
        wanted = (np.maximum(gap, 0).sum(axis=2) <= up) & (np.maximum(-gap, 0).sum(axis=2) <= down)
        assert all(set(np.flatnonzero(wanted[r])) <= met[r] for r in range(400))
        assert sum(map(len, met.values())) < 400 * 400 / 4


def test_words_and_roots(spark):
    w = Words(["abÿÿ", "zzab"])
    assert w.counts.sum() == 8 and w.counts[0, 0] == 1 and w.counts[0, 89] == 2 and int(w.bits[1]) == 0b11
    chain = [(chr(97 + k), chr(98 + k)) for k in range(9)] + [("x", "j")]
    assert {r["word"]: r["root"] for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {**{chr(97 + k): "j" for k in range(9)}, "x": "j"}


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(empty).count() == 0 and spelling.spelling_variants(spark.createDataFrame([(1, "short words only"), (2, None)], "doc_id long, text string")).count() == 0
