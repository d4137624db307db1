"""Quality scores: gradient by finite differences, passages by a plain form, held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedprofile.llm import quality
from feedprofile.llm.bytestext import slices
from feedprofile.llm.quality import Bags, encode, minimise, score_quality

def learn():
    return F.col("doc_id") % 4 != 2



def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    x, sizes, y, weight = rng.random((12, quality.WIDTH)), np.array([3, 1, 4, 2, 2]), np.array([0, 1, 1, 0, 1]), rng.random(5)
    theta = Bags.start() + 0.1 * rng.normal(size=Bags.SIZE)
    _, slope = Bags(theta).gradient(x, sizes, y, weight)
    for k in [*rng.choice(Bags.SIZE, 15), *range(Bags.SIZE - 80, Bags.SIZE, 9)]:
        step = np.zeros(Bags.SIZE)
        step[k] = 1e-6
        numeric = (Bags(theta + step).gradient(x, sizes, y, weight)[0] - Bags(theta - step).gradient(x, sizes, y, weight)[0]) / 2e-6
        assert slope[k] == pytest.approx(numeric, abs=1e-6)


def test_attention_of_a_plain_loop():
    rng = np.random.default_rng(1)
    x, sizes = rng.random((7, quality.WIDTH)), np.array([4, 1, 2])
    m = Bags(Bags.start())
    h, _, _, s = m.passages(x)
    got, at = m.scores(h, s, sizes), 0
    for k, size in enumerate(sizes):
        reps = [np.tanh(m.w.T @ row + m.b) for row in x[at : at + size]]
        gates = [m.a @ (np.tanh(m.v.T @ r + m.c) / (1 + np.exp(-(m.u.T @ r + m.d)))) for r in reps]
        total = sum(np.exp(g) for g in gates)
        z = sum(np.exp(g) / total * r for g, r in zip(gates, reps, strict=True))
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(m.o @ z + m.e[0]))), rel=1e-12)
        at += size


def test_passages_cover_whole_texts(monkeypatch):
    monkeypatch.setattr(quality, "ENCODED", 3)
    texts = [None, "", " \n", "  one two", "w " * 64, "x y " * 100 + "end", "A" * 500, "é ü" * 70]
    sizes, filled = np.zeros(len(texts), int), np.zeros(len(texts))
    for piece in slices(pa.array(texts), most=300):
        for owner, x in encode(piece):
            sizes += np.bincount(owner + piece.first, minlength=len(texts))
            np.add.at(filled, owner + piece.first, x[:, -2] * quality.PASSAGE)
            assert np.isfinite(x).all() and (x >= 0).all()
    words = [len((t or "").split()) for t in texts]
    assert sizes.tolist() == [max(1, -(-w // 64)) for w in words] and filled.tolist() == words
    # a passage has the same code wherever it stands
    alone = [x for _, x in encode(next(slices(pa.array(["b c " * 32]))))][0]
    later = np.concatenate([x for _, x in encode(next(slices(pa.array(["a " * 64 + "b c " * 32, "z"]))))])
    assert later[1] == pytest.approx(alone[0])


def test_minimise_finds_a_minimum():
    scale = np.array([1.0, 30.0, 0.2])
    theta = minimise(lambda t: (float((scale * (t - 2) ** 2).sum()), 2 * scale * (t - 2)), np.zeros(3), 60, 1e-12)
    assert theta == pytest.approx([2, 2, 2], abs=1e-3)


def documents():
    """Prose, and prose with one passage of junk somewhere; only documents are labelled."""
    rnd = random.Random(9)
    rows, labels = [], []
    for k in range(420):
        words = [rnd.choice("the of and house tree river stone walks under over bright".split()) for _ in range(rnd.randint(80, 500))]
        good = k % 3 != 0
        if not good:
            at = rnd.randint(0, len(words))
            words[at:at] = ["BUY!!", "$$$", "NOW&&"] * 20
        rows.append((k, " ".join(words)))
        labels.append((k, int(good)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = documents()
    odd = [(1000, None), (1001, ""), (1002, "word " * 30_000), (None, rows[0][1]), (rows[5][0], rows[5][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("y", "h", "weight", "x", "score")})
    got = score_quality(docs, spark.createDataFrame([*labels, (0, 1), (3, None), (None, 1)], "doc_id long, quality int"), learn()).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    truth = dict(labels)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 4 == 2 and r["doc_id"] < 420]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert len({r["score"] for r in got if r["doc_id"] == rows[5][0]}) == 1


def test_tables_that_teach_nothing(spark):
    rows, labels = documents()
    docs = spark.createDataFrame(rows[:8], "doc_id long, text string")
    marks = lambda some: spark.createDataFrame(some, "doc_id long, quality int")
    assert {r["score"] for r in score_quality(docs, marks([]), learn()).collect()} == {0.5}
    assert {r["score"] for r in score_quality(docs, marks([(k, 1) for k in range(8)]), learn()).collect()} == {6.5 / 7}
    assert score_quality(docs.limit(0), marks(labels), learn()).count() == 0
