"""Classifiers, mixing, and the pipeline."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedprofile.llm import stages
from feedprofile.llm.bytestext import slices
from feedprofile.llm import language
from feedprofile.llm.language import identify
from feedprofile.llm.mixing import mix, settle
from feedprofile.llm.text_dedup import near_texts
from feedprofile.llm.toxicity import CORRELATED, EM_STEPS, SURE_CORRELATED, fit, label_model, score_toxicity, text_features

SYLLABLES = {"en": "the and ing er ou th ly", "de": "der sch ich ung keit ein", "fr": "eau le oi tion ê aux", "es": "ción ado os ña el ll"}


def text(rnd, lang, n=60):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(8)
    rows = [(k, text(rnd, lang := rnd.choice(list(SYLLABLES))), lang, f"s{k % 3}" if k % 11 else None, 0) for k in range(300)]
    rows += [(900, None, "en", "s0", 0), (901, "", None, None, 0), (902, "123 !?", "de", "s1", 0), (5, rows[5][1], rows[5][2], rows[5][3], 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


def test_language(spark, docs):
    got = identify(docs.withColumn("score", F.lit(1)), F.col("doc_id") % 3 != 1).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] % 3 == 1 and r["doc_id"] < 900]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert {r["lang_pred"] for r in got if r["doc_id"] >= 900} == {"und"}
    assert identify(docs.where("doc_id < 0"), F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in identify(docs, F.lit(False)).collect()} == {"und"}


def test_language_fit_is_sparse_on_the_driver(spark):
    rnd = random.Random(9)
    rows = [(k, text(rnd, lang, 20), lang) for k, lang in enumerate(list(SYLLABLES) * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    try:
        fitted = language.fit(docs, F.lit(True), 500)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # one dense sample would take 2000 * 4096 * 4 bytes
    assert len(fitted.pairs) == 3 and most < 20e6


def test_language_machine_equals_a_dense_one():
    rng = np.random.default_rng(4)
    y = np.where(np.arange(600) % 3 > 0, 1, -1).astype(np.float32)
    rows = [(np.sort(rng.choice(np.arange(0 if s > 0 else 20, 60), 9, replace=False)).astype("<u2"), rng.integers(1, 5, 9).astype("<f4")) for s in y]
    x = np.zeros((len(y), language.DIMENSIONS))
    for k, (at, n) in enumerate(rows):
        x[k, at] = np.sqrt(n / n.sum())
    x = np.hstack([x, np.ones((len(y), 1))])
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    w = ahead = np.zeros(x.shape[1])
    for k in range(150):
        now = ahead - 0.25 * (1e-4 * ahead - 2 * x.T @ (share * y * np.maximum(0, 1 - y * (x @ ahead))))
        ahead, w = now + k / (k + 3) * (now - w), now
    weights, bias = language.fit_svm(rows, y)
    assert np.abs(weights - w[:-1]).max() < 1e-3 and abs(bias - w[-1]) < 1e-3


def test_toxicity(spark):
    rnd = random.Random(3)
    bad = ("clodpole", "numskull", "dunderhead")
    rows, marks = [], []
    for k in range(400):
        words = text(rnd, "en", 50).split()
        if toxic := k % 4 == 0:
            for _ in range(rnd.randint(1, 4)):
                words[rnd.randrange(50)] = rnd.choice(bad)
        rows.append((k, " ".join(words)))
        if k % 3:
            marks.append((k, int(toxic)))
    rows += [(1000, None), (1001, ""), (0, rows[0][1])]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks + [(7, None), (None, 1)], "doc_id long, toxic int")
    got = score_toxicity(docs, labels, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["doc_id"] % 5 == 0 and r["doc_id"] < 1000]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)
    assert {r["predicted"] for r in got if r["doc_id"] >= 1000} == {0}
    assert {r["score"] for r in score_toxicity(docs, labels.where("doc_id < 0"), F.lit(True)).collect()} == {0.0}
    assert score_toxicity(docs.where("doc_id < 0"), labels, F.lit(True)).count() == 0


def test_toxicity_learns_from_all_labelled_rows(spark):
    """A toxic word too rare for the sample of the linear fit is learned from the counts of all rows."""
    rnd = random.Random(6)
    rows = []
    for k in range(1500):
        words = text(rnd, "en", 12).split()
        if k % 5 == 1:
            words[rnd.randrange(12)] = "grobian" if k % 75 == 1 else "numskull"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 1)) for k in range(1500)], "doc_id long, toxic int")
    model = fit(docs, labels, F.lit(True), labelled=60).ready()
    new = pa.array([text(rnd, "en", 6) + " grobian " + text(rnd, "en", 5) for _ in range(40)])
    assert (model.score(next(slices(new))) >= 0.5).mean() >= 0.9


def plain_label_model(rows, side, share):
    """The label model row by row, in plain Python: ``rows`` are (fired, given or -1)."""
    n, on, off, trust = len(side), None, None, 0.95
    rho = [[0.0] * n for _ in side]
    weight = [1.0] * n

    def posterior(fired, given):
        if on is None:
            return share if given < 0 else float(given)
        score = math.log(share / (1 - share))
        for i in range(n):
            if fired[i]:
                score += math.log(on[i] / off[i]) / (1 + sum(rho[i][j] for j in range(n) if fired[j]))
            else:
                score += weight[i] * math.log((1 - on[i]) / (1 - off[i]))
        if given >= 0:
            score += (1 if given else -1) * math.log(trust / (1 - trust))
        return 1 / (1 + math.exp(-score))

    for _ in range(2):
        used = [(f, g, posterior(f, g)) for f, g in rows if on is not None or g >= 0]
        for i in range(n):
            for j in range(n):
                top = below = 0.0
                for side_of in (lambda p: p, lambda p: 1 - p):
                    mass = sum(side_of(p) for _, _, p in used)
                    a, b, c = (sum(side_of(p) for f, _, p in used if f[x] and f[y]) for x, y in ((i, i), (j, j), (i, j)))
                    spread = math.sqrt(max(a / mass * (1 - a / mass), 1e-12) * max(b / mass * (1 - b / mass), 1e-12))
                    phi = (c / mass - a * b / mass**2) / spread
                    if phi >= max(CORRELATED, SURE_CORRELATED / math.sqrt(mass)):
                        top += min(phi, 1.0) * (a + b)
                    below += a + b
                rho[i][j] = top / below if i != j and below else 0.0
        meet = lambda i, j: sum(1 for f, _, _ in used if f[i] and f[j])
        weight = [1 / (1 + sum(rho[i][j] * meet(i, j) for j in range(n)) / meet(i, i)) for i in range(n)]
        for _ in range(EM_STEPS):
            used = [(f, g, posterior(f, g)) for f, g in rows if on is not None or g >= 0]
            total, positive = len(used), sum(p for _, _, p in used)
            fired = [(sum(p for f, _, p in used if f[i]), sum(1 - p for f, _, p in used if f[i])) for i in range(n)]
            known = [p if g else 1 - p for _, g, p in used if g >= 0]
            before, on, off = on, [(a + 0.5) / (positive + 1) for a, _ in fired], [(b + 0.5) / (total - positive + 1) for _, b in fired]
            for i in range(n):
                if side[i] * (on[i] - off[i]) < 0:
                    on[i] = off[i] = (sum(fired[i]) + 0.5) / (total + 1)
            share, trust = positive / total, (sum(known) + 95) / (len(known) + 100)
            if before and max(abs(math.log(x / y)) for x, y in zip(on, before, strict=True)) < 1e-3:
                break
    return on, off, share, trust, rho


def test_label_model_is_that_of_plain_python(spark):
    """Voters of both sides, copies of a voter, one that fires at random, rows without labels, empty and null texts."""
    rnd = random.Random(4)
    words = ["bad", "badly", "nice", "kind", "vile", "noise"]
    rows = []
    for k in range(240):
        toxic = rnd.random() < 0.3
        bad = rnd.random() < (0.7 if toxic else 0.05)
        fires = [bad, bad and rnd.random() < 0.95, rnd.random() < (0.1 if toxic else 0.6), rnd.random() < (0.2 if toxic else 0.5), rnd.random() < (0.4 if toxic else 0.02), rnd.random() < 0.3]
        given = -1 if k % 3 == 0 else int(toxic if rnd.random() < 0.97 else not toxic)
        rows.append((" ".join(w for w, f in zip(words, fires, strict=True) if f), given))
    rows += [("", -1), (None, -1), ("x " * 40_000 + "bad", 1)]
    hashes = [text_features(next(slices(pa.array([w]))))[0] for w in words]
    # a hash that no other word has stands for the word
    own = np.array([next(int(h) for h in x if all(h not in y for y in hashes if y is not x)) for x in hashes], np.uint64)
    order = np.argsort(own)
    side = np.array([1, 1, -1, -1, 1, 1])[order]
    table = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    model = label_model(table, own[order], side, 0.3)
    plain = [([words[i] in (t or "").split() for i in order], g) for t, g in rows]
    on, off, share, trust, rho = plain_label_model(plain, side, 0.3)
    assert model.on == pytest.approx(on, rel=1e-4) and model.off == pytest.approx(off, rel=1e-4)
    assert (model.share, model.trust) == pytest.approx((share, trust), rel=1e-4)
    assert model.rho == pytest.approx(np.array(rho), abs=1e-4)
    at = {words[i]: k for k, i in enumerate(order)}
    assert model.rho[at["bad"], at["badly"]] > 0.5 and model.rho[at["nice"], at["vile"]] == 0
    assert model.odds()[at["nice"]] < -0.5 < 0.5 < model.odds()[at["vile"]]


def test_toxicity_has_voters_for_clean_texts(spark):
    """Where some words mark clean texts, they vote for these; columns named as the new ones are replaced."""
    rnd = random.Random(12)
    rows = []
    for k in range(600):
        words = text(rnd, "en", 12).split()
        words[rnd.randrange(12)] = "numskull" if k % 3 == 0 else "please"
        rows.append((k, " ".join(words), 5.0))
    docs = spark.createDataFrame(rows + [(600, "word " * 50_000 + "please", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(0, 600, 2)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, labels, F.lit(True)).collect()}
    assert len(got) == 601 and all((got[k] >= 0.5) == (k % 3 == 0) for k in range(600)) and got[600] < 0.5


def water_fill(sizes, weights, most=3):
    total, capped = sum(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        level = (total - sum(most * sizes[k] for k in capped)) / sum(weights[k] for k in free) if free else 0
        over = {k for k in free if weights[k] * level > most * sizes[k]}
        if not over:
            return [most * sizes[k] if k in capped else weights[k] * level for k in range(len(sizes))]
        capped |= over


def test_mixing(spark):
    rnd = random.Random(1)
    names = ["b", "a", "Z", "é", None, "\U0001f600", ""]
    rows = [(k, " ".join("w" for _ in range(rnd.randint(0, 120))), names[min(int(rnd.expovariate(0.6)), 6)], 1) for k in range(1500)]
    rows += [(2000, None, "b", 1), (1, rows[1][1], rows[1][2], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    order = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: [ord(c) for c in s]) + [None]
    size = {s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in order}
    target = dict(zip(order, water_fill([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {size[s]} and own[0]["target"] == pytest.approx(target[s], rel=1e-9)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(min(len((r[1] or "").split()) or 120 for r in rows if r[2] == s), 0.005 * target[s])
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in got)
    again = sorted(map(tuple, mix(docs.repartition(7)).select("doc_id", "source", "size", "taken").collect()), key=str)
    assert again == sorted(((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got), key=str)
    assert mix(docs.where("doc_id < 0")).count() == 0


def test_settling_a_source():
    """Against the best of all ways to give a few documents their copies; sizes of 1 let every gap be met."""
    rnd = random.Random(5)
    for _ in range(60):
        size = np.array(sorted((rnd.choice([1, 2, 5, 30, 31, 200]) for _ in range(5)), reverse=True))
        held = np.array([rnd.randint(0, 3) for _ in size])
        gap = rnd.uniform(-220, 220)
        move = settle(size, held, gap)
        assert ((held + move >= 0) & (held + move <= 3)).all()
        left = abs(gap - (move * size).sum())
        best = min(abs(gap - sum((c - h) * s for c, h, s in zip(some, held, size, strict=True))) for some in itertools.product(range(4), repeat=5))
        assert best <= left <= abs(gap) and left <= best + size.max() / 2
    many = np.array([500, 90, 20, 7, 3, 2, 1, 1, 1])
    assert abs(412.3 - (settle(many, np.ones(9, int), 412.3) * many).sum()) < 0.5
    assert not settle(many, np.full(9, 3), 400.0).any() and not settle(many, np.zeros(9, int), -400.0).any()
    assert len(settle(np.array([], int), np.array([], int), 3.0)) == 0


def test_stages(spark, docs):
    kept = stages.with_language(docs.withColumn("score", F.lit(7)), languages=("de", "fr"))
    assert kept.columns == [*docs.columns, "score"] and {(r["lang"], r["score"]) for r in kept.select("lang", "score").distinct().collect()} == {("de", 7), ("fr", 7)}
    named = stages.with_language(docs)
    assert named.columns == docs.columns and named.count() == 301
    once = stages.one_of_each_group(named)
    assert once.columns == docs.columns and once.count() == 300 and once.select("doc_id").distinct().count() == 300
    rows = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.concat("text", F.lit(" a@b.org"))).otherwise(F.col("text")))
    clean = {r["doc_id"]: r for r in stages.without_personal_data(rows).collect()}
    assert clean[3]["text"].endswith(" <EMAIL>") and clean[3]["n_chars"] == len(clean[3]["text"])
    again = stages.mixed(once.withColumns({"_copy": F.lit(3), "_s": F.lit(4), "rate": F.lit("r")}))
    assert again.columns == [*docs.columns, "_copy", "_s", "rate"] and {tuple(r) for r in again.select("_copy", "_s", "rate").distinct().collect()} == {(3, 4, "r")}


def test_repeated_ids_with_unlike_texts_stay(spark):
    """Of rows with one id, only those go whose text is linked to that of a row that stays."""
    one, two, three = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, one), (5, two), (5, one), (5, three), (5, three), (6, three + " more"), (7, two), (5, two + " more"), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in stages.one_of_each_group(docs).collect()]
    assert len(got) == 4 and {(1, one), (5, three), (None, one)} < set(got)
    assert len({(5, two), (5, two + " more")} & set(got)) == 1
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in near_texts(docs, 5, 80).collect())
    assert found == [(0, 0), (1, 1), (5, 1), (5, 5), (5, 5), (5, 5), (5, 5), (6, 5), (7, 5)]


def test_pipeline_runs_whole(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "personal_data", "mixing", "packing"]
    assert got.count() > 100 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    docs.where("doc_id < 0").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
