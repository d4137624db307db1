"""Each stage of the pipeline against a plain form of it, on what its predecessor kept."""

import collections
import random

import pytest
from test_learned import text, water_fill
from test_texts import brute_components, brute_terms, plain_spans

import corpus_pipeline
from feedprofile.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(rnd):
    """Documents of four languages with exact and near copies, personal data, texts without letters, a null id."""
    rows = []
    for k in range(240):
        lang = rnd.choice(("en", "de", "fr", "es"))
        body = text(rnd, lang, rnd.randint(20, 90))
        if k % 7 == 0:
            body += f" u{k}@host{k % 3}.org"
        if k % 11 == 0:
            body = f"10.0.{k}.1 " + body
        rows.append([k, body, lang, f"s{k % 4}" if k % 13 else None])
    for k in range(240, 300):
        of = rows[rnd.randrange(240)]
        copy = of[1].split()
        if k % 3:
            copy[rnd.randrange(len(copy))] = "changed"
        rows.append([k, " ".join(copy), of[2], f"s{k % 4}"])
    rows += [[400, None, "en", "s0"], [401, "", None, None], [402, "123 !?", "de", "s1"], [7, rows[7][1], rows[7][2], "s3"], [None, rows[9][1], rows[9][2], "s1"]]
    return [(*r, len(r[1] or "")) for r in rows]


def generalised(texts):
    """Texts with spans of all kinds replaced, from the back; of overlapping spans the first counts."""
    out = []
    for t, terms in zip(texts, brute_terms(texts), strict=True):
        spans, upto = [], 0
        for a, kind, b in sorted([(a, kind, b) for a, _, kind, b in plain_spans(t)] + [(a, "term", b) for a, b in terms]):
            if a >= upto:
                spans.append((a, kind, b))
                upto = b
        for a, kind, b in reversed(spans):
            t = f"{t[:a]}<{kind.upper()}>{t[b:]}"
        out.append(t)
    return out


def test_pipeline_equals_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = made(random.Random(21))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    docs, kept = spark.read.parquet(path), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        kept[name] = [tuple(r) for r in docs.collect()]

    # language: texts without a letter go, all others stay with their language
    want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(kept["language_id"], key=str) == sorted(want, key=str)

    # near-dedup: the row with the least id of each component stays, and rows without an id
    named = sorted((r for r in kept["language_id"] if r[0] is not None), key=lambda r: r[0])
    heads = {named[c][0] for _, c in brute_components([r[1] for r in named], 5, 80)}
    stay = kept["near_dedup"]
    assert len(heads) < len(named) - 40 and sorted(r[0] for r in stay if r[0] is not None) == sorted(heads) and sum(r[0] is None for r in stay) == 1
    assert {r[:3] for r in stay} <= {r[:3] for r in kept["language_id"]}

    # personal data: only the spans change
    before = sorted(stay, key=str)
    texts = generalised([r[1] for r in before])
    want = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(before, texts, strict=True)]
    assert sorted(kept["personal_data"], key=str) == sorted(want, key=str) and sum("<EMAIL>" in t for t in texts) > 20

    # mixing: whole copies, at most three, near each source's target
    copies = collections.Counter(kept["mixing"])
    clean = kept["personal_data"]
    assert set(copies) <= set(clean) and max(copies.values()) <= 3
    order = sorted({r[3] for r in clean if r[3] is not None}) + [None]
    size = {s: sum(len(r[1].split()) for r in clean if r[3] == s) for s in order}
    target = water_fill([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])
    for s, goal in zip(order, target, strict=True):
        assert abs(sum(n * len(r[1].split()) for r, n in copies.items() if r[3] == s) - goal) <= max(90, 0.02 * goal)

    # packing: all ids of every copy, in windows that hold 1024 at most
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = collections.Counter()
    for r, n in copies.items():
        ids[r[0]] += n * (len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got, windows = collections.Counter(), collections.Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
        windows[r["sequence_id"]] += r["length"]
    assert got == ids and max(windows.values()) <= 1024
    assert sum(windows.values()) >= 0.9 * sum(n if n in (128, 256, 512) else 1024 for n in windows.values())


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "a", 0)], [(None, None, None, None, None), (2, "", None, None, 0)]])
def test_pipeline_on_nearly_nothing(spark, tmp_path, rows):
    """Tables without a text that has a letter give no rows."""
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
