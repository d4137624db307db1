"""Text operators against brute force, and on nulls, empty and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedprofile.llm import repeats
from feedprofile.llm.bytestext import slices
from feedprofile.llm.lm_scoring import ByteModel, score_texts
from feedprofile.llm.packing import pack
from feedprofile.llm.pii import digest, find_personal_data, sanitize
from feedprofile.llm.queries import fold
from feedprofile.llm.text_dedup import likely, near_texts, sketch
from feedprofile.llm.tokens import tokenizer_path

DOCS = "doc_id long, text string"


def words(rnd, n):
    return " ".join(rnd.choice(("alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta")) + str(rnd.randint(0, 30)) for _ in range(n))


def near_copies(rnd):
    texts = []
    for _ in range(12):
        base = words(rnd, rnd.randint(1, 120)).split()
        for _ in range(rnd.randint(1, 8)):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = "changed" + str(rnd.randint(0, 5))
            texts.append(" ".join(copy))
    return [*texts, None, "", " \t\n", "one", "ONE", "one two", texts[0], texts[0].upper()]


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                common = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return [(len(s), c) for s, c in zip(sets, low, strict=True)]


@pytest.mark.parametrize("size", [4, 5])
def test_near_texts_equal_brute_force(spark, size):
    texts = near_copies(random.Random(size))
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], DOCS + ", band int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_texts(docs, size, 80).collect()}
    assert got == {k: (n, c, c == k) for k, (n, c) in enumerate(brute_components(texts, size, 80))}


def test_near_texts_families_keep_every_link(spark):
    """A chain in which few texts resemble the least one: links between other members must not be lost."""
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    texts, now = [], list(base)
    for _ in range(40):
        texts.append(" ".join(now))
        now[rnd.randrange(60)] = f"x{rnd.randint(0, 10**6)}"
    rnd.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: r["component_id"] for r in near_texts(docs, 4, 80).collect()}
    assert got == {k: c for k, (_, c) in enumerate(brute_components(texts, 4, 80))}


def test_near_texts_empty_and_repeated(spark):
    assert near_texts(spark.createDataFrame([], DOCS)).count() == 0
    rows = near_texts(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(0, 0), (1, 1), (1, 1), (2, 2)]


def test_sketches_agree_as_often_as_sets():
    rng = np.random.default_rng(3)
    common, own = rng.integers(1, 2**63, 800, dtype=np.uint64), rng.integers(1, 2**63, (2, 100), dtype=np.uint64)
    both = sketch(np.concatenate([common, own[0], common, own[1]]), np.array([900, 900]), 4096)
    assert abs((both[0] == both[1]).mean() - 0.8) < 0.03
    merged = sketch(np.concatenate([common, own[0], own[1]]), np.array([1000]), 4096)
    joined = np.maximum(both[0], both[1])
    assert (merged[0] == joined).mean() > 0.999
    n = np.array([900.0])
    assert likely(both[:1], both[1:], n, n, 0.8)[0] and not likely(both[:1], rng.permutation(both[1:].T).T, n, n, 0.8)[0]


def brute_repeats(texts):
    size, counts = repeats.LENGTH, collections.Counter()
    for t in texts:
        counts.update(t[p : p + size] for p in range(len(t) - size + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if counts[t[p : p + size]] > 1:
                covered[p : p + size] = b"\1" * size
        spans = sum(1 for k in range(len(t)) if covered[k] and (k == 0 or not covered[k - 1]))
        out.append((len(t), sum(covered), spans, hashlib.sha256(bytes(b for b, c in zip(t, covered, strict=True) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [4096, 4])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rnd = random.Random(crowd)
    draw = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passages = [draw(k) for k in (399, 400, 401, 450, 900, 2000)]
    texts = []
    for _ in range(60):
        text = draw(rnd.randint(0, 300))
        for _ in range(rnd.randint(0, 3)):
            q = rnd.choice(passages)
            text += q[rnd.randint(0, 150) : len(q) - rnd.randint(0, 150)] + draw(rnd.randint(0, 50))
        texts.append(text)
    texts += ["a" * 1500, "ab" * 450, None, "", texts[3], texts[3], "y" * 400, "z" * 401]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], DOCS + ", h1 int")
    got = {r["doc_id"]: tuple(r)[1:5] for r in repeats.remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute_repeats([(t or "").encode() for t in texts])))


def test_shared_passages_equal_brute_force(spark):
    """Runs of fifty words that another document has too, whatever the spacing and however short their bytes."""
    rnd = random.Random(12)
    draw = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 99)}" for _ in range(n)]
    held = [draw(n) for n in (25, 49, 50, 51, 70)]
    texts = []
    for k in range(80):
        own = draw(rnd.randint(0, 120))
        if k % 2:
            at = rnd.randint(0, len(own))
            own[at:at] = rnd.choice(held)
        texts.append(rnd.choice((" ", "\n", "  ")).join(own))
    twice, short = draw(60), draw(55)
    texts += [" ".join(twice + draw(3) + twice), " ".join(short), " ".join(short), None, "", "a b", " ".join(w.upper() for w in held[4])]
    parts = [t.split() for t in map(lambda t: t or "", texts)]
    where = collections.defaultdict(set)
    for k, ws in enumerate(parts):
        for at in range(len(ws) - 49):
            where[tuple(ws[at : at + 50])].add(k)
    want = {k for ks in where.values() if len(ks) > 1 for k in ks}
    got = {r["doc_id"]: (r["has_passage"], r["n_spans"]) for r in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert {k for k, (p, n) in got.items() if p and not n} == {k for k in want if not got[k][1]} and all(p for p, n in got.values() if n)
    assert any(not n and p for p, n in got.values()) and sum(p for p, _ in got.values()) < 60


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_merged_transforms_sort_like_one():
    rng = np.random.default_rng(1)
    strings = [np.append(rng.integers(1, 4, rng.integers(3, 30)), 0) for _ in range(12)]
    whole = np.concatenate(strings)
    starts = np.cumsum([0] + [len(s) for s in strings])
    parts = [[k for k in range(12) if k % 3 == j] for j in range(3)]
    turned, places = [], []
    for part in parts:
        joined, lengths = np.concatenate([strings[k] for k in part]), np.array([len(strings[k]) for k in part])
        order, before = repeats.transform(joined, lengths)
        spots = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in part])
        turned.append(before)
        places.append(spots[order])
    shard, interval = repeats.merge(turned, 5)
    place = np.empty(len(shard), int)
    place[np.argsort(shard, kind="stable")] = np.concatenate(places)

    def prefix(p):
        k = np.searchsorted(starts, p, "right") - 1
        s = strings[k]
        return tuple(int(s[(p - starts[k] + j) % len(s)]) for j in range(5))

    prefixes = [prefix(p) for p in place]
    assert sorted(place) == list(range(len(whole))) and prefixes == sorted(prefixes)
    assert [a == b for a, b in zip(prefixes, prefixes[1:], strict=False)] == list(interval[1:] == interval[:-1])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for rank, kind in enumerate(PATTERNS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15
            if not bad:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_personal_data_equal_plain_patterns(spark):
    rnd = random.Random(2)
    texts = ["a@b.c", "x.y@z.com. and", "a@b.c..d", "a@b.c_foo@z.com x", "a@b.c@d.e", "a@@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.1.1.001", "1.2.3.4é 1.2.3.4", "4111 1111 1111 1111", "4111  1111",
             "+1 (555) 123-4567", "+4(((((((", "\U0001f600 a@b.co \U0001f600 4111111111111111", None, "", "9" * 5000, "a." * 3000 + "@" + "b." * 5000 + "c", "1-" * 4000 + "1", "+1" + "(0)" * 5000]
    texts += ["".join(rnd.choice("a1.@+- 9(") for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for r in digest(find_personal_data(docs)).collect():
        spans = plain_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert r["spans"] == joined and r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), texts[r["doc_id"]]
        assert tuple(r[f"n_{k}"] for k in PATTERNS) == tuple(sum(s[2] == k for s in spans) for k in PATTERNS)


def brute_terms(texts):
    """Term spans of all texts, by counting over differing texts."""
    from feedprofile.llm import pii

    differing = list(dict.fromkeys(t or "" for t in texts))
    held, words = {}, {}
    for t in differing:
        spans, outside = plain_spans(t), t
        for a, _, _, b in reversed(spans):
            outside = outside[:a] + " " + outside[b:]
        words[t] = {w.lower() for w in re.findall(r"[^\W\d_]{3,}", outside)}
        held[t] = set()
        for a, _, kind, b in spans:
            digits = re.sub("[^0-9]", "", t[a:b])
            group = {"email": t[a:b].lower().split("@")[-1], "ip": ".".join(t[a:b].split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
            held[t] |= {kind, f"{kind}~{group}", f"{kind}={t[a:b].lower()}"}
    df_entity = collections.Counter(e for t in differing for e in held[t])
    df_term = collections.Counter(w for t in differing for w in {x.lower() for x in re.findall(r"[^\W\d_]{3,}", t)})
    both = collections.Counter((e, w) for t in differing for e in held[t] for w in words[t])
    told = set()
    for (e, w), n in both.items():
        base = df_entity[e] / len(differing)
        share = (n + pii.PRIOR * base) / (df_term[w] + pii.PRIOR)
        if n >= pii.LEAST_TEXTS and share >= pii.CERTAINTY and math.log2(share / base) >= pii.DISCLOSURE * math.log2(1 / base):
            told.add((e, w))
    out = []
    for t in texts:
        t = t or ""
        spans = plain_spans(t)
        terms = {w for e, w in told if e in held[t] and w in words[t]}
        out.append({(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t) if m[0].lower() in terms and not any(a < m.end() and b > m.start() for a, _, _, b in spans)})
    return out


def test_disclosing_terms_and_sanitising(spark):
    """The name beside an address that recurs, and the word that tells of mail, disclose them, as a count in Python finds."""
    rnd = random.Random(4)
    texts = [f"{words(rnd, 20)} now {k}. Quibblewick of " + words(rnd, 30) + " asks q@x.org" for k in range(6)]
    texts += [f"{words(rnd, 20)} mailto u{k}@host{k % 2}.org" for k in range(6)] + [words(rnd, 20) + " plain now" for _ in range(400)] + [None, ""]
    texts += [texts[0], texts[-3], texts[0]]
    docs = spark.createDataFrame([(k, t, k, 1) for k, t in enumerate(texts)], DOCS + ", base int, _terms int")
    found = {r["doc_id"]: r for r in find_personal_data(docs).collect()}
    want = brute_terms(texts)
    for k, r in found.items():
        assert {(s["start"], s["stop"]) for s in r["all_spans"] if s["kind"] == "term"} == want[k], texts[k]
        assert [s for s in r["all_spans"] if s["kind"] != "term"] == r["base"] and r["_terms"] == 1
    a = texts[0].index("Quibblewick")
    assert (a, a + 11) in want[0] and sum(map(len, want)) >= 12 and not any(want[12:-3])
    clean = {r["doc_id"]: (r["text"], r["base"]) for r in sanitize(docs).collect()}
    assert "<TERM> of " in clean[0][0] and clean[0][0].endswith("<EMAIL>") and clean[0][1] == 0
    assert all(clean[k][0] == texts[k] for k in range(12, len(texts) - 3))
    assert sanitize(spark.createDataFrame([], DOCS)).count() == 0


def test_lm_base_scores_equal_brute_force(spark, monkeypatch):
    from feedprofile.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "HOT", 40)
    rnd = random.Random(9)
    texts = [words(rnd, rnd.randint(0, 60)) for _ in range(60)] + [None, "", "  ", "é ü\x00z", "x" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    tokens = [re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0"] for t in texts]
    counts = collections.Counter(x for k, ts in enumerate(tokens) if zlib.crc32(str(k).encode()) % 5 != 1 for x in ts)
    total, kinds = sum(counts.values()), len(counts)
    rows = score_texts(docs, fold(5) != 1, ["doc_id"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ts = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(x in counts for x in ts), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in ts), rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert score_texts(spark.createDataFrame([], DOCS), F.lit(True), ["doc_id"]).count() == 0


def test_lm_counts_words_of_a_last_long_text(spark):
    """Words are summed up now and then; what was summed up at a task's very end counts too."""
    texts = ["few words", "a b " * 150_000]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(1)
    got = {r["doc_id"]: r for r in score_texts(docs, F.lit(True), ["doc_id"]).collect()}
    assert [tuple(got[k][c] for c in ("n_tokens", "n_known", "train_tokens")) for k in (0, 1)] == [(3, 3, 300_004), (300_001, 300_001, 300_004)]
    each = math.log10(1.5) * 2 + math.log10(2.5) - 3 * math.log10(300_004 + 0.5 * 6)
    assert got[0]["base_score"] == pytest.approx(each, rel=1e-9)


@pytest.mark.parametrize("hot", [1 << 21, 30, 0])
def test_lm_scores_use_every_context_across_words(spark, monkeypatch, hot):
    """Scores equal one undivided model of all grams of whole texts, however few of them are broadcast."""
    import pyarrow as pa

    from feedprofile.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "HOT_GRAMS", hot)
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 500)
    rnd = random.Random(3)
    texts = [words(rnd, rnd.randint(0, 30)) for _ in range(50)] + [None, "", "one two three", "three two one", "one two three", "one two three", "é\nü"]
    learn = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 5 != 1]

    def of(text):
        data = np.frombuffer((text or "").encode() + b"\0", np.uint8)
        return lm_scoring.grams(data, np.array([len(data)]))

    every = np.concatenate([of(texts[k]) for k in learn])
    keys, counts = np.unique(every, return_counts=True)
    model = ByteModel((keys, counts), (keys, counts))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, fold(5) != 1, ["doc_id"]).collect()}
    for k, text in enumerate(texts):
        assert got[k] == pytest.approx(model.log_probabilities(of(text)).sum(), rel=1e-6)
    assert got[52] != pytest.approx(got[53], rel=1e-3)


class PlainPpm:
    """Prediction by partial matching byte by byte over dictionaries, in plain Python."""

    def __init__(self, texts, order, dense):
        self.order, self.dense = order, dense
        self.seen = collections.defaultdict(collections.Counter)
        for text in texts:
            data = bytes(order) + text
            for at in range(order, len(data)):
                for k in range(order + 1):
                    self.seen[data[at - k : at]][data[at]] += 1

    def short(self, context):
        """All bytes' probabilities after a short context: each escape leaves the bytes seen so far out of what follows."""
        out, mass, left = {}, 1.0, set(range(256))
        for k in range(len(context), -1, -1):
            open_ = {b: c for b, c in self.seen.get(context[len(context) - k :], {}).items() if b in left}
            total = sum(open_.values())
            for b, c in open_.items():
                out[b] = mass * (c - 0.5) / total
            if total:
                mass *= len(open_) / (2 * total)
            left -= set(open_)
        for b in left:
            out[b] = mass / len(left)
        whole = sum(out.values())
        return {b: p / whole for b, p in out.items()}

    def probability(self, context, byte):
        if len(context) <= self.dense:
            return self.short(context)[byte]
        seen = self.seen.get(context)
        if not seen:
            return self.probability(context[1:], byte)
        total = sum(seen.values())
        if byte in seen:
            return (seen[byte] - 0.5) / total
        unseen = 1 - sum(self.probability(context[1:], b) for b in seen)
        return len(seen) / (2 * total) * self.probability(context[1:], byte) / max(unseen, 1e-9)

    def score(self, text):
        data = bytes(self.order) + text
        return sum(math.log10(self.probability(data[at - self.order : at], data[at])) for at in range(self.order, len(data)))


@pytest.mark.parametrize("hot", [1 << 21, 25])
def test_lm_scores_equal_a_plain_model(spark, monkeypatch, hot):
    """Scores equal a model that shares no code with the operator, repeated, empty and unseen texts among them."""
    from feedprofile.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "HOT_GRAMS", hot)
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 300)
    rnd = random.Random(12)
    texts = [words(rnd, rnd.randint(0, 12)) for _ in range(25)] + [None, "", "abab abab", "abab abab", "zq\u00e9 \n\tzq"]
    raw = [(t or "").encode() + b"\0" for t in texts]
    plain = PlainPpm([raw[k] for k in range(len(raw)) if zlib.crc32(str(k).encode()) % 5 != 1], lm_scoring.ORDER, lm_scoring.DENSE)
    got = {r["doc_id"]: r["score"] for r in score_texts(spark.createDataFrame(list(enumerate(texts)), DOCS), fold(5) != 1, ["doc_id"]).collect()}
    for k, data in enumerate(raw):
        assert got[k] == pytest.approx(plain.score(data), rel=1e-5), texts[k]


def test_frequent_rows_stay_within_their_bound(spark):
    """However many rows share a large count, no more than the bound are taken for frequent."""
    from feedprofile.llm.lm_scoring import _least

    for counts, most, kept in (
        ([200_000 + k for k in range(50)], 3, 0), ([10**12] * 5 + [7] * 4, 4, 0), ([10**12] * 3 + [10**6] * 5 + [7] * 4, 4, 3), ([2**62, 2**40 - 1, 2**40, 5, 4, 0], 4, 4),
        ([3, 2, 2, 1], 3, 3), ([3, 2, 2, 1], 2, 1), ([], 2, 0), ([0, 0, 9], 0, 0),
    ):
        rows = spark.createDataFrame([(c,) for c in counts], "c long")
        assert rows.where(F.col("c") >= _least(rows, "c", most)).count() == kept <= most


def test_counts_of_grams_are_kept_whole():
    from feedprofile.llm.lm_scoring import _read, _run

    for counts in ([6_000_000_000, 1, 0], [1, 255], [0], [256], [2**62, 3]):
        keys = np.arange(len(counts), dtype=np.uint64) + np.uint64(2**55)
        got = _read(_run(keys, np.array(counts, np.int64)))
        assert got[0].tolist() == keys.tolist() and got[1].tolist() == counts


def test_lm_looks_grams_up_once_and_in_ascending_order():
    """A slice's grams are looked up distinct and ascending, which keeps the reads near each other; sums and rare grams are those of each text."""
    import pyarrow as pa

    from feedprofile.llm import lm_scoring

    asked = []

    class Watched(np.ndarray):
        def searchsorted(self, keys, *args, **kwargs):
            asked.append(np.asarray(keys))
            return np.asarray(self).searchsorted(keys, *args, **kwargs)

    rnd = random.Random(17)
    texts = [words(rnd, rnd.randint(0, 9)) for _ in range(600)] + [None, "", "same text", "same text", "a\x00b", "\x00\x00", "\u00e9" * 700]
    rnd.shuffle(texts)

    def of(text):
        data = bytes(lm_scoring.ORDER) + (text or "").encode() + b"\0"
        return [int.from_bytes(data[at : at + lm_scoring.ORDER + 1], "big") for at in range(len(data) - lm_scoring.ORDER)]

    value = {g: -rnd.random() for g in {g for t in texts for g in of(t)} if rnd.random() < 0.7}
    keys = np.array(sorted(value), np.uint64)
    hot = keys.view(Watched), np.array([value[int(k)] for k in keys])
    done = 0
    for piece in slices(pa.array(texts), lm_scoring.SCORED_BYTES, getattr(lm_scoring, "SCORED_TEXTS", 256)):
        sums, left = lm_scoring._text_scores(hot, piece)
        for text, total, rare in zip(texts[piece.first :], sums, left.to_pylist()):
            assert total == pytest.approx(sum(value.get(g, 0.0) for g in of(text)), rel=1e-9)
            assert sorted(rare) == sorted(g for g in of(text) if g not in value)
            done += 1
    assert done == len(texts) and len(asked) == 3
    assert all((k[1:] > k[:-1]).all() for k in asked)


def test_lm_counts_merge_with_further_keys():
    from feedprofile.llm.lm_scoring import _merged

    rnd = np.random.default_rng(8)
    held, want = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), collections.Counter()
    for size, most in ((0, 9), (50, 30), (1, 3), (400, 900), (0, 9), (30, 2**56)):
        fresh = [rnd.integers(0, most, size, dtype=np.uint64) for _ in range(2)]
        want.update(int(k) for part in fresh for k in part)
        held = _merged(held, fresh)
        assert held[0].tolist() == sorted(want) and held[1].tolist() == [want[k] for k in sorted(want)] and not fresh


def test_byte_model_is_a_distribution():
    """Probabilities of all bytes after any context add to one."""
    from feedprofile.llm import lm_scoring

    import pyarrow as pa

    piece = next(slices(pa.array(["the cat sat on the mat", "the hat and the bat", "a cathedral that chatters"] * 3)))
    found = lm_scoring.units(piece)
    times = np.bincount(found.which, minlength=len(found.hashes))
    sizes = np.diff(np.concatenate(([0], found.ends)))
    keys, counts = lm_scoring._summed(lm_scoring.grams(found.data, found.ends), np.repeat(times, sizes))
    short = lm_scoring._summed(keys & np.uint64((1 << 32) - 1), counts)
    model = ByteModel(short, (keys, counts))
    for context in (b"\0\0\0\0\0\0", b"\0\0\0\0th", b"cathed", b"\0\0chat", b"zzzzzz", b"\0\0\0the"):
        base = int.from_bytes(context, "big") << 8
        p = 10.0 ** model.log_probabilities(np.array([base + b for b in range(256)], np.uint64))
        assert p.sum() == pytest.approx(1, abs=1e-5), context


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(6)
    texts = [words(rnd, rnd.randint(0, 700)) + rnd.choice((".", "!\n", "")) for _ in range(40)] + [None, "", "  a  b\n\nc d 　x", "it's I'll\tx'S 12 é\né", "<|endoftext|> hi", "q" * 9000, " "]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(None, "null id", 0)], DOCS + ", start int").repartition(3)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    rows = pack(docs).collect()
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert set(pieces) == {*range(len(texts)), None}
    for k, own in pieces.items():
        ids = tokenizer.encode("null id" if k is None else texts[k] or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 1024
    assert pack(spark.createDataFrame([], DOCS)).count() == 0


def cheapest(places, costs, window, unpadded):
    """Least cost of all lists of cuts, by trying them all."""
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = int(places[j] - places[i])
            if n <= window and best[i] is not None:
                cost = best[i] + (0 if n in unpadded else window - n) + int(costs[j])
                best[j] = cost if best[j] is None else min(best[j], cost)
    return best[-1]


def test_cuts_equal_exhaustive_search():
    from feedprofile.llm.packing import best_cuts, candidates

    rng = np.random.default_rng(5)
    for _ in range(200):
        places = np.concatenate(([0], np.cumsum(rng.integers(1, 20, rng.integers(1, 40)))))
        costs = rng.integers(0, 12, len(places))
        cuts = best_cuts(places, costs, 32, (8, 16))
        edges = np.concatenate(([0], cuts))
        sizes = np.diff(edges)
        paid = sum(0 if n in (8, 16) else 32 - n for n in sizes.tolist()) + sum(int(costs[np.flatnonzero(places == c)[0]]) for c in cuts.tolist())
        assert cuts[-1] == places[-1] and sizes.max() <= 32 and paid == cheapest(places, costs, 32, (8, 16))
    places, costs = candidates(np.array([50, 400]), np.array([20, 150, 160]))
    assert {20, 50, 150, 160, 400} <= set(places.tolist()) and np.diff(places).max() <= 96 and costs[np.searchsorted(places, [20, 50, 160, 400])].tolist() == [4, 0, 4, 0]
    assert all(150 > p > 50 or 400 > p > 160 for p in places[1:][costs[1:] == 24].tolist())


def test_streams_go_on_over_batches(spark, monkeypatch):
    """However the rows are batched, a partition is one stream with one tail."""
    from feedprofile.llm import packing

    rnd = random.Random(8)
    docs = spark.createDataFrame([(k, words(rnd, 300)) for k in range(60)], DOCS).coalesce(1)
    monkeypatch.setattr(packing, "TOGETHER_BYTES", 3000)
    sizes = [r["n"] for r in pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(n < 900 and n not in (128, 256, 512) for n in sizes) <= 1 and len(sizes) > 20


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), (None, "x")], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["component_id"]) for r in near_texts(docs).collect()) == [("", None), ("a", "a"), ("b", "a")]
    assert {r["doc_id"] for r in pack(docs).collect()} == {"a", "b", None}
