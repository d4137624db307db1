"""Language identification: first the family, then the language within it.

A text is the square roots of its byte-trigram shares, hashed to DIMENSIONS. Families are told apart, and within a
family its languages, by one-versus-one linear support vector machines whose votes and margins decide. The machines
are fitted on the driver on a bounded sample (about SAMPLE rows of each language, picked by a hash).
"""

from __future__ import annotations

import pickle
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from feedprofile.llm.bytestext import LOWER, Slice, slices
from feedprofile.llm.storage import mapped

DIMENSIONS = 4096
#: Rows of each language in the training sample, about.
SAMPLE = 800
UNKNOWN = "und"
# fixed values: language codes by family; any other code is a family of its own
FAMILIES = {
    "germanic": ("en", "de", "nl", "da", "sv", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def trigram_counts(piece: Slice) -> np.ndarray:
    """Hashed counts of byte trigrams, ``texts x DIMENSIONS``; A-Z count as a-z."""
    n = len(piece.offsets) - 1
    data = LOWER[piece.data].astype(np.uint32)
    if len(data) < 3:
        return np.zeros((n, DIMENSIONS), np.float32)
    code = (data[:-2] * np.uint32(65536) + data[1:-1] * np.uint32(256) + data[2:]) * np.uint32(2654435761)
    spot = (code >> np.uint32(20)).astype(np.int64)
    sizes = np.diff(piece.offsets)
    owner = np.repeat(np.arange(n), sizes)
    inner = owner[:-2] == owner[2:]
    return np.bincount(owner[:-2][inner] * DIMENSIONS + spot[inner], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32)


def features(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def has_letter(piece: Slice) -> np.ndarray:
    found = np.concatenate(([0], np.cumsum(_ASCII_LETTER[piece.data])))
    out = found[piece.offsets[1:]] > found[piece.offsets[:-1]]
    for k in np.flatnonzero(~out):
        text = piece.data[piece.offsets[k] : piece.offsets[k + 1]].tobytes().decode(errors="replace")
        out[k] = any(c.isalpha() for c in text)
    return out


#: Rows of the training sample that are dense at once.
BLOCK_ROWS = 256
Row = tuple[np.ndarray, np.ndarray]


def _blocks(rows: list[Row]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Rows in blocks: their number, and place and share's root of each trigram."""
    out = []
    for low in range(0, len(rows), BLOCK_ROWS):
        some = rows[low : low + BLOCK_ROWS]
        spots = [at.astype(np.uint32) + np.uint32(k * DIMENSIONS) for k, (at, _) in enumerate(some)]
        out.append((len(some), np.concatenate(spots), np.concatenate([np.sqrt(n / max(n.sum(), 1)) for _, n in some])))
    return out


def fit_svm(rows: list[Row], y: np.ndarray, decay: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient descent; y is -1 or 1, classes weigh the same.

    ``rows`` are places and counts of the trigrams that occur. One block at a time is dense, so that the driver's memory
    follows the sample's trigrams and not DIMENSIONS.
    """
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    blocks, dense = _blocks(rows), np.zeros((min(BLOCK_ROWS, len(rows)), DIMENSIONS), np.float32)
    w = np.zeros(DIMENSIONS + 1, np.float32)
    ahead, rate = w, 0.25  # rows have length sqrt(2) with the intercept's one, so the loss is 4-smooth
    for k in range(steps):
        slope, low = decay * ahead, 0
        for n, spots, values in blocks:
            dense.fill(0)
            dense.ravel()[spots] = values
            sign, x = y[low : low + n], dense[:n]
            pull = weight[low : low + n] * sign * np.maximum(0, 1 - sign * (x @ ahead[:-1] + ahead[-1]))
            slope[:-1] -= 2 * (pull @ x)
            slope[-1] -= 2 * pull.sum()
            low += n
        now = ahead - rate * slope
        ahead, w = now + k / (k + 3) * (now - w), now
    return w[:-1], float(w[-1])


class Identifier:
    """Fitted machines: one for each pair of families, and of languages within a family."""

    def __init__(self, rows: list[Row], languages: list[str]) -> None:
        known = sorted(set(languages))
        family = {code: _FAMILY_OF.get(code, code) for code in known}
        self.families = sorted(set(family.values()))
        self.members = {f: [c for c in known if family[c] == f] for f in self.families}
        self.pairs: list[tuple[str, str, str]] = [("", a, b) for a, b in combinations(self.families, 2)]
        for f in self.families:
            self.pairs += [(f, a, b) for a, b in combinations(self.members[f], 2)]
        tags, owners = np.array(languages), np.array([family[c] for c in languages])
        fitted = []
        for level, a, b in self.pairs:
            names = owners if level == "" else tags
            at = np.flatnonzero((names == a) | (names == b))
            fitted.append(fit_svm([rows[k] for k in at], np.where(names[at] == a, 1, -1).astype(np.float32)))
        self.weights = np.stack([w for w, _ in fitted], axis=1) if fitted else np.zeros((DIMENSIONS, 0), np.float32)
        self.bias = np.array([b for _, b in fitted], np.float32)

    def _level(self, level: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner by votes, then by margins; and the least sureness of its duels."""
        votes, sure = np.zeros((len(margins), len(names))), np.ones((len(margins), len(names)))
        for k, (group, a, b) in enumerate(self.pairs):
            if group == level and a in names:
                p = 1 / (1 + np.exp(-4 * np.clip(margins[:, k], -20, 20)))
                for name, q in ((a, p), (b, 1 - p)):
                    i = names.index(name)
                    votes[:, i] += (q > 0.5) + q / (10 * len(names))
                    sure[:, i] = np.minimum(sure[:, i], q)
        best = votes.argmax(axis=1)
        return best, sure[np.arange(len(best)), best]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.weights + self.bias
        family, sure = self._level("", self.families, margins)
        out, score = np.full(len(x), UNKNOWN, object), sure.copy()
        for k, f in enumerate(self.families):
            at = np.flatnonzero(family == k)
            best, inner = self._level(f, self.members[f], margins[at])
            out[at] = np.array(self.members[f], object)[best]
            score[at] = sure[at] * inner
        return out.tolist(), score


def _drawn(batches):
    for batch in batches:
        for piece in slices(batch.column("text"), most_texts=256):
            counts = trigram_counts(piece)
            n = len(counts)
            yield pa.RecordBatch.from_pydict({
                "lang": batch.column("lang").slice(piece.first, n),
                "at": pa.array([np.flatnonzero(r).astype("<u2").tobytes() for r in counts], pa.binary()),
                "n": pa.array([r[r > 0].astype("<f4").tobytes() for r in counts], pa.binary()),
            })


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Identifier | None:
    """Fit on rows of ``docs(doc_id, text, lang)`` that ``learn`` allows; None if none has text and language.

    Some ``sample`` rows of each language are drawn by a hash of id and text, and at most twice as many reach the driver;
    a language that the draw misses, because all its rows are alike, gives its first rows in the order of that hash.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 2)).select("lang", "text", F.xxhash64("doc_id", "text", F.lit(11)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for code, n in sizes.items():
        share = F.when(F.col("lang") == code, F.lit(sample / n)).otherwise(share)
    order = Window.partitionBy("lang").orderBy("h")

    def first(some: DataFrame, most: int) -> list:
        few = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
        return mapped(few.select("lang", "text"), _drawn, "lang string, at binary, n binary").collect()

    got = first(rows.where(F.pmod(F.col("h"), F.lit(1 << 30)) < share * (1 << 30)), 2 * sample)
    if missed := sorted(set(sizes) - {r["lang"] for r in got}):
        got += first(rows.where(F.col("lang").isin(missed)), sample)
    got.sort(key=lambda r: (r["lang"], r["at"], r["n"]))
    return Identifier([(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<f4")) for r in got], [r["lang"] for r in got])


def _named(model: bytes, keep: list[str]):
    def run(batches):
        identifier = pickle.loads(model)
        for batch in batches:
            tags, scores = [], []
            for piece in slices(batch.column("text"), most_texts=256):
                n = len(piece.offsets) - 1
                names, score = identifier.predict(features(trigram_counts(piece))) if identifier else ([UNKNOWN] * n, np.zeros(n))
                letters = has_letter(piece)
                tags += [t if ok else UNKNOWN for t, ok in zip(names, letters, strict=True)]
                scores.append(np.where(letters, score, 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.select(keep).columns, pa.array(tags, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, learn: Column, sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) plus ``lang_pred`` and ``score`` (0 to 1), learned from ``text`` and ``lang`` of rows that ``learn`` allows.

    Texts that are null, empty or without a letter are ``und`` with score 0, as all texts are if nothing can be learned.
    Predictions use the text alone. Rows with repeated or null ids are documents like any other; columns of ``docs`` named
    as the new ones are replaced; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    model = pickle.dumps(fit(docs, learn, sample))
    keep = [c for c in docs.columns if keep is None or c in keep]
    schema = StructType([*docs.select(*keep).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return mapped(docs.select(*{*keep, "text"}), _named(model, keep), schema)
