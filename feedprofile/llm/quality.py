"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is encoded by its words and by the classes of its characters;
a hidden layer turns that into a representation, gated attention weighs the passages of a bag, and the weighted
representation gives the score. All weights are learned together from document labels alone: every step of the optimiser
adds up losses and gradients over the bags of a bounded sample of labelled documents, in one Spark job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from feedprofile.llm.bytestext import Slice, mix, slices, word_hashes, words
from feedprofile.llm.storage import mapped, materialize

PASSAGE = 64
#: Labelled documents that teach, about so many of each label (twice as many at most), and documents of a task.
SAMPLE, TOGETHER = 2000, 250
#: Buckets of character-class triples and of words, and widths of the hidden and the attention layer.
SHAPES, WORDS, HIDDEN, GATES = 256, 256, 16, 8
STATISTICS = 4
WIDTH = SHAPES + WORDS + STATISTICS
#: Optimiser steps at most, the least relative gain of a step, remembered steps, and weight decay.
STEPS, LEAST_GAIN, MEMORY, DECAY = 50, 1e-3, 10, 1e-4
#: A document is good from this score on.
GOOD = 0.7
#: Passages that are encoded at a time.
ENCODED = 2048

#: Classes of bytes: letters by case, digits, lead and other bytes of non-ASCII characters; any other byte is its own.
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = ord("a"), ord("A"), ord("0")
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 0x80, 0xC0


def encode(piece: Slice):
    """Passages of the texts of a slice as blocks ``(text of each passage, passages x WIDTH)``; each text has one at least."""
    found, (hashes, counts) = words(piece), word_hashes(piece)
    n = len(counts)
    passages = np.maximum(1, -(-counts // PASSAGE))
    first_word = np.cumsum(counts) - counts
    base = np.cumsum(passages) - passages
    owner = np.repeat(np.arange(n), passages)
    within = np.arange(len(owner)) - base[owner]
    from_word = np.minimum(first_word[owner] + within * PASSAGE, len(hashes))
    to_word = np.minimum(from_word + PASSAGE, first_word[owner] + counts[owner])
    # a passage ends where the next one's first word starts; a text's first takes what stands before its first word
    begin = np.where(within == 0, piece.offsets[:-1][owner], found.starts[np.minimum(from_word, max(len(hashes) - 1, 0))] if len(hashes) else 0)
    end = np.concatenate((begin[1:], piece.offsets[-1:])) if len(begin) else begin
    kinds = _CLASS[piece.data]
    for s in range(0, len(owner), ENCODED):
        t = min(s + ENCODED, len(owner))
        k = t - s
        x = np.zeros((k, WIDTH), np.float32)
        size = end[s:t] - begin[s:t]
        if (size > 2).any():
            c = kinds[begin[s] : end[t - 1]]
            at = np.repeat(np.arange(k), size)
            triple = ((c[:-2] * np.uint32(65536) + c[1:-1] * np.uint32(256) + c[2:]) * np.uint32(2654435761)) >> np.uint32(24)
            inner = at[:-2] == at[2:]
            seen = np.bincount(at[:-2][inner] * SHAPES + triple[inner], minlength=k * SHAPES).reshape(k, SHAPES)
            x[:, :SHAPES] = np.sqrt(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1))
        held = to_word[s:t] - from_word[s:t]
        if held.any():
            a, b = from_word[s], to_word[t - 1]
            h, at = hashes[a:b], np.repeat(np.arange(k), held)
            seen = np.bincount(at * WORDS + (h >> np.uint64(56)).astype(np.int64), minlength=k * WORDS).reshape(k, WORDS)
            some = np.maximum(held, 1)
            x[:, SHAPES : SHAPES + WORDS] = np.sqrt(seen / some[:, None])
            again = np.concatenate(([False], (h[1:] == h[:-1]) & (at[1:] == at[:-1])))
            x[:, -4] = np.bincount(at, weights=again, minlength=k) / some
            distinct = np.unique(mix(h ^ (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
            x[:, -3] = np.bincount(at[distinct], minlength=k) / some
            x[:, -2] = held / PASSAGE
            x[:, -1] = np.log1p(size) / 10
        yield owner[s:t], x


class Bags:
    """The model: its weights as one vector, scores of bags, and loss and gradient over labelled bags."""

    PARTS = (("w", (WIDTH, HIDDEN)), ("b", (HIDDEN,)), ("v", (HIDDEN, GATES)), ("c", (GATES,)), ("u", (HIDDEN, GATES)), ("d", (GATES,)), ("a", (GATES,)), ("o", (HIDDEN,)), ("e", (1,)))
    SIZE = sum(int(np.prod(shape)) for _, shape in PARTS)

    def __init__(self, theta: np.ndarray):
        at = 0
        for name, shape in self.PARTS:
            size = int(np.prod(shape))
            setattr(self, name, theta[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def start(seed: int = 41) -> np.ndarray:
        """Small random weights; biases are zero."""
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.normal(size=shape) / np.sqrt(1 if name == "w" else shape[0]) if len(shape) == 2 else rng.normal(size=shape) / np.sqrt(shape[0]) if name in "ao" else np.zeros(shape)).ravel() for name, shape in Bags.PARTS])

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Representations, both sides of the gate, and attention before its softmax."""
        h = np.tanh(x @ self.w + self.b)
        t, g = np.tanh(h @ self.v + self.c), 1 / (1 + np.exp(-(h @ self.u + self.d)))
        return h, t, g, (t * g) @ self.a

    @staticmethod
    def weights(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Softmax within each bag; ``starts`` and ``sizes`` give the bags' passages, one at least."""
        p = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        return p / np.repeat(np.add.reduceat(p, starts), sizes)

    def scores(self, h: np.ndarray, s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Score of each bag from its passages' representations and attention."""
        starts = np.cumsum(sizes) - sizes
        z = np.add.reduceat(h * self.weights(s, starts, sizes)[:, None], starts, axis=0)
        return 1 / (1 + np.exp(-(z @ self.o + self.e)))

    def gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted log loss over bags, and its gradient by all weights."""
        starts = np.cumsum(sizes) - sizes
        h, t, g, s = self.passages(x)
        p = self.weights(s, starts, sizes)
        z = np.add.reduceat(h * p[:, None], starts, axis=0)
        m = z @ self.o + self.e
        loss = float((weight * (np.logaddexp(0, m) - y * m)).sum())
        dm = weight * (1 / (1 + np.exp(-m)) - y)
        dz = np.repeat(dm[:, None] * self.o, sizes, axis=0)
        dp = (h * dz).sum(axis=1)
        ds = p * (dp - np.repeat(np.add.reduceat(p * dp, starts), sizes))
        dgate = ds[:, None] * self.a
        dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
        dh = (p[:, None] * dz + dt @ self.v.T + dg @ self.u.T) * (1 - h * h)
        parts = {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "c": dt.sum(axis=0), "u": h.T @ dg, "d": dg.sum(axis=0), "a": (t * g).T @ ds, "o": z.T @ dm, "e": dm.sum(keepdims=True)}
        return loss, np.concatenate([parts[name].ravel() for name, _ in self.PARTS])


def minimise(loss, theta: np.ndarray, steps: int = STEPS, least: float = LEAST_GAIN) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking; ``loss`` gives value and gradient."""
    value, slope = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = -slope, []
        for s, y in reversed(past):
            alphas.append((s @ d) / (s @ y))
            d = d - alphas[-1] * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(slope), 1.0))
        for (s, y), alpha in zip(past, reversed(alphas), strict=True):
            d = d + (alpha - (y @ d) / (s @ y)) * s
        down, rate = slope @ d, 1.0
        if down >= 0:
            break
        while True:
            new_value, new_slope = loss(theta + rate * d)
            if new_value <= value + 1e-4 * rate * down or rate < 1e-6:
                break
            rate /= 4
        if new_value > value:
            break
        step, change, gain = rate * d, new_slope - slope, value - new_value
        theta, value, slope = theta + step, new_value, new_slope
        if step @ change > 1e-12 * (change @ change):
            past = [*past, (step, change)][-MEMORY:]
        if gain < least * max(abs(value), 1e-3):
            break
    return theta


def _bagged(batches):
    for batch in batches:
        for piece in slices(batch.column("text")):
            n = len(piece.offsets) - 1
            rows: list[list[np.ndarray]] = [[] for _ in range(n)]
            for owner, x in encode(piece):
                cuts = np.flatnonzero(np.diff(owner)) + 1
                for part, k in zip(np.split(x, cuts), owner[np.concatenate(([0], cuts))], strict=True):
                    rows[k].append(part.astype(np.float16))
            yield pa.RecordBatch.from_pydict({
                "y": batch.column("y").slice(piece.first, n), "weight": batch.column("weight").slice(piece.first, n),
                "size": pa.array([sum(len(p) for p in r) for r in rows], pa.int32()), "x": pa.array([np.concatenate(r).tobytes() for r in rows], pa.binary()),
            })


def sampled(docs: DataFrame, labels: DataFrame, learn: Column, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts that teach, ``(text, y, weight)``, and the number of labelled documents by label.

    Ids that ``learn`` allows and whose label is 0 or 1 throughout are drawn by a hash of id and text, about ``sample``
    of each label; equal rows are one. ``weight`` makes up for the draw, so that labels weigh as they occur.
    """
    known = labels.select("doc_id", F.col("label").cast("int").alias("y")).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z"), F.count_if(F.col("y").isNull()).alias("none"))
    known = known.where("y = z AND none = 0 AND y IN (0, 1)").select("doc_id", "y")
    text = F.coalesce("text", F.lit(""))
    hashed = docs.where(learn).select("doc_id", text.alias("text"), F.xxhash64("doc_id", text, F.lit(13)).alias("h"))
    slim = materialize(hashed.select("doc_id", "h").join(known, "doc_id"))
    sizes = {r["y"]: r["n"] for r in slim.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(sample / max(sizes.get(1, 0), 1))).otherwise(F.lit(sample / max(sizes.get(0, 0), 1)))
    some = slim.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).distinct()
    few = some.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id"))).where(F.col("k") <= 2 * sample).drop("k")
    few = materialize(few)
    drawn = {r["y"]: r["n"] for r in few.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = max(sum(sizes.values()), 1)
    weigh = F.when(F.col("y") == 1, F.lit(sizes.get(1, 0) / max(drawn.get(1, 0), 1) / total)).otherwise(F.lit(sizes.get(0, 0) / max(drawn.get(0, 0), 1) / total))
    # at most twice the sample for each of the two labels, so that it can be broadcast and texts stay where they are
    texts = hashed.join(F.broadcast(few), ["doc_id", "h"]).groupBy("doc_id", "h", "y").agg(F.any_value("text").alias("text"))
    return texts.select("text", "y", weigh.alias("weight")), sizes


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, steps: int = STEPS) -> np.ndarray | float:
    """The model's weights, or the one score that all documents get where not both labels occur."""
    texts, sizes = sampled(docs, labels, learn, sample)
    if len(sizes) < 2:
        return (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    tasks = max(1, min(docs.sparkSession.sparkContext.defaultParallelism, 4 * sample // TOGETHER))
    bags = mapped(texts.repartition(tasks), _bagged, "y int, weight double, size int, x binary").persist(StorageLevel.MEMORY_AND_DISK)

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        def task(batches):
            model, total, slope = Bags(theta), 0.0, np.zeros(Bags.SIZE)
            for batch in batches:
                if batch.num_rows:
                    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
                    y, weight, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "weight", "size"))
                    value, g = model.gradient(x, size, y, weight)
                    total, slope = total + value, slope + g
            yield pa.RecordBatch.from_pydict({"loss": pa.array([total]), "slope": pa.array([slope.tobytes()], pa.binary())})

        parts = mapped(bags, task, "loss double, slope binary").collect()  # one row of each of a bounded number of tasks
        slope = sum((np.frombuffer(r["slope"]) for r in parts), DECAY * theta)
        return sum(r["loss"] for r in parts) + DECAY / 2 * float(theta @ theta), slope

    try:
        return minimise(loss, Bags.start(), steps)
    finally:
        bags.unpersist()


def _scored(theta: np.ndarray | float, keep: list[str]):
    def run(batches):
        model = None if isinstance(theta, float) else Bags(theta)
        for batch in batches:
            out = []
            for piece in slices(batch.column("text")):
                n = len(piece.offsets) - 1
                if model is None:
                    out.append(np.full(n, theta))
                    continue
                h, s, owners = [], [], []
                for owner, x in encode(piece):
                    a, _, _, b = model.passages(x)
                    h.append(a)
                    s.append(b)
                    owners.append(owner)
                out.append(model.scores(np.concatenate(h), np.concatenate(s), np.bincount(np.concatenate(owners), minlength=n)))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(score, pa.float64()), pa.array((score >= GOOD).astype(np.int32))], [*keep, "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, steps: int = STEPS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) plus ``score`` (0 to 1) and ``predicted`` (1 from GOOD on), from ``text`` alone.

    ``labels`` holds ``doc_id`` and one other column, the label (1 is good). Rows of ``docs`` that ``learn`` allows teach,
    where all labels of their id agree on 0 or 1; a null id has no label. Null and empty texts are bags of one empty
    passage, and are scored. Without both labels all documents get the smoothed share of label 1, 0.5 without any. Rows
    with repeated or null ids are scored like any other; columns named as the new ones are replaced; an empty table gives
    no rows.
    """
    docs = docs.drop("score", "predicted")
    label = next(c for c in labels.columns if c != "doc_id")
    theta = fit(docs, labels.select("doc_id", F.col(label).alias("label")), learn, sample, steps)
    keep = [c for c in docs.columns if keep is None or c in keep]
    schema = StructType([*docs.select(*keep).schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return mapped(docs.select(*{*keep, "text"}), _scored(theta, keep), schema)
