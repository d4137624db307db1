"""Language-model scores of texts: prediction by partial matching over bytes, beside a word-unigram base.

Contexts are the up to ORDER bytes before a byte, across blanks and lines, and the text's start. All contexts of all
training texts count. A byte's probability comes from the longest known context; where that has not seen it, the model
escapes to the next shorter one, with the escape estimate "half of the distinct symbols over the total", and symbols of
the longer contexts are excluded from the shorter ones. After training this is a fixed probability of each gram, a
context and its byte.

A task counts the grams of its texts and hands them on as sorted runs, one for each bucket of gram hashes; buckets merge
the runs. What is then left, the distinct grams, is dealt by the last NEAR bytes of context, because grams that share
them hold all that the longer contexts of each other need; only contexts of up to DENSE bytes, 65,793 at most, go to
every worker. The HOT_GRAMS most frequent probabilities are broadcast; rarer grams of a text are joined by shuffle.

Word counts cover all training words. The HOT most frequent are broadcast (a bounded table); the counts of rarer words
are joined by shuffle.
"""

from __future__ import annotations

from copy import copy
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedprofile.llm.bytestext import Slice, mix, prefix_hashes, range_hashes, slices, total_by, word_hashes
from feedprofile.llm.storage import mapped, materialize, release

#: Longest context; the longest of those that have a whole row of 256 numbers; the bytes by which grams are dealt.
ORDER, DENSE, NEAR = 6, 2, 3
#: Frequent words that are broadcast, and frequent grams, some 16 and 32 MB.
HOT, HOT_GRAMS = 1 << 20, 1 << 21
#: A bucket of grams stands for about so many bytes of text.
BUCKET_BYTES = 4 << 20
#: About so many bytes of text are counted at once, and sorted at once.
TOGETHER_BYTES, SORTED_BYTES = 32 << 20, 2 << 20
#: About so many bytes of text are scored at once, and texts at most, whose number has the 8 bits that a gram leaves.
SCORED_BYTES, SCORED_TEXTS = 1 << 20, 1 << 8
WORDS, SHORT, TEXTS, BYTES = 0, 1, 2, 3
MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
#: Marks grams of texts that are not learned from while they are counted.
_OTHER, _GRAM = np.uint64(1 << 56), np.uint64((1 << 56) - 1)


class Units(NamedTuple):
    """Distinct texts of a slice, each with a zero byte for its end: their bytes joined, their ends there, their hashes; the unit of each text."""

    data: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    which: np.ndarray


def units(piece: Slice) -> Units:
    """Distinct texts of a slice."""
    which, hashes = pd.factorize(range_hashes(prefix_hashes(piece.data), piece.offsets[:-1], piece.offsets[1:]))
    first = np.zeros(len(hashes), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    sizes = np.diff(piece.offsets)[first]
    ends = np.cumsum(sizes + 1)
    data = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for at, to, size in zip(piece.offsets[first].tolist(), ends.tolist(), sizes.tolist(), strict=True):
        data[to - 1 - size : to - 1] = piece.data[at : at + size]
    return Units(data, ends, hashes, which)


def grams(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte its context of ORDER bytes within the text, zeros before the text's start, and the byte: 56 bits."""
    padded = np.concatenate((np.zeros(7, np.uint8), data))
    out = np.ndarray(len(data), ">u8", padded, strides=(1,)).astype(np.uint64)  # each byte and the seven before it
    out &= np.uint64((1 << 8 * (ORDER + 1)) - 1)
    starts = np.concatenate(([0], ends[:-1]))
    for k in range(ORDER):
        at = starts[starts + k < ends] + k
        out[at] &= np.uint64((1 << 8 * (k + 1)) - 1)
    return out


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, weights.dtype)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _merged(held: tuple[np.ndarray, np.ndarray], fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of distinct keys, ascending, with those of further keys added; the counts held are given up."""
    keys, n = _distinct(np.concatenate(fresh))
    fresh.clear()
    known, counts = held
    if not len(known):
        return keys, n
    at = np.searchsorted(known, keys)
    old = known[np.minimum(at, len(known) - 1)] == keys
    counts[at[old]] += n[old]
    new = ~old
    return np.insert(known, at[new], keys[new]), np.insert(counts, at[new], n[new])


def _ended(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a slice, each with a zero byte for its end, and where the ends are."""
    n = len(piece.offsets) - 1
    data, ends = np.zeros(len(piece.data) + n, np.uint8), piece.offsets[1:] + np.arange(1, n + 1)
    inside = np.ones(len(data), bool)
    inside[ends - 1] = False
    data[inside] = piece.data
    return data, ends


def _counted(batches):
    """Counts ``c`` in texts to learn from: of words, of grams of DENSE context bytes, of texts and of bytes."""
    held = {kind: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for kind in (WORDS, SHORT)}
    words: list[np.ndarray] = []
    short = np.zeros(1 << 8 * (DENSE + 1), np.int32)
    texts = size = new = 0

    def rows(kind, keys, c):
        for at in range(0, len(keys), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(keys[part]), kind, np.int32)), "key": pa.array(keys[part].view(np.int64)), "c": pa.array(c[part].astype(np.int64))})

    for batch in batches:
        for piece in slices(batch.column("text")):
            data, ends = _ended(piece)
            words.append(word_hashes(piece)[0])
            codes, c = np.unique((grams(data, ends) & np.uint64(len(short) - 1)).astype(np.uint32), return_counts=True)
            short[codes] += c.astype(np.int32)
            texts, size, new = texts + len(ends), size + len(data), new + len(words[-1])
            if new >= SORTED_BYTES // 8:
                held[WORDS], new = _merged(held[WORDS], words), 0
            if len(held[WORDS][0]) >= TOGETHER_BYTES // 16:
                yield from rows(WORDS, *held[WORDS])
                held[WORDS] = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield from rows(WORDS, *(_merged(held[WORDS], words) if words else held[WORDS]))
    seen = np.flatnonzero(short)
    yield from rows(SHORT, seen.astype(np.uint64), short[seen])
    yield from rows(TEXTS, np.zeros(1, np.uint64), np.array([texts]))
    yield from rows(BYTES, np.zeros(1, np.uint64), np.array([size]))


def _run(keys: np.ndarray, c: np.ndarray) -> bytes:
    """Sorted grams and their counts as byte planes, which compress well; counts have as many bytes as the largest needs, as the first byte tells."""
    wide = max(1, (int(c.max()).bit_length() + 7) // 8)
    planes = keys.view(np.uint8).reshape(-1, 8)[:, :7], c.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :wide]
    return bytes([wide]) + b"".join(p.T.tobytes() for p in planes)


def _read(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(7 + raw[0], -1)
    keys, c = np.zeros((planes.shape[1], 8), np.uint8), np.zeros((planes.shape[1], 8), np.uint8)
    keys[:, :7], c[:, : raw[0]] = planes[:7].T, planes[7:].T
    return keys.view(np.uint64).ravel(), c.view(np.int64).ravel()


def _runs(keys: np.ndarray, c: np.ndarray, bucket: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Ascending grams and counts as one run for each bucket that has some."""
    if not len(keys):
        return [], []
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")  # 16 bits sort by digits
    keys, c, bucket = keys[order], c[order], bucket[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.append(first[1:], len(keys))
    return bucket[first].tolist(), [_run(keys[a:b], c[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]


def _tallied(buckets: int):
    """Runs ``(bucket, run)`` of all grams, counted in texts to learn from (0 for grams of other texts only)."""
    def run(batches):
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, fresh, size, new = none, [], 0, 0

        def flush():
            keys, n = _merged(held, fresh) if fresh else held
            distinct, c = _summed(keys & _GRAM, np.where(keys < _OTHER, n, 0))
            names, blobs = _runs(distinct, c, (mix(distinct) % np.uint64(buckets)).astype(np.int32))
            for at in range(0, len(names), 256):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(names[at : at + 256], pa.int32()), "run": pa.array(blobs[at : at + 256], pa.binary())})

        for batch in batches:
            learn = batch.column("_learn")
            for other, part in ((False, batch.filter(learn)), (True, batch.filter(pc.invert(learn)))):
                for piece in slices(part.column("text")):
                    keys = grams(*_ended(piece))
                    fresh.append(keys | _OTHER if other else keys)
                    new, size = new + len(keys), size + len(keys)
                    if new >= SORTED_BYTES:
                        held, new = _merged(held, fresh), 0
                    if size >= TOGETHER_BYTES:
                        yield from flush()
                        held, size, new = none, 0, 0
                        fresh.clear()
        yield from flush()

    return run


def _gathered(runs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    got = [_read(r) for r in runs]
    return _summed(*(np.concatenate(x) for x in zip(*got, strict=True)))


def _dealt(buckets: int):
    """Merges the runs of a bucket and deals its grams by their last NEAR context bytes."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, c = _gathered(rows["run"])
        near = (keys >> np.uint64(8)) & np.uint64((1 << 8 * NEAR) - 1)
        names, blobs = _runs(keys, c, (mix(near) % np.uint64(buckets)).astype(np.int32))
        release()
        return pd.DataFrame({"bucket": np.array(names, np.int32), "run": blobs})

    return run


class ByteModel:
    """Fixed distributions of the trie's contexts, as log10.

    Contexts of up to DENSE bytes have whole rows. Longer ones have the symbols that they have seen, and a factor by
    which the next shorter context's probability of any other symbol is scaled; it makes all probabilities add to one.
    """

    def __init__(self, short: tuple[np.ndarray, np.ndarray], long: tuple[np.ndarray, np.ndarray]) -> None:
        self._dense(*_summed(short[0] & np.uint64((1 << 8 * (DENSE + 1)) - 1), short[1]))
        self._learn(long)

    def with_longer(self, long: tuple[np.ndarray, np.ndarray]) -> ByteModel:
        """This model with the contexts of other grams in place of its own longer ones."""
        out = copy(self)
        out._learn(long)
        return out

    def _learn(self, long: tuple[np.ndarray, np.ndarray]) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(DENSE + 1, ORDER + 1):
            keys, counts = _summed(long[0] & np.uint64((1 << 8 * (k + 1)) - 1), long[1].astype(np.float64))
            below = self.log_probabilities(keys)
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            if not len(keys):
                self.levels.append((keys, counts, contexts, counts))
                continue
            distinct = np.diff(np.append(first, len(keys)))
            total = np.add.reduceat(counts, first)
            unseen = np.maximum(1 - np.add.reduceat(10.0**below, first), 1e-9)
            own = np.log10((counts - 0.5) / np.repeat(total, distinct))
            self.levels.append((keys, own, contexts, np.log10(distinct / (2 * total) / unseen)))

    def _dense(self, keys: np.ndarray, counts: np.ndarray) -> None:
        byte, context, counts = (keys & np.uint64(255)).astype(np.int64), (keys >> np.uint64(8)).astype(np.int64), counts.astype(np.float64)
        tables = [self._table(byte, counts, context & ((1 << 8 * k) - 1)) for k in range(DENSE + 1)]
        rows = []
        for k, (codes, own) in enumerate(tables):
            shorter = [(tables[j][1], np.searchsorted(tables[j][0], codes & ((1 << 8 * j) - 1))) for j in range(k - 1, -1, -1)]
            rows.append(self._mixed(own, shorter))
        self.codes, self.rows = [t[0] for t in tables], np.concatenate(rows)

    @staticmethod
    def _table(byte: np.ndarray, counts: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.unique(context) if len(context) else np.zeros(1, np.int64)
        spot = np.searchsorted(codes, context) * 256 + byte
        return codes, np.bincount(spot, counts, len(codes) * 256).reshape(-1, 256).astype(np.float32)

    @staticmethod
    def _mixed(own: np.ndarray, shorter: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Rows of log10 probabilities: escapes from the context's own counts through those of its suffixes."""
        out = np.empty(own.shape, np.float32)
        for at in range(0, len(own), 4096):
            part = slice(at, at + 4096)
            p = np.zeros((len(own[part]), 256))
            open_, mass = np.ones(p.shape, bool), np.ones((len(p), 1))
            for counts in [own[part], *(t[spots[part]] for t, spots in shorter)]:
                seen = counts * open_
                total, distinct = seen.sum(axis=1, keepdims=True, dtype=np.float64), (seen > 0).sum(axis=1, keepdims=True)
                below = np.maximum(total, 1)
                p += mass * np.maximum(seen - 0.5, 0) / below
                mass = np.where(total > 0, mass * distinct / (2 * below), mass)
                open_ &= seen == 0
            left = open_.sum(axis=1, keepdims=True)
            p += np.where(left > 0, mass / np.maximum(left, 1), 0) * open_
            out[part] = np.log10(p / p.sum(axis=1, keepdims=True))
        return out

    def _row(self, context: np.ndarray) -> np.ndarray:
        """Row of the longest known suffix of each context."""
        out, start = np.zeros(len(context), np.int64), 0
        for k, codes in enumerate(self.codes):
            short = context & ((1 << 8 * k) - 1)
            at = np.minimum(np.searchsorted(codes, short), len(codes) - 1)
            out = np.where(codes[at] == short, start + at, out)
            start += len(codes)
        return out

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """log10 probabilities of the last bytes of ``grams``, by the levels made so far."""
        context = (keys >> np.uint64(8)).astype(np.int64) & ((1 << 8 * DENSE) - 1)
        out = self.rows[self._row(context), (keys & np.uint64(255)).astype(np.int64)].astype(np.float64)
        for k, (known, own, contexts, factors) in enumerate(self.levels, DENSE + 1):
            if not len(known):
                continue
            gram = keys & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            ctx = np.minimum(np.searchsorted(contexts, gram >> np.uint64(8)), len(contexts) - 1)
            escaped = out + np.where(contexts[ctx] == gram >> np.uint64(8), factors[ctx], 0.0)
            out = np.where(known[at] == gram, own[at], escaped)
        return out


def _looked_up(hot: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is a frequent one, and its value (0 where it is not)."""
    frequent, values = hot
    if not len(frequent):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
    hit = frequent[at] == keys
    return hit, np.where(hit, values[at], 0.0)


def _text_scores(hot: tuple[np.ndarray, np.ndarray], piece: Slice) -> tuple[np.ndarray, pa.ListArray]:
    """Sums of the frequent grams' log10 probabilities by text, and the other grams of each text, of SCORED_TEXTS texts at most.

    Grams are sorted with the numbers of their texts behind them, and looked up once and in ascending order: in the
    order of a text each lookup would read the frequent grams at some twenty far places.
    """
    found = units(piece)
    n, sizes = len(found.ends), np.diff(found.ends, prepend=0)
    placed = grams(found.data, found.ends)
    placed <<= np.uint64(8)
    placed |= np.repeat(np.arange(n, dtype=np.uint64), sizes)
    placed.sort()
    keys, text = placed >> np.uint64(8), placed.astype(np.uint8)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    hit, value = _looked_up(hot, keys[first])
    times = np.diff(np.append(first, len(keys)))
    sums = np.bincount(text, np.repeat(value, times), n)
    rare = np.flatnonzero(np.repeat(~hit, times))
    rare = rare[np.argsort(text[rare], kind="stable")]
    ends = np.concatenate(([0], np.cumsum(np.bincount(text[rare], minlength=n))))
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys[rare].view(np.int64)))
    return sums[found.which], lists.take(pa.array(found.which))


def _valued(dense):
    """Log10 probabilities of a bucket's grams, which are all grams with some last NEAR context bytes."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, c = _gathered(rows["run"])
        seen = np.flatnonzero(c > 0)
        values = dense.value.with_longer((keys[seen], c[seen])).log_probabilities(keys)
        release()
        return pd.DataFrame({"key": keys.view(np.int64), "c": c, "p": values})

    return run


def _scored(hot_grams, hot, keep: list[str]):
    def run(batches):
        made = TaskContext.get().partitionId() << 36
        for batch in batches:
            for piece in slices(batch.column("text"), SCORED_BYTES, SCORED_TEXTS):
                n = len(piece.offsets) - 1
                sums, grams_left = _text_scores(hot_grams.value, piece)
                words, counts = word_hashes(piece)
                which, distinct = pd.factorize(words)
                hit, value = _looked_up(hot.value, distinct)
                known = hit[which]
                n_known = total_by(known, counts).astype(np.int64)
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts - n_known))).astype(np.int32)), pa.array(words[~known].view(np.int64)))
                yield pa.RecordBatch.from_pydict({
                    **{c: batch.column(c).slice(piece.first, n) for c in keep},
                    "_row": pa.array(made + np.arange(n)), "_words": pa.array(counts.astype(np.int64)), "_known": pa.array(n_known),
                    "_logs": pa.array(total_by(value[which], counts)), "_rare": rare, "_sum": pa.array(sums), "_grams": grams_left,
                })
                made += n

    return run


def _least(rows: DataFrame, count: str, most: int) -> int:
    """A count from which on there are at most ``most`` rows, from how many rows have each count.

    Counts above 4,095 are told apart by their first 12 binary digits, so that the driver gets some 110,000 numbers at
    most; rows of a class that would exceed the bound are all below.
    """
    width = F.expr(f"shiftleft(1L, greatest(length(bin({count})) - 12, 0))")
    steps = rows.groupBy((F.col(count) - F.col(count) % width).alias("c")).count().orderBy(F.desc("c")).collect()
    least, so_far = 2**63 - 1, 0
    for step in steps:
        if so_far + step["count"] > most:
            break
        least, so_far = step["c"], so_far + step["count"]
    return least


def _frequent(rows: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and values of a bounded number of rows."""
    got = rows.select(key, value).toArrow()
    keys, values = got[key].to_numpy().view(np.uint64), got[value].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def gram_values(marked: DataFrame, short: tuple[np.ndarray, np.ndarray], size: int) -> DataFrame:
    """Log10 probabilities ``(key, c, p)`` of all grams of ``marked(text, _learn)``, some ``size`` bytes, with their counts."""
    buckets = 1 + size // BUCKET_BYTES
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    dense = marked.sparkSession.sparkContext.broadcast(ByteModel(short, none))
    runs = mapped(marked, _tallied(buckets), "bucket int, run binary")
    runs = runs.groupBy("bucket").applyInPandas(_dealt(buckets), "bucket int, run binary")
    return materialize(runs.groupBy("bucket").applyInPandas(_valued(dense), "key long, c long, p double"))


def score_texts(docs: DataFrame, learn: Column, keep: list[str]) -> DataFrame:
    """Scores of all texts, learned from the rows that ``learn`` allows: columns ``keep`` plus ``n_tokens, n_known,
    train_tokens, base_score, score``.

    A text's tokens are its words, A-Z lower-cased, and one end. ``base_score`` adds log10((c + 0.5) / (N + 0.5 (V + 1)))
    over them; ``score`` is the byte model's log10 probability of the text as it stands and its end. A null text is
    empty, that is one end. Repeated rows count and are scored each. Without training rows every token is unknown and
    bytes are equally likely. Columns in ``keep`` that are named as the new ones are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = {c: f"_keep{k}" for k, c in enumerate(keep) if c not in MADE}
    marked = docs.select("text", F.coalesce(learn, F.lit(False)).alias("_learn"))
    counted = mapped(marked.where("_learn").select("text"), _counted, "kind int, key long, c long")
    counted = materialize(counted.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("c").alias("c")))
    sums = {r["kind"]: r["c"] for r in counted.where(F.col("kind").isin(TEXTS, BYTES)).groupBy("kind").agg(F.sum("c").alias("c")).collect()}
    texts = sums.get(TEXTS, 0)
    words = counted.where(F.col("kind") == WORDS).select(F.col("key").alias("h"), "c")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + texts, distinct + (texts > 0)
    least = _least(words, "c", HOT)
    hashes, c = _frequent(words.where(F.col("c") >= least), "h", "c")
    hot = spark.sparkContext.broadcast((hashes, np.log10(c + 0.5)))
    values = gram_values(marked, _frequent(counted.where(F.col("kind") == SHORT), "key", "c"), sums.get(BYTES, 0))
    least_gram = _least(values, "c", HOT_GRAMS)
    hot_grams = spark.sparkContext.broadcast(_frequent(values.where(F.col("c") >= least_gram), "key", "p"))
    kinds = dict(docs.dtypes)
    schema = "".join(f"{k} {kinds[c]}, " for c, k in own.items()) + "_row long, _words long, _known long, _logs double, _rare array<long>, _sum double, _grams array<long>"
    drawn = materialize(mapped(docs.select("text", *[F.col(c).alias(k) for c, k in own.items()]), _scored(hot_grams, hot, list(own.values())), schema))
    rare = drawn.select("_row", F.explode("_rare").alias("h")).groupBy("_row", "h").agg(F.count("*").alias("m"))
    cold = words.where(F.col("c") < least)
    found = rare.join(cold, "h").groupBy("_row").agg(F.sum("m").alias("_n"), F.sum(F.col("m") * F.log10(F.col("c") + 0.5)).alias("_l"))
    left = drawn.select("_row", F.explode("_grams").alias("key")).join(values.where(F.col("c") < least_gram), "key")
    left = left.groupBy("_row").agg(F.sum("p").alias("_p"))
    none = F.lit(0)
    end = float(np.log10(texts + 0.5))
    below = float(np.log10(total + 0.5 * (distinct + 1)))
    n = F.col("_words") + 1
    seen = F.col("_known") + F.coalesce("_n", none)
    base = F.col("_logs") + F.coalesce("_l", F.lit(0.0)) + (F.col("_words") - seen) * float(np.log10(0.5)) + end - n * below
    return drawn.join(found, "_row", "left").join(left, "_row", "left").select(
        *[F.col(k).alias(c) for c, k in own.items()], n.cast("long").alias("n_tokens"), (seen + (1 if texts else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("_sum") + F.coalesce("_p", F.lit(0.0))).alias("score"),
    )
