"""Near-duplicate texts by SetSketch registers, banding, a likelihood test and exact verification.

A sketch holds, per register, the exponent of the least of exponentially spaced random points that the shingles of
a text throw into it (SetSketch with truncation: a shingle stops throwing once its next point exceeds all minima).
Sketches merge by maximum; two sets agree on a register about as often as their Jaccard similarity says.

Texts with equal shingle sets are one class. Classes that agree on all registers of a band meet in that band's
bucket. Instead of all pairs of a bucket, each member meets the bucket's hub, its least class: the pair is tried by
the likelihood of its joint register counts, and, if the threshold is not far out of reach, on its whole shingle sets.
Where buckets then still hold several components, their classes form families; members outside a family's largest
component are compared with all of the family, in square blocks of bounded size that leave one row per member.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedprofile.llm.bytestext import Slice, distinct_sorted, mix, slices, word_hashes
from feedprofile.llm.components import connected_components
from feedprofile.llm.storage import mapped, materialize

#: Registers of a band and bands; a pair at 0.8 misses all bands with probability 0.59 ** 32 = 5e-8.
BAND_ROWS, BANDS = 4, 32
REGISTERS = BAND_ROWS * BANDS
#: Points drawn at once, which bounds memory.
DRAWN = 1 << 19
#: Base of the exponents and their offset, so that they are positive and fit 16 bits.
BASE, OFFSET = 1.005, 600
#: Pairs whose likelihood at the threshold is less than exp(-SURE) of their best are not verified.
SURE = 20.0
#: A hub with more partners than this is verified in several parts.
PART_PAIRS = 256
#: Ids are broadcast up to this number (some 20 MB), and joined by shuffle beyond it.
BROADCAST_IDS = 1_000_000
#: Members of a family in a block, and families verified together, by members.
BLOCK_ROWS, ROWS_TOGETHER, COLUMNS = 512, 2000, 8192

_GOLD = 0x9E3779B97F4A7C15


def shingles(piece: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of a slice's texts, and their number by text; a shorter text is one shingle."""
    hashes, counts = word_hashes(piece)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    length = np.repeat(np.minimum(counts, size), n)
    out = length.astype(np.uint64)
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    for k in range(size):
        word = padded[at + k]
        if (counts < size).any():
            word = np.where(length > k, word, np.uint64(0))
        out = (out + word) * np.uint64((_GOLD * (2 * k + 3)) & (2**64 - 1) | 1)
        out ^= out >> np.uint64(29)
    return mix(out), n


def sketch(elements: np.ndarray, counts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SetSketch registers, ``sets x registers``; an empty set has only zeros."""
    sets = len(counts)
    least = np.full(sets * registers, np.inf)
    owner = np.repeat(np.arange(sets), counts)
    alive, time = np.arange(len(elements)), np.zeros(len(elements))
    thrown, step = 0, 1
    while len(alive):
        step = max(1, min(step, DRAWN // len(alive)))
        ks = np.arange(thrown + 1, thrown + step + 1, dtype=np.uint64) * np.uint64(_GOLD)
        x = mix(elements[alive][:, None] + ks[None, :])
        gaps = -np.log((x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / registers
        times = time[alive][:, None] + np.cumsum(gaps, axis=1)
        spots = owner[alive][:, None] * registers + (mix(x + np.uint64(1)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(least, spots.ravel(), times.ravel())
        time[alive] = times[:, -1]
        most = least.reshape(sets, registers).max(axis=1)
        alive = alive[time[alive] < most[owner[alive]]]
        thrown += step
        step = min(2 * step, 256) if thrown >= 2 * step else step
    with np.errstate(divide="ignore"):
        exponent = np.floor(1 - np.log(least) / np.log(BASE)) + OFFSET
    return np.where(np.isfinite(least), np.clip(exponent, 1, 65535), 0).astype(np.uint16).reshape(sets, registers)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    rows = sketches.reshape(len(sketches), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
    for k in range(BAND_ROWS):
        key = mix(key * np.uint64(_GOLD) + rows[:, :, k])
    return key.view(np.int64)


def _distinct(piece: Slice, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    every, counts = shingles(piece, size)
    ends = np.cumsum(counts)
    sets = [distinct_sorted(every[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
    return sets, np.array([len(s) for s in sets], np.int64)


def _prints(elements: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit fingerprints of each set."""
    ends, out = np.cumsum(sizes), []
    for salt in (1, 2):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(elements + np.uint64(salt * _GOLD & (2**64 - 1))), dtype=np.uint64)))
        out.append(mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
    return out


def _sketched(size: int):
    def run(batches):
        for batch in batches:
            for piece in slices(batch.column("text")):
                sets, sizes = _distinct(piece, size)
                distinct = np.concatenate(sets)
                prints = _prints(distinct, sizes)
                drawn = sketch(distinct, sizes)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(piece.first, len(sizes)), "text_hash": batch.column("text_hash").slice(piece.first, len(sizes)),
                    "n_shingles": pa.array(sizes), "f1": pa.array(prints[0]), "f2": pa.array(prints[1]),
                    "sketch": pa.array([r.tobytes() for r in drawn], pa.binary()),
                })

    return run


def _banded(batches):
    for batch in batches:
        if not len(batch):
            continue
        rows = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(len(batch), REGISTERS)
        keys = band_keys(rows)
        yield pa.RecordBatch.from_pydict({
            "id": pa.array(np.repeat(batch.column("id").to_numpy(), BANDS)), "band": pa.array(keys.ravel()),
        })


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the threshold is within reach for sketch pairs of sets with known sizes.

    Registers are equal, greater or less with probabilities J, u - v J and v - u J, where u and v are the sizes' shares;
    the log likelihood of the three counts at the threshold is set against its maximum over J.
    """
    equal, more = (a == b).sum(axis=1), (a > b).sum(axis=1)
    less = a.shape[1] - equal - more
    u = na / (na + nb)
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def log_likelihood(j):
        tiny = 1e-9
        return equal * np.log(np.maximum(j, tiny)) + more * np.log(np.maximum(u - v * j, tiny)) + less * np.log(np.maximum(v - u * j, tiny))

    grid = np.stack([log_likelihood(top * g) for g in np.linspace(0.02, 1.0, 50)])
    best = top * np.linspace(0.02, 1.0, 50)[grid.argmax(axis=0)]
    reach = log_likelihood(np.minimum(threshold, top))
    return (best >= threshold) | (grid.max(axis=0) - reach < SURE)


def _tried(threshold: float):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), REGISTERS) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
            sized = 100 * np.minimum(na, nb) >= 100 * threshold * np.maximum(na, nb) - 1e-6
            keep = sized & likely(a, b, na, nb, threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for piece in slices(batch.column("text")):
                sets, sizes = _distinct(piece, size)
                prints = _prints(np.concatenate(sets), sizes)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").slice(piece.first, len(sizes)), "f1": pa.array(prints[0]), "f2": pa.array(prints[1]),
                    "s": pa.array([x.tobytes() for x in sets], pa.binary()),
                })

    return run


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            keep, last, held = [], None, None
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                raw = x.as_buffer()
                if last is None or raw != last:
                    last, held = raw, np.frombuffer(raw, np.uint64)
                other = np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(held) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = [np.concatenate(x) for x in (left, right)]
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    shared = np.intersect1d(flat[0], flat[1])
    spots = []
    for values, rows in zip(flat, owner, strict=True):
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        hit = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        spots.append((at[hit][order], rows[hit][order]))
    for low in range(0, len(shared), COLUMNS):
        sides = []
        for (at, rows), n in zip(spots, (len(left), len(right)), strict=True):
            a, b = np.searchsorted(at, (low, low + COLUMNS))
            side = np.zeros((n, min(COLUMNS, len(shared) - low)), np.float32)
            side[rows[a:b], at[a:b] - low] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _family_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between components within the blocks of some families: each linked class, and the least class of its part."""
    ids, owners = rows["id"].to_numpy(), rows["c"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in rows["s"]]
    sizes = np.array([len(x) for x in sets])
    parts, low, linked = rows["part"].to_numpy(), ids.copy(), np.zeros(len(rows), bool)
    for (_, lo, hi), at in rows.groupby(["family", "lo", "hi"], sort=False).indices.items():
        left, right = at[parts[at] == lo], at[parts[at] == hi]
        if not len(left) or not len(right):
            continue
        common = _common([sets[k] for k in left], [sets[k] for k in right])
        union = sizes[left][:, None] + sizes[right][None, :] - common
        i, j = np.nonzero((100 * common >= percent * union) & (owners[left][:, None] != owners[right][None, :]))
        a, b = left[i], right[j]
        linked[a] = linked[b] = True
        while len(a):
            least = np.minimum(low[a], low[b])
            if (least == low[a]).all() and (least == low[b]).all():
                break
            np.minimum.at(low, a, least)
            np.minimum.at(low, b, least)
    return pd.DataFrame({"u": ids[linked], "v": low[linked]})


class _Corpus:
    """Classes of a corpus: ``(id, doc, f1, f2, n, sketch)``, with the text of each class's least document at hand."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, threshold_percent: int) -> None:
        self.docs, self.classes, self.size, self.percent = docs, classes, size, threshold_percent
        self.kind = dict(docs.dtypes)["doc_id"]

    def sets(self, needed: DataFrame) -> DataFrame:
        """Whole shingle sets ``(id, s)`` of the classes in ``needed(id)``."""
        needed = materialize(needed.select("id").distinct())
        # two classes may have the same least document, where a doc_id is repeated
        which = materialize(self.classes.select("id", "doc", "f1", "f2").join(needed, "id"))
        wanted = which.select("doc").distinct()
        if needed.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        texts = self.docs.select(F.col("doc_id").alias("doc"), "text").join(wanted, "doc").select(F.col("doc").alias("id"), "text")
        found = mapped(texts, _sets(self.size), f"id {self.kind}, f1 long, f2 long, s binary").withColumnRenamed("id", "doc")
        return found.join(which, ["doc", "f1", "f2"]).dropDuplicates(["id"]).select("id", "s")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` of classes that reach the threshold on their whole sets."""
        one = self.classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        two = self.classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        tried = materialize(mapped(pairs.join(two, "b").join(one, "a"), _tried(self.percent / 100), "a long, b long"))
        sets = materialize(self.sets(tried.select(F.col("a").alias("id")).unionByName(tried.select(F.col("b").alias("id")))))
        # a hub with many partners is dealt out in parts
        parts = tried.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PART_PAIRS)).cast("int").alias("parts"))
        dealt = tried.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        left = parts.join(sets, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("s").alias("sa"))
        right = dealt.join(sets, F.col("b") == F.col("id")).select("a", "b", "part", F.col("s").alias("sb"))
        both = left.join(right, ["a", "part"]).select("a", "b", "sa", "sb")
        return materialize(mapped(both, _verified(self.percent), "a long, b long"))


def _between(held: DataFrame, corpus: _Corpus) -> DataFrame:
    """Links ``(u, v)`` between components of one family, from ``held(band, hub, id, c)``."""
    families = connected_components(held.select(F.col("id").alias("u"), F.col("hub").alias("v"))).withColumnRenamed("component", "family")
    members = materialize(held.select("id", "c").distinct().join(families, F.col("id") == F.col("node")).drop("node"))
    sizes = members.groupBy("family", "c").agg(F.count("*").alias("m"))
    main = sizes.groupBy("family").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("all"))
    main = materialize(main.where(F.col("all") > F.col("most")))
    if main.count() <= BROADCAST_IDS:
        main = F.broadcast(main)
    # parts from 0 are members outside the largest component, parts below 0 those inside
    blocks = lambda n: F.ceil(n / F.lit(BLOCK_ROWS)).cast("int")
    placed = (
        members.join(main, "family")
        .withColumn("outer", blocks(F.col("all") - F.col("most"))).withColumn("inner", blocks(F.col("most")))
        .withColumn("part", F.when(F.col("c") == F.col("main"), -1 - F.pmod(F.xxhash64("id"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("id"), F.col("outer"))).cast("int"))
    )
    others = F.when(F.col("part") < 0, F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(-F.col("inner"), F.col("outer") - 1))
    placed = placed.withColumn("other", F.explode(others)).withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    groups = max(1, members.count() // ROWS_TOGETHER)
    home = F.when(F.col("all") <= BLOCK_ROWS, F.pmod(F.xxhash64("family"), F.lit(groups))).otherwise(F.xxhash64("family", "lo", "hi"))
    rows = placed.select(home.alias("home"), "id", "c", "family", "part", "lo", "hi")
    sets = materialize(corpus.sets(rows))
    percent = corpus.percent
    found = rows.join(sets, "id").groupBy("home").applyInPandas(lambda x: _family_links(x, percent), "u long, v long")
    return materialize(found)


def text_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows ``(doc_id, text_hash, n_shingles, component, component_id)`` of ``docs(doc_id, text)``, for ``near_texts``.

    ``component`` tells unlinked texts apart even if their least ``doc_id`` is the same; it is null, and ``component_id``
    is the row's own id, for rows that take no part.
    """
    own = docs.select("doc_id", "text")
    kind = dict(own.dtypes)["doc_id"]
    hashed = own.withColumn("text_hash", F.xxhash64("text"))
    drawn = materialize(mapped(hashed, _sketched(size), f"doc_id {kind}, text_hash long, n_shingles long, f1 long, f2 long, sketch binary"))
    sound = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = materialize(
        drawn.where(sound).groupBy("f1", "f2").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    corpus = _Corpus(own, classes, size, percent)
    banded = mapped(classes.select("id", "sketch"), _banded, "id long, band long")
    banded = materialize(banded)
    hubs = banded.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("top > hub").select("band", "hub")
    met = materialize(banded.join(hubs, "band"))
    pairs = materialize(met.where("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    links = corpus.links(pairs)
    merged = materialize(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    # families: classes of buckets that still hold several components, joined by their buckets
    held = met.join(merged, met["id"] == merged["node"], "left").select("band", "hub", "id", F.coalesce("component", "id").alias("c"))
    mixed = held.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("band")
    held = materialize(held.join(mixed, "band"))
    if not held.isEmpty():
        again = _between(held, corpus)
        merged = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(again))
    # each row follows its own class; unlike texts of a repeated id are classes of their own
    named = classes.join(merged, classes["id"] == merged["node"], "left").select("f1", "f2", "doc", F.coalesce("component", "id").alias("component"))
    named = materialize(named)
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = named.select("f1", "f2", "component").join(least, "component")
    rows = drawn.drop("sketch")
    return (
        rows.where(sound).join(named, ["f1", "f2"]).select("doc_id", "text_hash", "n_shingles", "component", "component_id")
        .unionByName(rows.where(~sound).select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id")))
    )


def near_texts(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Components of near-duplicate texts: ``docs(doc_id, text)`` gives ``(doc_id, n_shingles, component_id, kept)``.

    Words are runs of characters other than space and tab to carriage return, after lower-casing A-Z. A text's set is
    its distinct shingles of ``size`` words; a text with fewer words is one shingle; without words, or null, the set is
    empty and the row links with nothing. Texts link if ``100 * common >= percent * union``, decided on whole sets.
    ``component_id`` is the least ``doc_id`` reachable, the row's own included. Each row follows its own text, so that
    rows with a repeated ``doc_id`` are in one component only if their texts are; rows with a null id take no part and keep a null component. Other columns
    are ignored; an empty table gives no rows.
    """
    found = text_components(docs, size, percent).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
