"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms.

Every string of LENGTH bytes has an anchor, its first window of GRAM bytes with the least hash; equal strings have equal
anchors at equal places. A text falls into segments, one for each anchor: all LENGTH-byte strings that the anchor stands
for. Three passes over the texts narrow down what has to be sorted:

1. Anchors that occur once settle their strings: these do not repeat. Of the others a Bloom filter of bounded size is kept.
2. Whole segments that occur twice settle theirs: all repeat.
3. What is left are segments that share an anchor and differ somewhere. They meet by anchor; each is cut into blocks of
   BLOCK bytes counted from the anchor. A group's shards each get a Burrows-Wheeler transform over block symbols, and
   the transforms are merged by refining their interleave one symbol a step, without sorting the suffixes again. Where
   neighbours part gives the common prefixes; intervals with a common prefix of CORE blocks are the repeats, whose few
   bytes before and after the blocks are then compared exactly.

Anchors with very many differing segments (a line that is everywhere) are settled by counting their strings' hashes.

Beside the bytes to remove, documents that share a passage of PASSAGE words with another document are told, as these may be
shorter than LENGTH bytes. Passages have anchors too, which join the first pass. Texts without a repeated string that hold
a repeated anchor are looked at again: the passages with their anchors, in all texts, are counted by hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedprofile.llm.bytestext import Slice, mix, prefix_hashes, range_hashes, running_hashes, slices, word_hashes
from feedprofile.llm.mixing import word_count
from feedprofile.llm.storage import mapped, materialize

LENGTH, GRAM, BLOCK = 400, 64, 16
#: Blocks that any LENGTH bytes hold whole.
CORE = LENGTH // BLOCK - 1
#: Bits of the filter: FILTER_BITS a repeated anchor, but no more than FILTER_MOST (32 MB).
FILTER_BITS, FILTER_MOST = 16, 1 << 28
#: Words of a passage that documents may share, and of its anchor.
PASSAGE, HALF = 50, 25
#: Hashes of texts are broadcast up to this number (some 30 MB), and joined by shuffle beyond it.
BROADCAST_TEXTS = 1_000_000
#: Segments of a group and shards of it; anchors with more differing segments than CROWD are counted instead.
TOGETHER, SHARDS, CROWD = 4000, 4, 4096


def segments(piece: Slice) -> tuple[np.ndarray, ...]:
    """Text number, anchor hash, anchor position, and first and last string start of all segments of a slice."""
    data, offsets = piece.data, piece.offsets
    n, width = len(data), LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    long = np.diff(offsets) >= LENGTH
    if not long.any():
        return none, none.astype(np.uint64), none, none, none, np.zeros(1, np.uint64)
    sums = prefix_hashes(data)
    at = np.arange(n - GRAM + 1)
    hashes = range_hashes(sums, at, at + GRAM)
    anchor = least_of(hashes, width)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    first, last = _stretches(anchor, owner, offsets, LENGTH)
    x = anchor[first]
    return owner[first], hashes[x], x, first, last, sums


def least_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each ``width`` consecutive hashes, by running minima of blocks."""
    bits = np.uint64(max(20, len(hashes).bit_length()))
    ranked = (hashes >> bits << bits) | np.arange(len(hashes)).astype(np.uint64)
    blocks = np.full(-(-len(ranked) // width) * width, np.iinfo(np.uint64).max)
    blocks[: len(ranked)] = ranked
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(ranked) - width + 1
    least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _stretches(anchor: np.ndarray, owner: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of each run of strings of ``length`` that lie within a text and share an anchor."""
    place = np.flatnonzero(np.arange(len(anchor)) + length <= offsets[owner + 1])
    edge = np.flatnonzero(np.concatenate(([True], (anchor[place[1:]] != anchor[place[:-1]]) | (owner[place[1:]] != owner[place[:-1]]))))
    return place[edge], place[np.append(edge[1:], len(place)) - 1]


def passages(piece: Slice) -> tuple[np.ndarray, ...]:
    """Text number, anchor hash, and first and last start of all runs of PASSAGE words with one anchor; sums over words.

    An anchor is the HALF words with the least hash among a passage's.
    """
    hashes, counts = word_hashes(piece, lower=False)
    none = np.zeros(0, np.int64)
    if counts.max(initial=0) < PASSAGE:
        return none, none.astype(np.uint64), none, none, np.zeros(1, np.uint64)
    sums = running_hashes(hashes)
    at = np.arange(len(hashes) - HALF + 1)
    halves = range_hashes(sums, at, at + HALF)
    anchor = least_of(halves, PASSAGE - HALF + 1)
    owner = np.repeat(np.arange(len(counts)), counts)[: len(anchor)]
    first, last = _stretches(anchor, owner, np.concatenate(([0], np.cumsum(counts))), PASSAGE)
    return owner[first], mix(halves[anchor[first]]), first, last, sums


def _anchors(batches):
    for batch in batches:
        found = [keys for p in slices(batch.column("text")) for keys in (segments(p)[1], passages(p)[1])]
        keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "n": pa.array(counts.astype(np.int64))})


def _spots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return mix(keys + np.uint64(1)) & mask, mix(keys + np.uint64(2)) & mask


def bloom_filter(keys: DataFrame, n_keys: int) -> tuple[np.ndarray, int]:
    """Bits for ``keys(key)``, built in parts by the executors; at most FILTER_MOST bits reach the driver."""
    bits = 1 << max(16, min(FILTER_MOST, n_keys * FILTER_BITS) .bit_length() - 1)
    parts = 64

    def build(spots: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(bits // parts // 8, np.uint8)
        at = spots["spot"].to_numpy() % (bits // parts)
        np.bitwise_or.at(part, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pd.DataFrame({"part": [int(spots["part"].iloc[0])], "bits": [part.tobytes()]})

    def spread(batches):
        for batch in batches:
            both = np.concatenate(_spots(batch.column("key").to_numpy().view(np.uint64), bits)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"part": pa.array((both // (bits // parts)).astype(np.int32)), "spot": pa.array(both)})

    rows = mapped(keys.select("key"), spread, "part int, spot long").distinct().groupBy("part").applyInPandas(build, "part int, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    size = bits // parts // 8
    for r in rows:
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out, bits


def _may_hold(held: tuple[np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    bits, size = held
    out = np.ones(len(keys), bool)
    for spot in _spots(keys, size):
        spot = spot.astype(np.int64)
        out &= (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
    return out


def _segment_hashes(sums: np.ndarray, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(range_hashes(sums, first, last + LENGTH) + (x - first).astype(np.uint64))


def _candidates(filter_, with_bytes: bool):
    def run(batches):
        held, done = filter_.value, set()
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            for piece in slices(batch.column("text")):
                text, keys, x, first, last, sums = segments(piece)
                seg = _segment_hashes(sums, x, first, last) if len(x) else keys
                keep = np.flatnonzero(_may_hold(held, seg if with_bytes else keys))
                if with_bytes:  # a common segment leaves each task once
                    new = keep[np.unique(seg[keep], return_index=True)[1]]
                    keep = np.sort(new[[s not in done for s in seg[new].tolist()]]) if len(new) else new
                    done.update(seg[keep].tolist())
                text, keys, x, first, last, seg = (v[keep] for v in (text, keys, x, first, last, seg))
                begin = piece.offsets[text]
                out = {
                    "key": pa.array(keys.view(np.int64)), "seg": pa.array(seg.view(np.int64)),
                    "h1": pa.array(h1[piece.first + text]), "h2": pa.array(h2[piece.first + text]),
                    "lo": pa.array(first - begin), "hi": pa.array(last - begin),
                }
                if with_bytes:
                    out["off"] = pa.array(x - first)
                    raw = piece.data.tobytes()
                    out["raw"] = pa.array([raw[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return run


def transform(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of strings that each end in symbol 0: rotations in order, and the symbol before each.

    Rotations are sorted by doubling; equal rotations keep the order of their strings.
    """
    ends = np.cumsum(lengths)
    starts = np.repeat(ends - lengths, lengths)
    size = np.repeat(lengths, lengths)
    place = np.arange(len(symbols)) - starts
    rank, step, longest = symbols.astype(np.int64), 1, int(lengths.max(initial=0))
    while step < longest:
        pair = rank * (len(symbols) + int(symbols.max(initial=0)) + 1) + rank[starts + (place + step) % size]
        rank = pd.factorize(pair, sort=True)[0].astype(np.int64)
        step *= 2
    order = np.argsort(rank, kind="stable")
    return order, symbols[starts[order] + (place[order] - 1) % size[order]]


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of transforms, refined ``depth`` times: the shard of each row, and which rows share ``depth`` symbols.

    A step reads the next symbol of each row's shard in the order so far and deals the rows out by it, keeping their order;
    rows that share a symbol and stood in one interval before stay in one interval, others part there.
    """
    shard = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms])
    every = np.concatenate(transforms)
    interval = np.zeros(len(every), np.int64)
    for _ in range(depth):
        symbol = np.empty(len(every), every.dtype)
        symbol[np.argsort(shard, kind="stable")] = every
        moved = np.argsort(symbol, kind="stable")
        symbol, before = symbol[moved], interval[moved]
        parts = np.concatenate(([False], (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])))
        interval, shard = np.cumsum(parts), shard[moved]
    return shard, interval


def repeated_strings(raws: list[bytes], offs: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """For each segment, which of its LENGTH-byte strings occur again in the group; a weight of 2 is a repeated segment."""
    sizes = np.array([len(r) for r in raws])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(raws), np.uint8)
    sums = prefix_hashes(data)
    head = offs % BLOCK
    blocks = (sizes - head) // BLOCK
    owner = np.repeat(np.arange(len(raws)), blocks)
    number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = starts[owner] + head[owner] + BLOCK * number
    names = pd.factorize(range_hashes(sums, at, at + BLOCK))[0] + 1
    # strings of block symbols, each with its end, dealt to shards in turn
    lengths = blocks + 1
    begin = np.cumsum(lengths) - lengths
    symbols = np.zeros(lengths.sum(), np.int64)
    symbols[begin[owner] + number] = names
    rows, turned = [], []
    for k in range(SHARDS):
        mine = np.arange(k, len(raws), SHARDS)
        spots = np.repeat(begin[mine] - (np.cumsum(lengths[mine]) - lengths[mine]), lengths[mine]) + np.arange(lengths[mine].sum())
        order, before = transform(symbols[spots], lengths[mine]) if len(mine) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        rows.append(spots[order])
        turned.append(before)
    shard, interval = merge(turned, CORE)
    suffix = np.empty(len(shard), np.int64)
    suffix[np.argsort(shard, kind="stable")] = np.concatenate(rows)
    group = np.empty(len(symbols), np.int64)
    group[suffix] = interval
    crowd = np.bincount(interval, minlength=1)[group] > 1
    # strings of LENGTH bytes whose whole blocks lie in an interval of several suffixes are compared exactly
    wins = sizes - LENGTH + 1
    who = np.repeat(np.arange(len(raws)), wins)
    p = np.arange(wins.sum()) - np.repeat(np.cumsum(wins) - wins, wins)
    block = begin[who] + (p - head[who] + BLOCK - 1) // BLOCK
    try_ = np.flatnonzero(crowd[block])
    hashes = range_hashes(sums, starts[who[try_]] + p[try_], starts[who[try_]] + p[try_] + LENGTH)
    same, _ = pd.factorize(mix(hashes) + mix(group[block[try_]].astype(np.uint64)))
    total = np.bincount(same, weights[who[try_]], minlength=1)
    again = np.zeros(len(p), bool)
    again[try_] = total[same] >= 2
    return np.split(again, np.cumsum(wins)[:-1])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    flags = repeated_strings(rows["raw"].tolist(), rows["off"].to_numpy(), rows["weight"].to_numpy())
    out = []
    for k, f in enumerate(flags):
        if rows["weight"].iat[k] == 1 and f.any():
            a, b = _runs(f)
            lo = rows["lo"].iat[k]
            out.append(pd.DataFrame({"h1": rows["h1"].iat[k], "h2": rows["h2"].iat[k], "lo": a + lo, "hi": b + lo}))
    return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("h1", "h2", "lo", "hi")})


def _strings(batches):
    for batch in batches:
        for k in range(len(batch)):
            row = {c: batch.column(c)[k].as_py() for c in ("key", "weight", "h1", "h2", "lo", "off")}
            data = np.frombuffer(batch.column("raw")[k].as_buffer(), np.uint8)
            p = np.arange(len(data) - LENGTH + 1)
            n = len(p)
            yield pa.RecordBatch.from_pydict({
                **{c: pa.array(np.full(n, row[c], np.int64)) for c in ("key", "weight", "h1", "h2")},
                "at": pa.array(p + row["lo"]), "s": pa.array(mix(range_hashes(prefix_hashes(data), p, p + LENGTH) + (row["off"] - p).astype(np.uint64)).view(np.int64)),
            })


def _passages(filter_, whole: bool):
    """Anchors ``(key)`` of passages that the filter may hold, or the hashes of these passages, of each text ``(h1, h2)``."""
    def run(batches):
        held = filter_.value
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            for piece in slices(batch.column("text")):
                text, keys, first, last, sums = passages(piece)
                keep = np.flatnonzero(_may_hold(held, keys))
                text, keys, at = text[keep], keys[keep], first[keep]
                if whole:
                    n = last[keep] - at + 1
                    text, at = np.repeat(text, n), np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    keys = range_hashes(sums, at, at + PASSAGE)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "h1": pa.array(h1[piece.first + text]), "h2": pa.array(h2[piece.first + text])})

    return run


def _small(texts: DataFrame) -> DataFrame:
    return F.broadcast(texts) if texts.count() <= BROADCAST_TEXTS else texts


def shared_passages(texts: DataFrame, quiet: DataFrame, repeated: Broadcast) -> DataFrame:
    """Texts ``(h1, h2)`` of ``quiet`` that share PASSAGE words with a differing text of ``texts(h1, h2, text)``.

    ``repeated`` is the filter of repeated anchors.
    """
    schema = "key long, h1 long, h2 long"
    some = materialize(mapped(quiet, _passages(repeated, False), schema).distinct())
    keys = materialize(some.select("key").distinct())
    n = keys.count()
    some = some.select("h1", "h2").distinct()
    if n == 0:
        return some
    wanted = texts.sparkSession.sparkContext.broadcast(bloom_filter(keys, n))
    each = materialize(mapped(texts, _passages(wanted, True), schema).distinct())
    shared = each.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("key")
    return each.join(shared, "key").select("h1", "h2").distinct().join(some, ["h1", "h2"], "left_semi")


def _cut(batches):
    for batch in batches:
        texts, runs, shared = batch.column("text"), batch.column("runs"), batch.column("shared")
        out = []
        for k in range(len(batch)):
            raw = (texts[k].as_py() or "").encode()
            spans: list[list[int]] = []
            for r in sorted((r["lo"], r["hi"] + LENGTH) for r in runs[k].as_py() or ()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            out.append((len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), int(bool(spans) or shared[k].as_py() is not None), [x for s in spans for x in s]))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_bytes": pa.array([o[0] for o in out], pa.int64()), "n_removed": pa.array([o[1] for o in out], pa.int64()),
            "n_spans": pa.array([o[2] for o in out], pa.int64()), "kept_sha256": pa.array([o[3] for o in out], pa.string()),
            "has_passage": pa.array([o[4] for o in out], pa.int32()), "spans": pa.array([o[5] for o in out], pa.list_(pa.int64())),
        })


def repeated_runs(texts: DataFrame) -> tuple[DataFrame, Broadcast]:
    """Runs ``(h1, h2, lo, hi)`` of starts of repeated LENGTH-byte strings, from ``texts(h1, h2, text)``; the filter of repeated anchors."""
    sc = texts.sparkSession.sparkContext
    anchors = mapped(texts.select("text"), _anchors, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    anchors = materialize(anchors.select("key"))
    kept = every = sc.broadcast(bloom_filter(anchors, anchors.count()))
    found = materialize(mapped(texts, _candidates(kept, False), "key long, seg long, h1 long, h2 long, lo long, hi long"))
    counts = found.groupBy("key", "seg").agg(F.count("*").alias("m"))
    crowds = counts.groupBy("key").agg(F.count("*").alias("segs"))
    counts = materialize(counts.join(crowds, "key").where("m > 1 or segs > 1"))
    whole = found.join(counts.where("m > 1").select("key", "seg"), ["key", "seg"]).select("h1", "h2", "lo", "hi").distinct()
    # anchors with several segments of which one at least is not settled yet
    mixed = counts.where("segs > 1").groupBy("key").agg(F.min("m").alias("least")).where("least = 1").select("key")
    open_ = materialize(counts.join(mixed, "key").where("segs > 1").select("key", "seg", "m", "segs"))
    n = open_.count()
    if n == 0:
        return whole, every
    kept = sc.broadcast(bloom_filter(open_.select(F.col("seg").alias("key")), n))
    raws = mapped(texts, _candidates(kept, True), "key long, seg long, h1 long, h2 long, lo long, hi long, off long, raw binary")
    raws = materialize(raws.join(open_, ["key", "seg"]).dropDuplicates(["key", "seg"]).withColumn("weight", F.least("m", F.lit(2)).cast("long")))
    home = F.pmod(F.xxhash64("key"), F.lit(max(1, n // TOGETHER)))
    some = raws.where(F.col("segs") <= CROWD).withColumn("home", home).groupBy("home").applyInPandas(_settled, "h1 long, h2 long, lo long, hi long")
    strings = mapped(raws.where(F.col("segs") > CROWD), _strings, "key long, weight long, h1 long, h2 long, at long, s long")
    again = strings.groupBy("key", "s").agg(F.sum("weight").alias("w")).where("w > 1").select("key", "s")
    many = strings.where("weight = 1").join(again, ["key", "s"]).select("h1", "h2", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return whole.unionByName(some).unionByName(many), every


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Cut every byte that a LENGTH-byte string covers which also starts elsewhere: ``docs(doc_id, text)`` gives
    ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_passage, spans)``; ``spans`` lists starts and ends of removed runs.

    Strings are judged on the input, within texts only; overlapping occurrences count. A null text is empty; texts under
    LENGTH bytes stay whole. ``has_passage`` is 1 for documents with such a string, or with PASSAGE words in a row that
    another document has too, however they are spaced; these are told, not cut. Rows with equal texts repeat each other,
    whatever their ids. Other columns are ignored; an empty table gives no rows.
    """
    known = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    texts = known.select("h1", "h2", "text").where(F.octet_length("text") >= 2 * PASSAGE - 1)
    runs, repeated = repeated_runs(texts)
    runs = materialize(runs)
    # of texts without a repeated string, only short ones have copies
    copies = texts.where(F.octet_length("text") < LENGTH).select("h1", "h2", (word_count(F.col("text")) >= PASSAGE).alias("long"))
    copies = copies.where("long").groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    told = _small(materialize(runs.select("h1", "h2").distinct()))
    shared = shared_passages(texts, texts.join(told, ["h1", "h2"], "left_anti"), repeated).unionByName(copies).distinct()
    by_text = runs.groupBy("h1", "h2").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    joined = known.join(by_text, ["h1", "h2"], "left").join(_small(materialize(shared.withColumn("shared", F.lit(1)))), ["h1", "h2"], "left").select("doc_id", "text", "runs", "shared")
    kind = dict(docs.dtypes)["doc_id"]
    return mapped(joined, _cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, has_passage int, spans array<long>")
