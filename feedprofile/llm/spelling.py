"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

One replaced letter changes the letter counts of a word by one up and one down, an inserted one by one up, a deleted one
by one down. Words of one length form a k-d tree: a coarse one, built on a bounded sample, deals all words out to tasks,
and a task builds a fine one over the words of its box. A search passes the boxes that so many ups and downs reach; what
it meets is compared by letter counts, then letter by letter. Tasks return one row for each searched word, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedprofile.llm.storage import discard, mapped, materialize

# fixed values: the letters of a word, in Latin-1
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A document loses one letter of about one in so many of its words.
LOSS = 199
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: Words that the coarse trees are built on, about, words of a box, and of a block (larger boxes are cut into blocks).
SAMPLE, BOX, BLOCK = 1 << 16, 1 << 13, 1 << 14
#: Letters of a block at most, for very long words.
BLOCK_LETTERS = 1 << 24
#: Words of a box of the fine trees, and bytes of a comparison.
FINE, COMPARED_BYTES = 24, 1 << 23
_SPOT = np.full(256, 255, np.uint8)
_SPOT[[*range(0x61, 0x7B), *range(0xC0, 0x100)]] = np.arange(26 + 64)
WIDTH = 26 + 64


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, loss: int = LOSS) -> DataFrame:
    """Rows ``(word, n)`` of runs of letters in ``docs(doc_id, text)``, of which a few have lost a letter; see ``spelling_variants``."""
    # a run of fewer letters can't give a word, as runs only get shorter
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"[{LETTERS}]{{{min_letters},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat(F.col("d"), F.lit(":"), F.col("run")).cast("binary"))
    each = each.select("run", h.alias("h"), F.pmod(h, F.length("run").cast("long")).cast("int").alias("k"))
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), F.col("k")), F.substring(F.col("run"), F.col("k") + 2, F.length("run")))
    words = each.select(F.when(F.pmod("h", F.lit(loss)) == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Words:
    """Words of one length as Latin-1 codes and letter counts; ``bits`` tells of each letter whether its count is odd."""

    def __init__(self, words: list[str]):
        raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.codes = raw.reshape(len(words), -1)
        spots = _SPOT[self.codes].astype(np.int64)
        rows = np.arange(len(words))[:, None] * WIDTH
        self.counts = np.bincount((rows + spots).ravel(), minlength=len(words) * WIDTH).reshape(len(words), WIDTH).astype(np.int32)
        odd = self.counts.astype(np.uint64) & np.uint64(1)
        self.bits = np.bitwise_xor.reduce(odd << (np.arange(WIDTH, dtype=np.uint64) & np.uint64(63)), axis=1)


class Tree:
    """A k-d tree over letter counts; a node is (letter, greatest count to the left), a box holds row numbers."""

    def __init__(self, counts: np.ndarray, size: int):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.boxes: list[np.ndarray] = []
        self.root = self._grow(counts, np.arange(len(counts)), size)

    def _grow(self, counts: np.ndarray, rows: np.ndarray, size: int) -> int:
        """The node's number, or -1 less the box's."""
        here = counts[rows]
        if len(rows) > size:
            # the cut that divides most evenly, over all letters
            best, letter, at = 0, -1, 0
            for cut in range(int(here.max(initial=0))):
                left = (here <= cut).sum(axis=0)
                even = np.minimum(left, len(rows) - left)
                if even.max() > best:
                    best, letter, at = int(even.max()), int(even.argmax()), cut
                elif even.max() == 0:
                    break
            if letter >= 0:
                k = len(self.nodes)
                self.nodes.append((0, 0, 0, 0))
                left = here[:, letter] <= at
                self.nodes[k] = (letter, at, self._grow(counts, rows[left], size), self._grow(counts, rows[~left], size))
                return k
        self.boxes.append(rows)
        return -len(self.boxes)

    def search(self, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Boxes that ``up`` more and ``down`` fewer letters reach (0 or 1 of each), with the rows of ``counts`` that do."""
        n = len(counts)
        stack = [(self.root, np.arange(n), np.full(n, up > 0), np.full(n, down > 0))]
        while stack:
            node, rows, more, fewer = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            letter, at, left, right = self.nodes[node]
            c = counts[rows, letter]
            goes = (c <= at) | ((c == at + 1) & fewer)
            stack.append((left, rows[goes], more[goes], fewer[goes] & (c[goes] <= at)))
            goes = (c > at) | ((c == at) & more)
            stack.append((right, rows[goes], more[goes] & (c[goes] > at), fewer[goes]))


#: What a search looks for: words as long (a replaced letter), longer (an inserted one), shorter (a deleted one) than its own.
KINDS = {1: (0, 1, 1), 2: (1, 1, 0), 3: (-1, 0, 1)}


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of ``long`` give the row of ``short`` when one letter goes."""
    n = short.shape[1]
    ahead = np.logical_and.accumulate(short == long[:, :n], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= n


def neighbours(points: Words, tree: Tree, queries: Words, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) that are one edit apart."""
    shift, up, down = KINDS[kind]
    found = []
    for box, rows in tree.search(queries.counts, up, down):
        at = tree.boxes[box]
        step = max(1, COMPARED_BYTES // (8 * len(at)))
        for s in range(0, len(rows), step):
            some = rows[s : s + step]
            i, j = np.nonzero(np.bitwise_count(queries.bits[some][:, None] ^ points.bits[at][None]) <= 2)
            if len(i):
                found.append((some[i], at[j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = np.zeros(len(i), bool)
    step = max(1, COMPARED_BYTES // (4 * max(WIDTH, points.codes.shape[1])))
    for s in range(0, len(i), step):
        a, b = i[s : s + step], j[s : s + step]
        near = np.flatnonzero(np.abs(queries.counts[a] - points.counts[b]).sum(axis=1) == (1 if shift else 2))
        x, y = queries.codes[a[near]], points.codes[b[near]]
        same = (x != y).sum(axis=1) == 1 if shift == 0 else _one_edit(x, y) if shift > 0 else _one_edit(y, x)
        keep[s + near[same]] = True
    return i[keep], j[keep]


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


def _coarse(sample: list[str], size: int) -> dict[int, Tree]:
    out = {}
    for length, at in _by_length(sample):
        out[length] = Tree(Words([sample[k] for k in at]).counts, size)
        out[length].boxes = [np.zeros(0, np.int64)] * len(out[length].boxes)
    return out


def _routed(trees: dict[int, Tree]):
    """Every word to its own box (kind 0), and to the boxes that its searches reach (kinds 1 to 3)."""

    def run(batches):
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
            for length, at in _by_length(words):
                here = Words([words[k] for k in at])
                for kind, (shift, up, down) in {0: (0, 0, 0), **KINDS}.items():
                    tree = trees.get(length + shift)
                    reached = tree.search(here.counts, up, down) if tree else [(0, np.arange(len(at)))]
                    for box, rows in reached:
                        to = at[rows]
                        yield pa.RecordBatch.from_pydict({
                            "length": pa.array([length + shift] * len(to), pa.int32()), "box": pa.array([box] * len(to), pa.int32()),
                            "kind": pa.array([kind] * len(to), pa.int32()), "word": batch.column("word").take(pa.array(to)), "n": pa.array(n[to], pa.int64()),
                        })

    return run


_FOUND = "word string, n_near long, best_n long, best string"


def _searched(batches):
    """Partitions sorted by block and kind: first a block's words, then searches, of which batches are held."""
    block, held, held_n, points, tree = None, [], [], None, None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "box", "part", "kind")], axis=1)
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if a == b:
                continue
            *here, kind = (int(x) for x in keys[a])
            if here != block:
                block, held, held_n, points, tree = here, [], [], None, None
            if kind == 0:
                held += words[a:b]
                held_n.append(n[a:b])
                continue
            if not held:
                continue  # no word lies here
            if points is None:
                points, counts = Words(held), np.concatenate(held_n)
                tree = Tree(points.counts, FINE)
            i, j = neighbours(points, tree, Words(words[a:b]), kind)
            if not len(i):
                continue
            order = np.lexsort((j, -counts[j], i))  # a block's words are in order, so that ties go to the first
            i, j = i[order], j[order]
            first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            yield pa.RecordBatch.from_pydict({
                "word": pa.array([words[a + k] for k in i[first]], pa.string()), "n_near": pa.array(np.diff([*first, len(i)]), pa.int64()),
                "best_n": pa.array(counts[j[first]], pa.int64()), "best": pa.array([held[k] for k in j[first]], pa.string()),
            })


def near_words(vocabulary: DataFrame, sample: int = SAMPLE, box: int = BOX, block: int = BLOCK) -> DataFrame:
    """Rows ``(word, n_near, best_n, best)`` for words of ``vocabulary(word, n)`` that have another word one edit away."""
    total = vocabulary.count()
    # a draw by hash of some ``sample`` words; tasks send what they draw and no more
    drawn = [r["word"] for r in vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < (sample << 30) / max(total, 1)).select("word").collect()]
    trees = _coarse(drawn, max(8, box * len(drawn) // max(total, 1)))
    routed = materialize(mapped(vocabulary, _routed(trees), "length int, box int, kind int, word string, n long"))
    spot = ["length", "box"]
    # boxes beyond a block: fewer than the coarse trees have boxes, and one for a length that the sample lacks
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_LETTERS) / F.col("length"))))
    large = routed.where("kind = 0").groupBy(*spot).agg(F.count("*").alias("size")).where(F.col("size") > most)
    large = large.select(*spot, F.ceil(F.col("size") / most).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    own = F.array(F.pmod(F.xxhash64("word"), parts).cast("int"))
    placed = routed.join(F.broadcast(large), spot, "left").withColumn("part", F.explode(F.when(F.col("kind") == 0, own).otherwise(F.sequence(F.lit(0), parts - 1)))).drop("parts")
    dealt = placed.repartition(*spot, "part").sortWithinPartitions(*spot, "part", "kind", "word")
    found = mapped(dealt.select(*spot, "part", "kind", "word", "n"), _searched, _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    merged = materialize(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best")))
    discard(routed)
    return merged


def roots(forms: DataFrame) -> DataFrame:
    """Rows ``(word, root)`` of ``forms(word, form)``, whose chains end: the last form. A round doubles the steps taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        past, now = now, materialize(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(past)
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, ratio: int = RATIO, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, loss: int = LOSS) -> DataFrame:
    """Words of ``docs(doc_id, text)`` with their likely form: ``(word, n, n_near, form, form_n, root)``.

    Words are maximal runs of Latin-1 letters, A-Z in lower case, of ``min_letters`` or more and ``min_count``
    occurrences or more. Where ``loss`` divides the crc32 ``h`` of ``<doc_id>:<run>``, the run loses its letter number
    ``h % length``. Words are near if they differ by one inserted, deleted or replaced letter; a word's form is its near
    word of greatest n (ties: the smallest) where that is ``ratio`` times its own or more, and its root the last of the
    forms. Null and empty texts have no words; a null id counts as an empty one; repeated rows count each; other columns
    are ignored; an empty table gives no rows.
    """
    vocabulary = materialize(word_counts(docs.select("doc_id", "text"), min_letters, min_count, loss))
    likely: Column = F.coalesce(F.col("best_n") >= F.col("n") * ratio, F.lit(False))
    named = materialize(vocabulary.join(near_words(vocabulary), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("best")).alias("form"), F.when(likely, F.col("best_n")).alias("form_n")
    ))
    ends = roots(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
