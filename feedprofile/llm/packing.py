"""Packing of token ids into windows by order-preserving dynamic programming.

The ids of a task's documents, in their order, form one stream. Windows end at document ends, at starts of sentences and
lines, and within sentences of more than LONG ids also on a coarse grid. A cut list costs its padding plus a penalty for
each cut within a document. A window's padding falls by one with each id, so the best earlier cut is the least of
``cost + position`` over the last WINDOW ids, which a monotone queue gives in constant time; windows whose length is a
power of two need no padding, and are looked up among the places beside it.
"""

from __future__ import annotations

import zlib
from collections import deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from feedprofile.llm.bytestext import distinct_sorted, slices
from feedprofile.llm.storage import mapped
from feedprofile.llm.tokens import Encoder, tokenizer_path

WINDOW = 1024
#: Shorter lengths that need no padding, and are taken where they fit.
UNPADDED = (128, 256, 512)
#: Penalties, in ids of padding, of a cut within a document before a sentence or line, and within a sentence.
AT_SENTENCE, IN_SENTENCE = 4, 24
#: Only sentences of more than LONG ids may be cut, at each STRIDE ids.
LONG, STRIDE = 96, 16
#: About so many bytes of text are packed at once; what is left after the last whole window goes on.
TOGETHER_BYTES = 2 << 20
END_ID = 0


def candidates(doc_ends: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending, and their penalties; no gap exceeds LONG."""
    total = int(doc_ends[-1])
    sentences = sentences[(sentences > 0) & (sentences < total)]
    marks = distinct_sorted(np.concatenate(([0], doc_ends, sentences)))
    gaps = np.diff(marks)
    more = np.where(gaps > LONG, (gaps - 1) // STRIDE, 0)
    long = np.flatnonzero(more)
    extra = np.repeat(marks[long], more[long]) + STRIDE * (np.arange(more[long].sum()) - np.repeat(np.cumsum(more[long]) - more[long], more[long]) + 1)
    places = distinct_sorted(np.concatenate((marks, extra)))
    costs = np.full(len(places), IN_SENTENCE, np.int64)
    costs[np.searchsorted(places, sentences)] = AT_SENTENCE
    costs[np.searchsorted(places, doc_ends)] = 0
    return places, costs


def best_cuts(places: np.ndarray, costs: np.ndarray, window: int = WINDOW, unpadded: tuple[int, ...] = UNPADDED) -> np.ndarray:
    """Ends of the cheapest windows over ``places`` (the first is 0, the last is the end of the stream)."""
    at, price = places.tolist(), costs.tolist()
    n = len(at)
    exact: dict[int, list[int]] = {}  # places from which a window of an unpadded length ends here
    for length in unpadded:
        begin = np.searchsorted(places, places - length)
        for j in np.flatnonzero(places[begin] == places - length).tolist():
            exact.setdefault(j, []).append(int(begin[j]))
    total, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, index), least first
    for j in range(1, n):
        p = at[j]
        while at[queue[0][1]] < p - window:
            queue.popleft()
        key, i = queue[0]
        cost = key + window - p
        for k in exact.get(j, ()):
            if total[k] < cost:
                cost, i = total[k], k
        cost += price[j]
        total[j], back[j] = cost, i
        key = cost + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], n - 1
    while j:
        out.append(at[j])
        j = back[j]
    return np.array(out[::-1], np.int64)


class Stream(NamedTuple):
    """Ids of consecutive documents, the first of which may have begun before."""

    ids: np.ndarray
    ends: np.ndarray
    sentences: np.ndarray
    doc_ids: pa.Array
    tokens: np.ndarray
    #: Ids of the first document that went before.
    gone: int

    @staticmethod
    def of(encoded: tuple[np.ndarray, np.ndarray, np.ndarray], doc_ids: pa.Array) -> Stream:
        """Documents of a slice, each with its end id."""
        plain, counts, sentences = encoded
        tokens = counts + 1
        ends = np.cumsum(tokens)
        ids = np.full(ends[-1], END_ID, np.uint32)
        inner = np.ones(ends[-1], bool)
        inner[ends - 1] = False
        ids[inner] = plain
        before = np.searchsorted(ends - np.arange(1, len(ends) + 1), sentences, "right")  # end ids before each mark
        return Stream(ids, ends, sentences + before, doc_ids, tokens, 0)

    @staticmethod
    def joined(parts: list[Stream]) -> Stream:
        upto = np.cumsum([0, *(len(p.ids) for p in parts)])[:-1]
        return Stream(
            np.concatenate([p.ids for p in parts]), np.concatenate([p.ends + a for p, a in zip(parts, upto, strict=True)]),
            np.concatenate([p.sentences + a for p, a in zip(parts, upto, strict=True)]), pa.concat_arrays([p.doc_ids for p in parts]),
            np.concatenate([p.tokens for p in parts]), parts[0].gone,
        )

    def rest(self, at: int) -> Stream:
        """What follows a position within the stream."""
        first = int(np.searchsorted(self.ends, at, "right"))
        begun = at - (self.ends[first - 1] if first else -self.gone)
        return Stream(self.ids[at:], self.ends[first:] - at, self.sentences[self.sentences > at] - at, self.doc_ids[first:], self.tokens[first:], int(begun))

    def pieces(self, cuts: np.ndarray, number: int) -> pa.RecordBatch:
        """Rows for the pieces of documents in the windows that end at ``cuts``."""
        edges = distinct_sorted(np.concatenate(([0], cuts, self.ends[self.ends < cuts[-1]])))
        lo, hi = edges[:-1], edges[1:]
        doc, window = np.searchsorted(self.ends, lo, "right"), np.searchsorted(cuts, lo, "right")
        begins = np.concatenate(([-self.gone], self.ends[:-1]))
        raw = memoryview(self.ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        return pa.RecordBatch.from_pydict({
            "doc_id": self.doc_ids.take(pa.array(doc)), "start": pa.array(lo - begins[doc]), "length": pa.array(hi - lo),
            "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(self.tokens[doc]),
            "sequence_id": pa.array(number + window), "offset": pa.array(lo - np.concatenate(([0], cuts))[window]),
        })


def _pack(path: str):
    def pack(batches):
        encode, number = Encoder(path).encode, TaskContext.get().partitionId() << 36
        held: list[Stream] = []
        size = 0

        def flush(last: bool):
            """Packs what is held; the last windows stay open while more may come."""
            nonlocal held, number, size
            stream = Stream.joined(held)
            cuts = best_cuts(*candidates(stream.ends, stream.sentences))
            closed = cuts if last else cuts[cuts <= len(stream.ids) - WINDOW]
            held, size = ([] if last or not len(closed) else [stream.rest(int(closed[-1]))]), 0
            if not len(closed):
                held = [stream]
            else:
                out = stream.pieces(closed, number)
                number += len(closed)
                yield out

        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id")
            for piece in slices(texts):
                held.append(Stream.of(encode(piece), doc_ids.slice(piece.first, len(piece.offsets) - 1)))
                size += len(piece.data) + len(piece.offsets)
                if size >= TOGETHER_BYTES:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return pack


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pack all ``docs(doc_id, text)`` into windows of at most 1024 ids; one row for each piece of a document.

    A document's ids are its text's, then id 0; a null text is empty and so gives the one id 0. Pieces carry
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Each input partition is one stream (no
    shuffle), of which some 2 MB of text are held at a time. Windows keep the order of rows in a partition, so that how the
    table is cut into partitions (by its files, and by the cores where these are more) decides which documents meet. Rows with equal or null ids
    are packed each on its own; other columns are ignored; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return mapped(docs.select("doc_id", "text"), _pack(tokenizer or tokenizer_path()), schema)
