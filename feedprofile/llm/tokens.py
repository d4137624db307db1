"""Token ids of whole texts by a public byte-level tokenizer, which encodes each distinct word once.

A text is cut at single blanks and line feeds between other characters, and where a mark follows a letter. The
tokenizer's own splitting always breaks there, so the ids of the parts, joined, are the ids of the text.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd

from feedprofile.llm.bytestext import SPACE, Slice, prefix_hashes, range_hashes

TOKENIZER = "byte_bpe_50k.json"
#: Distinct parts that an encoder remembers (some 20 MB); when more come, it starts anew.
REMEMBERED = 1 << 19

_BREAK = SPACE.copy()
_BREAK[0x1C:0x20] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the parts of all texts (each text starts one), and whether a sentence or line begins there."""
    n = len(data)
    wide = np.zeros(n + 8, bool)  # characters that may be white space beyond ASCII
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    three = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
    two = np.flatnonzero(data == 0xC2)
    two = two[np.isin(padded[two + 1], (0x85, 0xA0))]
    for k in range(3):
        wide[three + k] = True
    for k in range(2):
        wide[two + k] = True
    blank = _BREAK[data] | wide[:n]
    single = np.flatnonzero((data == 0x20) | (data == 0x0A))
    single = single[(single > 0) & (single < n - 1)]
    single = single[~blank[single - 1] & ~blank[single + 1]]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a text's own first and last bytes have no neighbours
    single = single[~first[single] & ~first[single + 1]]
    line = single[data[single] == 0x0A]
    cut, fresh = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    cut[single] = True
    cut[line + 1] = True
    # a mark after a letter, of ASCII or of the block with two-byte Latin letters
    letter = _LETTER[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    letter[latin[~np.isin(data[latin], (0x97, 0xB7))]] = True
    cut[1:n] |= letter[:-1] & _MARK[data[1:]]
    fresh[line + 1] = True
    space = single[data[single] == 0x20]
    fresh[space[_STOP[data[space - 1]]]] = True
    cut[offsets] = True
    cut[n] = False
    starts = np.flatnonzero(cut)
    return starts, fresh[starts]


def _put(held: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """Write values from a position on, into a longer array where they don't fit."""
    if at + len(values) > len(held):
        held = np.concatenate((held[:at], np.zeros(at + 2 * len(values), held.dtype)))
    held[at : at + len(values)] = values
    return held


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core already
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


class Encoder:
    """Encodes slices of texts, and remembers the ids of parts until the task that made it ends."""

    def __init__(self, path: str) -> None:
        self._tokenizer = _tokenizer(path)
        self._forget()

    def _forget(self) -> None:
        self._known = np.zeros(0, np.uint64)  # hashes of parts, ascending, and the numbers of these parts
        self._number = np.zeros(0, np.int64)
        self._ids = np.zeros(1 << 16, np.uint32)
        self._at = np.zeros(1 << 12, np.int64)
        self._size = np.zeros(1 << 12, np.int64)
        self._used = 0

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        got = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
        k = len(self._known)
        known, number = np.concatenate((self._known, hashes)), np.concatenate((self._number, np.arange(k, k + len(got))))
        order = np.argsort(known, kind="stable")
        self._known, self._number = known[order], number[order]
        self._at = _put(self._at, k, self._used + np.cumsum(sizes) - sizes)
        self._size = _put(self._size, k, sizes)
        self._ids = _put(self._ids, self._used, ids)
        self._used += len(ids)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is known, and its place among the known ones."""
        if not len(self._known):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self._known, hashes), len(self._known) - 1)
        return self._known[at] == hashes, at

    def encode(self, piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts joined, the number of ids of each text, and id positions where a sentence or line begins."""
        data, offsets = piece.data, piece.offsets
        n_texts = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(n_texts, np.int64), np.zeros(0, np.int64)
        starts, fresh = _parts(data, offsets)
        ends = np.append(starts[1:], len(data))
        codes, distinct = pd.factorize(range_hashes(prefix_hashes(data), starts, ends))
        if len(self._known) + len(distinct) > REMEMBERED:
            self._forget()
        new = np.flatnonzero(~self._find(distinct)[0])
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw = data.tobytes()
            self._learn(distinct[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        known = self._number[self._find(distinct)[1]][codes]
        sizes = self._size[known]
        after = np.cumsum(sizes)
        ids = self._ids[np.repeat(self._at[known] - (after - sizes), sizes) + np.arange(after[-1])]
        upto = np.concatenate(([0], after))
        return ids, np.diff(upto[np.searchsorted(starts, offsets)]), upto[np.flatnonzero(fresh)]
