"""Operator 3: words of repeated 35-word windows, by a compressed FM-index per shard.

Candidate pieces (see ``repeats``) are joined in shards. A shard's pieces are indexed once: the last column of their sorted
suffixes, kept as a wavelet matrix of packed bits with a count per 64 of them. The documents' pieces are then streamed
past the index. Backward search extends the match at every word by one more word to the left, for all places at once, as
long as it still occurs twice; the matching statistics so found, cut at the window length, give the intervals above the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dictalog.llm import batches as B
from dictalog.llm.repeats import Repeats, covered, without_repeats

LENGTH = 35


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of an integer sequence by their first ``depth`` values at least (a shorter suffix comes first)."""
    rank, h = np.unique(t, return_inverse=True)[1].astype(np.uint64) + np.uint64(1), 1
    while True:
        after = np.zeros(len(t), np.uint64)
        after[:-h] = rank[h:]
        key = (rank << np.uint64(32)) | after
        order = np.argsort(key, kind="stable")
        new = np.ones(len(t), np.uint64)
        new[1:] = np.diff(key[order]) != 0
        rank[order] = np.cumsum(new)
        h *= 2
        if h >= depth or h >= len(t) or rank[order[-1]] == len(t):
            return order


class Bits:
    """A bit vector in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate(([0], np.cumsum(ones[:-1]))).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)


class FMIndex:
    """Counts of a pattern in a sequence of small integers."""

    def __init__(self, t: np.ndarray, depth: int):
        order = suffix_order(t, depth)
        self.n, top = len(t), int(t.max()) + 1
        column = t[order - 1]  # before the first suffix stands the last value, a separator
        self.first = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=top))))[:top]
        self.levels, self.zeros = [], []
        start = np.zeros(top, np.int64)
        symbols = np.arange(top)
        for level in range(max(1, (top - 1).bit_length()) - 1, -1, -1):
            bit = (column >> level) & 1
            bits, zeros = Bits(bit.astype(bool)), int((bit == 0).sum())
            ones = bits.rank(start)
            start = np.where((symbols >> level) & 1, zeros + ones, start - ones)
            self.levels.append((level, bits))
            self.zeros.append(zeros)
            column = np.concatenate((column[bit == 0], column[bit == 1]))
        self.start = start  # of each symbol in the last level

    def before(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before place i of the last column."""
        for (level, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i - self.start[symbol]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of the symbol followed by what [lo, hi) stands for."""
        at = self.before(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        first = self.first[symbol]
        return first + at[: len(lo)], first + at[len(lo) :]


def matching_statistics(index: FMIndex, t: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """For each end place: how many values before it, ``most`` at most, occur in the index twice or more."""
    length = np.zeros(len(ends), np.int64)
    act = np.arange(len(ends))
    lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), index.n)
    for back in range(1, most + 1):
        lo, hi = index.extend(t[ends[act] - back], lo, hi)
        more = hi - lo >= 2
        act, lo, hi = act[more], lo[more], hi[more]
        length[act] = back
        if not len(act):
            break
    return length


def judge(pieces: list[np.ndarray], times: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, which of its windows stand twice or more in the pieces (each counted ``times`` times)."""
    sizes = np.array([len(p) for p in pieces])
    words, ids = np.unique(np.concatenate(pieces), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    t = np.full(begin[-1], len(words), np.int64)  # separators are the largest symbol
    t[np.arange(len(ids)) + np.repeat(np.arange(len(pieces)), sizes)] = ids
    index = FMIndex(t, length + 1)
    marks = [np.ones(max(0, s - length + 1), bool) for s in sizes]
    once = np.flatnonzero(times == 1)  # the windows of the others stand twice at least
    if len(once):
        ends = np.concatenate([np.arange(begin[i] + length, begin[i] + sizes[i] + 1) for i in once])
        hit = matching_statistics(index, t, ends, length) >= length
        for i, m in zip(once, np.split(hit, np.cumsum(sizes[once] - length + 1)[:-1])):
            marks[i] = m
    return marks


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = B.text_bytes(column)
    starts, ends, words = B.word_bounds(data, off)
    return B.word_values(data, starts, ends), words


def word_repeats(length: int = LENGTH, gram: int = 8, block: int = 60_000, heavy: int = 600_000) -> Repeats:
    return Repeats(length, gram, _units, lambda units: units, judge, np.uint64, block, heavy)


def remove_repeats(docs: DataFrame, how: Repeats | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the words of repeated windows taken out.

    Puts n_words, n_removed and kept (the words left, joined by one space) in place of the text. All other columns stay; columns
    of these names are replaced. Null text has no words. Rows are told apart by position, so repeated rows and ids are repeats
    of each other. Words are compared by a 64-bit hash each. ``docs`` must be a table scan or another plan that reads the same each time.
    """
    return without_repeats(docs, how or word_repeats(), _cut, {"n_words": "long", "n_removed": "long", "kept": "string"}, text)


def _cut(b: pa.RecordBatch, how: Repeats) -> list[pa.Array]:
    data, off = B.text_bytes(b.column("text"))
    starts, ends, words = B.word_bounds(data, off)
    gone = covered(b, words, how.length)
    removed = np.concatenate(([0], np.cumsum(gone)))[words]
    # each kept word with one byte after it, set to a space; the last one of a document is cut off below
    stay = ~gone
    sizes = (ends - starts)[stay] + 1
    to = np.concatenate(([0], np.cumsum(sizes)))
    source = np.repeat(starts[stay] - to[:-1], sizes) + np.arange(to[-1])
    out = np.append(data, np.uint8(32))[source] if to[-1] else np.zeros(0, np.uint8)
    out[to[1:] - 1] = 32
    kept = np.concatenate(([0], np.cumsum(stay)))[words]
    begin, end = to[kept[:-1]], np.maximum(to[kept[1:]] - 1, to[kept[:-1]])
    texts = [out[s:e].tobytes() for s, e in zip(begin, end)]
    return [pa.array(np.diff(words).astype(np.int64)), pa.array(np.diff(removed).astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())]
