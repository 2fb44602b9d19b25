"""Operator 2: bytes of repeated 400-byte strings, by suffix arrays built with two-stage sorting.

Candidate pieces (see ``repeats``) are joined in shards. In a shard only the suffixes smaller than their successor are
sorted directly; one scan over the buckets of first bytes puts all others in order. Adjacent common prefixes of at least the
wanted length then give the strings that occur twice or more. Prefixes count up to that length only, so ties beyond it stay in any order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dictalog.llm import batches as B
from dictalog.llm.repeats import Repeats, covered, without_repeats

LENGTH = 400
#: Ends a piece. No UTF-8 text has this byte.
END = 255


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Suffixes of ``text`` ordered by their first ``depth`` bytes."""
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int16), append=-1))
    known = np.where(step != 0, np.arange(n), n - 1)
    smaller = step[np.minimum.accumulate(known[::-1])[::-1]] > 0  # than the next suffix

    direct = np.flatnonzero(smaller).tolist()
    direct.sort(key=lambda i: text[i : i + depth])
    direct = np.array(direct, np.int64)
    bounds = np.searchsorted(t[direct], np.arange(257))

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([n - 1], np.int64))  # the last suffix follows the empty one
    out = []
    for c in range(256):
        ordered = list(waiting[c])
        new = np.concatenate(ordered) if ordered else np.zeros(0, np.int64)
        while len(new):  # the same byte before: same bucket, in the same order
            new = new[new > 0] - 1
            new = new[t[new] == c]
            ordered.append(new)
        ordered.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(ordered)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        if len(before):
            first = t[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cut = np.flatnonzero(np.diff(first)) + 1
            for part, at in zip(np.split(before, cut), np.concatenate(([0], cut))):
                waiting[first[at]].append(part)
    return np.concatenate(out)


def common_prefixes(text: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the next in order, at most ``most``."""
    padded = np.frombuffer(text + bytes(most + 8), np.uint8)
    words = np.lib.stride_tricks.as_strided(padded, (len(text) + most, 8), (1, 1))
    words = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
    a, b = order[:-1], order[1:]
    out = np.full(len(a), most, np.int64)
    act = np.arange(len(a))
    for d in range(0, most, 8):
        differ = words[a[act] + d] ^ words[b[act] + d]
        hit = differ != 0
        if hit.any():
            bits = np.frexp(_high(differ[hit]))[1]
            out[act[hit]] = np.minimum(most, d + (64 - bits) // 8)
            act = act[~hit]
        if not len(act):
            break
    return out


def _high(x: np.ndarray) -> np.ndarray:
    """The highest set bit alone, as a float (exact)."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(s))
    return (x ^ (x >> np.uint64(1))).astype(np.float64)


def judge(pieces: list[np.ndarray], times: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, which of its windows stand twice or more in the pieces (each counted ``times`` times)."""
    sizes = np.array([len(p) for p in pieces])
    text = b"".join(p.tobytes() + bytes([END]) for p in pieces)
    order = suffix_array(text, length)
    group = np.concatenate(([0], np.cumsum(common_prefixes(text, order, length) < length)))
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    whole = (begin[piece] + sizes[piece]) - np.arange(len(text)) >= length  # the window ends within its piece
    weight = np.where(whole, times[piece], 0)[order]
    often = np.bincount(group, weight)[group] >= 2
    marked = np.zeros(len(text), bool)
    marked[order] = often
    marked &= whole
    return [marked[b : b + max(0, s - length + 1)] for b, s in zip(begin[:-1], sizes)]


def byte_repeats(length: int = LENGTH, gram: int = 64, block: int = 400_000, heavy: int = 4_000_000) -> Repeats:
    return Repeats(length, gram, B.text_bytes, lambda units: B.BYTE_VALUES[units], judge, np.uint8, block, heavy)


def remove_repeats(docs: DataFrame, how: Repeats | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the bytes of repeated strings taken out.

    Puts n_bytes, n_removed, n_spans (maximal removed runs), spans (start, end in bytes) and kept (binary: a cut may fall
    inside a character) in place of the text. All other columns stay; columns of these names are replaced. Null text counts as empty. Rows are told apart by
    position, so repeated rows and ids are repeats of each other. ``docs`` must be a table scan or another plan that reads the same each time.
    """
    return without_repeats(docs, how or byte_repeats(), _cut, {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "spans": "array<struct<start:long,end:long>>", "kept": "binary"}, text)


def _cut(b: pa.RecordBatch, how: Repeats) -> list[pa.Array]:
    data, off = B.text_bytes(b.column("text"))
    gone = covered(b, off, how.length)
    removed, spans, kept = [], [], []
    for s, e in zip(off[:-1], off[1:]):
        g = gone[s:e]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0])))) if g.any() else np.zeros(0, np.int64)
        removed.append(int(g.sum()))
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
        kept.append((data[s:e][~g] if len(edge) else data[s:e]).tobytes())
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    counts = [pa.array(x, pa.int64()) for x in (np.diff(off), removed, [len(x) for x in spans])]
    return [*counts, pa.array(spans, pairs), pa.array(kept, pa.binary())]
