"""Arrow batches of texts as numpy arrays: units (bytes or words) with document offsets, rolling hashes, sliding minima."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the two rolling hashes (arithmetic is modulo 2**64).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Text bytes handled at once within a batch.
SLICE_BYTES = 750_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective bit mixer on 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: What a byte adds to a rolling hash.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, U64(b))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


POWERS = tuple(_Powers(b) for b in BASES)


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, by prefix sums."""

    def __init__(self, values: np.ndarray, which: int = 0):
        up, self.down = POWERS[which].to(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of [start, end), equal for equal stretches wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all stretches of length k."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in two passes over blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, U64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets between them; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has about ``most`` text bytes (a longer text comes alone). What Arrow has freed goes back after each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(text_lengths(batch.column(text)))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
        give_back()


#: Ways to forget what a worker remembers over tasks, with the time of its last use.
REMEMBERED: dict[Callable[[], None], float] = {}
#: Seconds after which it is forgotten by the next step that runs in the worker.
FORGET_S = 20


def give_back() -> None:
    """Hands memory that Arrow's pool keeps but no longer uses back to the system, and what other steps remembered in this worker and have not used for a while:
    Python workers live on between tasks, beside the executor's heap."""
    for forget, used in list(REMEMBERED.items()):
        if time.monotonic() - used > FORGET_S:
            del REMEMBERED[forget]
            forget()
            gc.collect()  # it may hold cycles
    pa.default_memory_pool().release_unused()


def text_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the word offsets of the documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    return Rolling(BYTE_VALUES[data]).of(starts, ends)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def doc_of_unit(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
