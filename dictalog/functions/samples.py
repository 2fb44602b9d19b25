"""Sample-array column functions (JVM side) and the resampler used inside Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def mix_channels(frames: Column, source: int, target: int) -> Column:
    """Frames are ARRAY<ARRAY<FLOAT>>: many to one averages, one to many repeats, else cut or zero-pad."""
    if source == target:
        return frames
    if target == 1:
        total = lambda f: F.aggregate(f, F.lit(0.0), lambda acc, x: acc + x)
        return F.transform(frames, lambda f: F.array((total(f) / F.lit(float(source))).cast("float")))
    if source == 1:
        return F.transform(frames, lambda f: F.array_repeat(f[0], target))
    if source > target:
        return F.transform(frames, lambda f: F.slice(f, 1, target))
    pad = F.array_repeat(F.lit(0.0).cast("float"), target - source)
    return F.transform(frames, lambda f: F.concat(f, pad))


def silence(seconds: Column, rate: Column) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), F.floor(seconds * rate).cast("int"))


def fit_512(data: Column) -> Column:
    return F.slice(F.concat(data, F.array_repeat(F.lit(0.0).cast("float"), 512)), 1, 512)


def frames_per_chunk(seconds: Column, rate: Column) -> Column:
    """At least 1, rounded half to even."""
    return F.greatest(F.lit(1), F.bround(seconds * rate).cast("int"))


def pcm16_encode(data: Column) -> Column:
    """Signed 16-bit values, truncated towards zero."""
    return F.transform(data, lambda x: (x * F.lit(32767.0).cast("float")).cast("smallint"))


def rms_energy(data: Column) -> Column:
    """Default speech score of a chunk."""
    total = F.aggregate(data, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.when(F.size(data) > 0, F.sqrt(total / F.size(data))).otherwise(F.lit(0.0))


def resample_block(block: np.ndarray, rate: int, target: int, taps: int = 16) -> np.ndarray:
    """Windowed-sinc resampling of one block (Hann window, cut-off at the lower Nyquist frequency)."""
    if rate == target or block.size == 0:
        return block.astype(np.float32)
    n_out = int(block.size * target / rate)
    scale = min(1.0, target / rate)
    at = np.arange(n_out) * (rate / target)
    half = int(np.ceil(taps / scale))
    near = np.floor(at).astype(np.int64)[:, None] + np.arange(-half + 1, half + 1)[None, :]
    gap = at[:, None] - near
    weight = np.sinc(gap * scale) * scale * (0.5 + 0.5 * np.cos(np.pi * np.clip(gap / half, -1, 1)))
    valid = (near >= 0) & (near < block.size)
    weight = np.where(valid, weight, 0.0)
    norm = weight.sum(axis=1)
    got = (block[np.clip(near, 0, block.size - 1)] * weight).sum(axis=1)
    return (got / np.where(np.abs(norm) > 1e-9, norm, 1.0)).astype(np.float32)
