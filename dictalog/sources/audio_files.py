"""WAV files as chunk rows, and chunk rows as WAV bytes."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictalog import schema
from dictalog.functions.samples import resample_block

# Full scale of the supported sample widths.
FULL_SCALE = {2: ("<i2", 32767.0), 4: ("<i4", 2147483647.0)}


def decode_pcm(raw: bytes, width: int) -> np.ndarray:
    """Samples as float32 in [-1, 1]."""
    if width not in FULL_SCALE:
        raise ValueError(f"samples of {width} bytes cannot be read")
    kind, scale = FULL_SCALE[width]
    return (np.frombuffer(raw, dtype=kind).astype(np.float64) / scale).astype(np.float32)


def encode_wav(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """16-bit WAV bytes of interleaved float samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.asarray(samples) * np.float32(32767.0)).astype("<i2").tobytes())
    return out.getvalue()


def read_audio_corpus(
    spark: SparkSession, path: str, chunk_sec: float = 0.03, start_time: float = 0.0, glob: str = "*.wav"
) -> DataFrame:
    """Audio events of a folder of WAV files, see ``decode_audio``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return decode_audio(files, chunk_sec, start_time)


def decode_audio(files: DataFrame, chunk_sec: float = 0.03, start_time: float = 0.0) -> DataFrame:
    """Start event, fixed-length chunks with running times, stop event per file; an error event if it cannot be read.

    ``files(path, content)``. A file is decoded block by block and its rows leave in batches, so only the file itself has
    to fit into a task. Multi-channel samples are interleaved in ``data``.
    """

    def decode(batches: Iterator) -> Iterator:
        import pandas as pd

        names = schema.AUDIO_ROWS.names
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                for rows in _file_rows(name, content, chunk_sec, start_time):
                    yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(decode, schema.AUDIO_ROWS)


def _file_rows(name: str, content: bytes, chunk_sec: float, start: float, batch: int = 512) -> Iterator[list]:
    def row(cls, no=None, at=start, dur=None, rate=None, ch=None, size=None, data=None, message=None):
        meta = {"file": name} if data is not None else None
        kind = "float32" if size is not None else None
        return (cls, name, no, at, dur, rate, ch, size, kind, data, meta, message)

    try:
        f = wave.open(io.BytesIO(content), "rb")
        if f.getsampwidth() not in FULL_SCALE:
            raise ValueError(f"samples of {f.getsampwidth()} bytes cannot be read")
    except (ValueError, EOFError, wave.Error) as e:
        yield [row("AudioErrorEvent", message=str(e))]
        return
    rate, channels, width = f.getframerate(), f.getnchannels(), f.getsampwidth()
    size = max(1, round(chunk_sec * rate))
    rows = [row("AudioStartEvent", rate=rate, ch=channels, size=size)]
    frames = no = 0
    while raw := f.readframes(size):
        data = decode_pcm(raw, width)
        seconds = (data.size // channels) / rate
        rows.append(row("AudioChunkEvent", no, start + frames / rate, seconds, rate, channels, size, data))
        frames, no = frames + data.size // channels, no + 1
        if len(rows) >= batch:
            yield rows
            rows = []
    rows.append(row("AudioStopEvent", at=start + frames / rate))
    yield rows


#: Where a file's samples lie. ``error`` is set where they cannot be read.
HEADER = "path string, rate int, channels int, width int, offset long, frames long, error string"


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def wav_header(read: Callable[[int, int], bytes], length: int) -> tuple[int, int, int, int, int]:
    """(rate, channels, width, offset, frames) of a WAV file of ``length`` bytes, of which ``read(offset, n)`` gives parts: its blocks are walked through to the
    samples, which are not read."""
    head = read(0, 12)
    if len(head) < 12:
        raise EOFError("the file is too short")
    if head[:4] != b"RIFF":
        raise wave.Error("file does not start with RIFF id")
    if head[8:12] != b"WAVE":
        raise wave.Error("not a WAVE file")
    at, shape = 12, None
    while at + 8 <= length:
        block = read(at, 8)
        size = int.from_bytes(block[4:8], "little")
        if block[:4] == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHLLHH", read(at + 8, 16))
            if kind not in (1, 0xFFFE):
                raise wave.Error(f"unknown format: {kind!r}")
            shape = rate, channels, (bits + 7) // 8
            if shape[2] not in FULL_SCALE:
                raise ValueError(f"samples of {shape[2]} bytes cannot be read")
        elif block[:4] == b"data":
            if shape is None:
                raise wave.Error("data chunk before fmt chunk")
            return *shape, at + 8, min(size, length - at - 8) // (shape[1] * shape[2])
        at += 8 + size + size % 2
    raise wave.Error("fmt chunk and/or data chunk missing")


def read_long_audio(
    spark: SparkSession, path: str, chunk_sec: float = 0.03, start_time: float = 0.0, glob: str = "*.wav", part_sec: float = 600.0
) -> DataFrame:
    """The rows of ``read_audio_corpus``, a file in as many tasks as it has parts of ``part_sec``.

    Headers are read first (a few bytes of each file); then every part reads its own range of the file's samples. Paths are those of pyarrow's file systems.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")

    def headers(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, length in zip(pdf["path"], pdf["length"]):
                system, inner = _file_system(name)
                with system.open_input_file(inner) as f:
                    try:
                        rows.append((name, *wav_header(lambda at, n, f=f: f.read_at(n, at), int(length)), None))
                    except (ValueError, EOFError, wave.Error) as e:
                        rows.append((name, None, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER.split(", ")])
            yield out.astype({"rate": "Int32", "channels": "Int32", "width": "Int32", "offset": "Int64", "frames": "Int64"})

    size = F.greatest(F.lit(1), F.round(F.lit(chunk_sec) * F.col("rate")).cast("long"))
    known = files.mapInPandas(headers, HEADER).withColumn("size", size)
    per = F.greatest(F.lit(1), F.floor(F.lit(part_sec) * F.col("rate") / F.col("size")))  # chunks of a part
    last = F.coalesce(F.ceil(F.col("frames") / (per * F.col("size"))), F.lit(1))
    parts = known.withColumns({"per": per, "n_parts": F.greatest(last, F.lit(1))})
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts").cast("long") - 1)))
    cores = spark.sparkContext.defaultParallelism
    return parts.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "part").mapInPandas(_read_parts(start_time), schema.AUDIO_ROWS)


def _read_parts(start: float, batch: int = 512):
    def rows_of(p) -> Iterator[list]:
        if p.error is not None:
            yield [("AudioErrorEvent", None, None, start, None, None, None, None, None, None, None, p.error)]
            return
        rate, channels, width, size, frames = int(p.rate), int(p.channels), int(p.width), int(p.size), int(p.frames)
        first = int(p.part) * int(p.per)
        rows = []
        if p.part == 0:
            rows.append(("AudioStartEvent", p.path, None, start, None, rate, channels, size, "float32", None, None, None))
        system, inner = _file_system(p.path)
        with system.open_input_file(inner) as f:
            for no in range(first, min(first + int(p.per), -(-frames // size))):
                n = min(size, frames - no * size)
                data = decode_pcm(f.read_at(n * channels * width, int(p.offset) + no * size * channels * width), width)
                rows.append(("AudioChunkEvent", p.path, no, start + no * size / rate, n / rate, rate, channels, size, "float32", data, {"file": p.path}, None))
                if len(rows) >= batch:
                    yield rows
                    rows = []
        if p.part == p.n_parts - 1:
            rows.append(("AudioStopEvent", p.path, None, start + frames / rate, None, None, None, None, None, None, None, None))
        yield rows

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for p in pdf.itertuples(index=False):
                for rows in rows_of(p):
                    frame = pd.DataFrame(rows, columns=schema.AUDIO_ROWS.names)
                    yield frame.astype({"chunk_no": "Int64", "sample_rate": "Int32", "channels": "Int32", "blocksize": "Int32"})

    return run


def resample(chunks: DataFrame, target: int) -> DataFrame:
    """Chunks at the target rate, with new block size and duration. Chunks are filtered one by one."""

    def convert(batches: Iterator) -> Iterator:
        for pdf in batches:
            blocks = [resample_block(np.asarray(d), int(r), target) for d, r in zip(pdf["data"], pdf["sample_rate"])]
            pdf["data"] = blocks
            pdf["blocksize"] = [b.size for b in blocks]
            pdf["duration"] = [b.size / target for b in blocks]
            pdf["sample_rate"] = target
            yield pdf

    shaped = chunks.withColumns({"blocksize": F.size("data"), "duration": F.size("data") / F.col("sample_rate")})
    return shaped.mapInPandas(convert, shaped.schema)


def to_wav(clips: DataFrame, key: list[str], data: str = "data") -> DataFrame:
    """Clip rows with their samples as WAV bytes (column ``wav``)."""
    from pyspark.sql import types as T

    shape = T.StructType([clips.schema[k] for k in key] + [T.StructField("wav", T.BinaryType())])

    def encode(batches: Iterator) -> Iterator:
        for pdf in batches:
            pdf["wav"] = [encode_wav(d, int(r)) for d, r in zip(pdf[data], pdf["sample_rate"])]
            yield pdf[[*key, "wav"]]

    return clips.select(*key, data, "sample_rate").mapInPandas(encode, shape)
