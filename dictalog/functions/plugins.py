"""Places where a user's model is plugged in. Each factory runs once per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _more(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType(df.schema.fields + [T.StructField(name, kind)])


def transcribe(
    batches: DataFrame, make: Callable[[], Callable[[np.ndarray, int, str], list[str]]], prompt: str = ""
) -> DataFrame:
    """Add ``segments ARRAY<STRING>``: what the user's ``f(samples, rate, prompt)`` hears in each batch (null where there are no samples).

    ``prompt`` is for words that the transcriber is to be primed with.
    """

    def run(frames: Iterator) -> Iterator:
        hear = make()
        for pdf in frames:
            pdf["segments"] = [None if s is None else list(hear(np.asarray(s), int(r), prompt)) for s, r in zip(pdf["samples"], pdf["sample_rate"])]
            yield pdf

    return batches.mapInPandas(run, _more(batches, "segments", T.ArrayType(T.StringType())))


def score_speech(chunks: DataFrame, make: Callable[[], Callable[[np.ndarray, int], float]] | None = None) -> DataFrame:
    """Add ``speech_score`` with the user's scorer, or the RMS energy on the JVM side if none is given."""
    if make is None:
        from dictalog.functions.samples import rms_energy

        return chunks.withColumn("speech_score", rms_energy(F.col("data")))

    def run(frames: Iterator) -> Iterator:
        score = make()
        for pdf in frames:
            pdf["speech_score"] = [float(score(np.asarray(d), int(r))) for d, r in zip(pdf["data"], pdf["sample_rate"])]
            yield pdf

    return chunks.mapInPandas(run, _more(chunks, "speech_score", T.DoubleType()))


#: So many prompts are Python objects at a time.
PROMPTS = 64


def edit_drafts(prompts: DataFrame, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Add ``reply``: the user's editing model on each ``prompt``. The other columns stay as Arrow holds them, so memory doesn't grow with the prompts' lengths."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        call = make()
        for batch in batches:
            for at in range(0, batch.num_rows, PROMPTS):
                few = batch.slice(at, PROMPTS)
                reply = pa.array([call(p.as_py()) for p in few.column("prompt")], pa.string())
                yield pa.RecordBatch.from_arrays([*few.columns, reply], [*few.schema.names, "reply"])

    return prompts.mapInArrow(run, _more(prompts, "reply", T.StringType()))
