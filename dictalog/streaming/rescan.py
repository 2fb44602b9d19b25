"""The audio of a remote draft, taken again from the stream: a ring of the last seconds, replayed when the draft starts.

``rescan_audio`` gives each draft its chunks, ``rescan_drafts`` hears them with another transcriber and cuts the texts into drafts again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dictalog.functions.fuzzy import Pattern
from dictalog.streaming.audio import stream_batches
from dictalog.streaming.hearing import texts_of_stream
from dictalog.streaming.ordered import InOrder, samples_of
from dictalog.streaming.segmenter import stream_drafts

KEY = "source_id"
AUDIO = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("draft_id", T.StringType()),
        T.StructField("kind", T.StringType()),  # replay, live, end
        T.StructField("ts_us", T.LongType()),
        T.StructField("chunk_id", T.LongType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("data", T.ArrayType(T.FloatType())),
    ]
)
#: Order among rows of one time: a draft starts, its chunk comes, a draft ends.
START, CHUNK, END = 0, 1, 2


class RescanAudio(InOrder):
    """Chunks go to the ring, or to the open draft. A start hands on the held chunks from the draft's audio start and empties the ring."""

    fields = ("draft_id", "audio_start_us", "sample_rate", "data")
    output, fresh = AUDIO, {"open": None}

    def __init__(self, reach_us: int):
        self.reach_us = reach_us

    def step(self, memory, row, ring):
        ts, prio, chunk, (draft, audio_start, rate, data) = row
        if prio == START:
            out = self._closed(memory, ts)
            low = max(ts - self.reach_us, audio_start if audio_start is not None else ts)
            for at, _, ident, (_, _, own_rate, own) in ring.between(low, ts):
                out.append((draft, "replay", at, ident, own_rate, samples_of(own)))
            ring.clear()
            memory["open"] = draft
            return out
        if prio == CHUNK:
            if memory["open"] is not None:
                return [(memory["open"], "live", ts, chunk, rate, samples_of(data))]
            ring.add(row)
            return []
        return self._closed(memory, ts) if memory["open"] == draft else []

    @staticmethod
    def _closed(memory, ts):
        if memory["open"] is None:
            return []
        draft, memory["open"] = memory["open"], None
        return [(draft, "end", ts, None, None, None)]


def rescan_events(chunks: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """The three kinds of rows as one stream: ``chunks(source_id, ts_us, chunk_id, sample_rate, data)``, ``starts(source_id, ts_us, draft_id,
    audio_start_us)``, ``ends(source_id, ts_us, draft_id)``."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    no_audio = [null("int", "sample_rate"), null("array<float>", "data")]
    a = chunks.select(KEY, "ts_us", F.lit(CHUNK).alias("prio"), F.col("chunk_id").alias("ident"), null("string", "draft_id"), null("long", "audio_start_us"), F.col("sample_rate").cast("int").alias("sample_rate"), F.col("data").cast("array<float>").alias("data"))
    b = starts.select(KEY, "ts_us", F.lit(START).alias("prio"), null("long", "ident"), "draft_id", "audio_start_us", *no_audio)
    c = ends.select(KEY, "ts_us", F.lit(END).alias("prio"), null("long", "ident"), "draft_id", null("long", "audio_start_us"), *no_audio)
    return a.unionByName(b).unionByName(c)


def rescan_audio(events: DataFrame, reach_us: int = 30_000_000) -> DataFrame:
    """Chunks of each remote draft: those held from its audio start on, ``reach_us`` before the start event at most, then all until its end.

    ``events`` as ``rescan_events`` gives them, with a watermark. A draft that starts while another is open ends that one. A held chunk is replayed
    once; chunks before the draft's audio start are forgotten with the rest. kind ``end`` is a row without a chunk.
    """
    return events.groupBy(KEY).transformWithStateInPandas(
        statefulProcessor=RescanAudio(reach_us), outputStructType=AUDIO, outputMode="Append", timeMode="EventTime"
    )


def rescan_drafts(
    events: DataFrame, make: Callable, patterns: list[Pattern] | None = None, reach_us: int = 30_000_000, batch_samples: int = 240_000
) -> DataFrame:
    """Draft events of the rescans, source_id being the remote draft: its audio in long batches through the transcriber, cut into
    drafts again in the same query. A draft still open at the remote end is forced to end."""
    audio = rescan_audio(events, reach_us)
    spoken = audio.select(F.col("draft_id").alias(KEY), F.lit(1).cast("long").alias("speech_no"), "ts_us", "sample_rate", "data")
    texts = texts_of_stream(stream_batches(spoken, batch_samples), make).drop("speech_no", "batch_no")
    return stream_drafts(texts, patterns)
