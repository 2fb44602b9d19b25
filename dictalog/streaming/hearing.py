"""From sample chunks to stored drafts in one stream: speech, batches, the user's transcriber, boundaries.

Each step is a stateful operator of the same query, keyed by source; the transcriber stands between them. Gives what ``plans.flows`` gives in batch form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dictalog.functions.fuzzy import Pattern
from dictalog.functions.plugins import transcribe
from dictalog.operators.matching import has_text
from dictalog.streaming.audio import stream_batches
from dictalog.streaming.ordered import InOrder, samples_of
from dictalog.streaming.segmenter import stream_drafts

KEY = "source_id"
TAGGED = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("kind", T.StringType()),  # chunk, replay, start, stop, flush
        T.StructField("ts_us", T.LongType()),
        T.StructField("chunk_id", T.LongType()),
        T.StructField("speech_no", T.LongType()),
        T.StructField("in_speech", T.BooleanType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("data", T.ArrayType(T.FloatType())),
    ]
)


class SpeechTagger(InOrder):
    """Speech starts and stops of a source, its chunks with their speech state, and the quiet chunks replayed at each start."""

    fields = ("speech_score", "sample_rate", "data")
    output, fresh = TAGGED, {"last": None, "no": 0, "on": False}

    def __init__(self, threshold: float, silence_us: int, reach_us: int):
        self.threshold, self.silence_us, self.reach_us = threshold, silence_us, reach_us

    def step(self, memory, row, ring):
        ts, _, chunk, (score, rate, data) = row
        out = []
        if memory["on"] and ts - memory["last"] > self.silence_us:
            memory["on"] = False
            out.append(("stop", memory["last"] + self.silence_us + 1, None, memory["no"], False, None, None))
        if chunk is None:  # a row without a chunk: its source has ended
            return [*out, ("flush", ts, None, memory["no"], False, None, None)]
        if score is not None and score >= self.threshold:
            if not memory["on"]:
                memory.update(on=True, no=memory["no"] + 1)
                out.append(("start", ts, None, memory["no"], True, None, None))
                for at, _, ident, (_, own_rate, own) in ring.between(ts - self.reach_us, ts - 1):
                    out.append(("replay", at, ident, memory["no"], False, own_rate, samples_of(own)))
                ring.clear()
            memory["last"] = ts
        elif not memory["on"]:
            ring.add(row)
        return [*out, ("chunk", ts, chunk, memory["no"], memory["on"], rate, samples_of(data))]


def tag_speech(chunks: DataFrame, threshold: float = 0.5, silence_us: int = 800_000, reach_us: int = 1_000_000) -> DataFrame:
    """Chunks and speech events of a stream, source by source in order of time, once the watermark has passed them.

    ``chunks(source_id, ts, ts_us, chunk_id, speech_score, sample_rate, data)``, ``ts`` with a watermark; a row with a null chunk_id ends its source.
    kind ``chunk`` is every chunk once; ``replay`` a quiet chunk of the last ``reach_us`` before a start, again; ``start``, ``stop`` and ``flush`` are events.
    """
    rows = chunks.select(KEY, "ts", "ts_us", F.lit(1).alias("prio"), F.col("chunk_id").alias("ident"), "speech_score", "sample_rate", "data")
    return rows.groupBy(KEY).transformWithStateInPandas(
        statefulProcessor=SpeechTagger(threshold, silence_us, reach_us), outputStructType=TAGGED, outputMode="Append", timeMode="EventTime"
    )


def spoken_chunks(tagged: DataFrame) -> DataFrame:
    """What the transcriber is to hear: chunks in speech, those replayed before it, and the end of a source (null data)."""
    return tagged.filter(((F.col("kind") == "chunk") & F.col("in_speech")) | F.col("kind").isin("replay", "flush"))


def texts_of_stream(batches: DataFrame, make: Callable, min_seconds: float = 0.03, prompt: str = "") -> DataFrame:
    """Text events of a stream of batches: what the user's transcriber hears in each that is long enough, segments joined. The end of a
    source is a row with a null text."""
    ends = F.col("n_samples") == 0
    long_enough = batches.filter(ends | (F.col("n_samples") > F.col("sample_rate") * min_seconds))
    heard = transcribe(long_enough, make, prompt).filter(F.col("segments").isNull() | has_text(F.col("segments")))
    tail = F.when(ends, 0).otherwise(F.col("last_samples") * 1_000_000 / F.col("sample_rate"))
    return heard.select(
        KEY,
        "speech_no",
        "batch_no",
        F.coalesce("first_us", F.col("last_us") + 1).alias("seq"),
        F.trim(F.regexp_replace(F.array_join("segments", " "), r"\s+", " ")).alias("text"),
        (F.coalesce("first_us", "last_us") / 1e6).alias("audio_start_time"),
        ((F.col("last_us") + tail) / 1e6).alias("audio_end_time"),
    )


def stream_texts(
    chunks: DataFrame,
    make: Callable,
    threshold: float = 0.5,
    silence_us: int = 800_000,
    batch_samples: int = 80_000,
    prebuffer_us: int = 1_000_000,
    prompt: str = "",
) -> DataFrame:
    """Text events of a chunk stream (see ``tag_speech``). The end of a source gives a row with a null text."""
    spoken = spoken_chunks(tag_speech(chunks, threshold, silence_us, prebuffer_us))
    return texts_of_stream(stream_batches(spoken, batch_samples), make, prompt=prompt)


def stream_audio_to_drafts(chunks: DataFrame, make: Callable, patterns: list[Pattern] | None = None, **hearing) -> DataFrame:
    """Draft events of a chunk stream: three stateful operators and the transcriber in one query."""
    texts = stream_texts(chunks, make, **hearing).drop("speech_no", "batch_no")
    return stream_drafts(texts, patterns)


def tapped(chunks: DataFrame, threshold: float = 0.5, silence_us: int = 800_000) -> DataFrame:
    """One source stream at its three taps, as rows for ``live.Taps``: ``raw`` the chunks as they come, ``vad`` the speech events, ``merged`` both
    the events and the chunks with their speech state, in order of time."""
    columns = [KEY, "ts_us", "chunk_id", "data"]
    raw = chunks.filter(F.col("chunk_id").isNotNull()).select(
        F.lit("AudioChunkEvent").alias("event_class"), F.lit("raw").alias("tap"), *columns, F.lit(None).cast("boolean").alias("in_speech")
    )
    heard = tag_speech(chunks, threshold, silence_us, 0).filter(F.col("kind").isin("chunk", "start", "stop"))
    taps = F.when(F.col("kind") == "chunk", F.array(F.lit("merged"))).otherwise(F.array(F.lit("vad"), F.lit("merged")))
    named = F.when(F.col("kind") == "start", "AudioSpeechStartEvent").when(F.col("kind") == "stop", "AudioSpeechStopEvent").otherwise("AudioChunkEvent")
    return raw.unionByName(heard.select(named.alias("event_class"), F.explode(taps).alias("tap"), *columns, "in_speech"))
