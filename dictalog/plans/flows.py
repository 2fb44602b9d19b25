"""The long ways through the engine: audio to stored drafts, and drafts to better revisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictalog.functions.fuzzy import Pattern
from dictalog.functions.plugins import transcribe
from dictalog.operators import speech as A
from dictalog.operators.matching import assemble_text, drop_blank_audio
from dictalog.operators.segmenter import build_drafts, draft_id
from dictalog.operators.slices import KeySlices, plan_slices
from dictalog.sources.sinks import whole_drafts
from dictalog.session import materialize

KEY = "source_id"


def with_prebuffer(tagged: DataFrame, segments: DataFrame, reach_us: int = 1_000_000) -> DataFrame:
    """Let each speech segment begin with the silent chunks just before it. A silent chunk goes to the next start."""
    early = (
        A.prebuffered(tagged, segments, reach_us)
        .groupBy(KEY, "chunk_id")
        .agg(F.min("into_speech_no").alias("_into"))
    )
    joined = tagged.join(early, [KEY, "chunk_id"], "left").withColumns(
        {
            "in_speech": F.col("in_speech") | F.col("_into").isNotNull(),
            "speech_no": F.coalesce("_into", "speech_no"),
        }
    )
    firsts = joined.filter("in_speech").groupBy(KEY, "speech_no").agg(F.min("chunk_id").alias("_first"))
    started = joined.drop("_into", "speech_start").join(firsts, [KEY, "speech_no"], "left")
    return started.withColumn("speech_start", F.coalesce(F.col("chunk_id") == F.col("_first"), F.lit(False))).drop("_first")


def texts_of_batches(batched: DataFrame, make: Callable, by: list[str]) -> DataFrame:
    """Text events of transcription batches, in the order of their audio. The end time covers the last chunk."""
    audio = A.batch_audio(batched)
    heard = drop_blank_audio(transcribe(audio, make))
    rows = heard.select(*by, "first_us", "last_us", F.posexplode("segments").alias("_pos", "text"))
    texts = assemble_text(rows, [*by, "first_us", "last_us"], "_pos")
    length = batched.groupBy(*by).agg(F.max_by(F.col("n_samples") * 1_000_000 / F.col("sample_rate"), "ts_us").alias("_tail"))
    return texts.join(length, by).select(
        KEY,
        F.col("first_us").alias("seq"),
        "text",
        (F.col("first_us") / 1e6).alias("audio_start_time"),
        ((F.col("last_us") + F.col("_tail")) / 1e6).alias("audio_end_time"),
    )


def audio_to_texts(
    chunks: DataFrame,
    make: Callable,
    threshold: float = 0.5,
    silence_us: int = 800_000,
    pad_us: int = 1_500_000,
    batch_samples: int = 80_000,
    prebuffer_us: int = 1_000_000,
) -> DataFrame:
    """Scored chunks to text events: speech segments with their pre-buffer, batches, transcription."""
    slices = plan_slices(chunks, KEY, "chunk_id")
    tagged = A.speech_segments_of_chunks(chunks, slices, threshold, silence_us)
    fuller = with_prebuffer(tagged, A.speech_segments(tagged, pad_us, silence_us), prebuffer_us)
    batched = A.sample_batches(fuller, slices, batch_samples)
    return texts_of_batches(batched, make, [KEY, "speech_no", "batch_no"])


def audio_to_drafts(chunks: DataFrame, make: Callable, patterns: list[Pattern] | None = None, **speech) -> DataFrame:
    """Scored chunks to drafts. Texts are written once: the model must not run twice."""
    texts = materialize(audio_to_texts(chunks, make, **speech), "texts")
    return build_drafts(texts, plan_slices(texts, KEY, "seq"), "seq", patterns)


def rescan(
    drafts: DataFrame,
    chunks: DataFrame,
    make: Callable,
    patterns: list[Pattern] | None = None,
    batch_samples: int = 240_000,
    bin_us: int = 30_000_000,
) -> DataFrame:
    """Revisions of drafts by another transcriber: the draft's chunks in long batches, cut into drafts again.

    ``drafts(source_id, draft_id, start_us, stop_us)``. A draft whose audio gives no boundary has no revision. Every draft
    is its own source here, so long recordings are spread.
    """
    own = A.draft_audio_range(chunks, drafts, bin_us).select(
        F.col("draft_id").alias(KEY), "chunk_id", "ts_us", "n_samples", "sample_rate", "data", F.lit(True).alias("in_speech")
    )
    firsts = own.groupBy(KEY).agg(F.min("chunk_id").alias("_first"))
    started = own.join(firsts, KEY).withColumns(
        {"speech_start": F.col("chunk_id") == F.col("_first"), "speech_no": F.lit(1).cast("long")}
    )
    batched = A.sample_batches(started.drop("_first"), KeySlices(KEY, "chunk_id"), batch_samples)
    texts = materialize(texts_of_batches(batched, make, [KEY, "speech_no", "batch_no"]), "rescanned")
    again = build_drafts(texts, plan_slices(texts, KEY, "seq"), "seq", patterns)
    again = whole_drafts(again, [KEY, "opened_at"])
    newest = F.max_by(
        F.struct("start_text", "end_text", "full_text", "audio_start_time", "audio_end_time", "forced", "opened_at"), "opened_at"
    )
    return (
        again.groupBy(KEY)
        .agg(newest.alias("d"))
        .select(
            draft_id(F.concat(F.col(KEY), F.lit("/rescan")), F.col("d.opened_at")).alias("draft_id"),
            F.col(KEY).alias("parent_draft_id"),
            F.col("d.audio_start_time").alias("timestamp"),
            "d.start_text",
            "d.end_text",
            "d.full_text",
            "d.audio_start_time",
            "d.audio_end_time",
            "d.forced",
        )
    )
