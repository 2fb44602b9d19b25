"""Speech segments, transcription batches, recordings and clips over chunk tables.

Chunk tables have ``source_id``, an order column, ``ts_us``, ``n_samples``, ``sample_rate`` and ``data``. Operators that
only need times never touch ``data``, so it is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictalog.functions.samples import pcm16_encode, silence
from dictalog.operators.ranges import lookback, plan_bins, planned_range_join, range_join
from dictalog.operators.slices import KeySlices, neighbour, running, union_all

KEY = "source_id"


def time_cursor(chunks: DataFrame, slices: KeySlices, start_us: Column, order: str = "chunk_id") -> DataFrame:
    """Chunk time from the stream start and the durations of the chunks before it."""
    own = (F.col("n_samples").cast("long") * 1_000_000 / F.col("sample_rate")).cast("long")
    got = running(chunks, slices, [order], sums={"_before": own}, inclusive=False)
    return got.withColumn("cursor_us", start_us + F.col("_before")).drop("_before")


def speech_segments_of_chunks(
    chunks: DataFrame, slices: KeySlices, threshold: float = 0.5, silence_us: int = 800_000, order: str = "chunk_id"
) -> DataFrame:
    """Add ``is_speech``, ``in_speech`` and ``speech_no`` to every chunk.

    Speech starts at a chunk with a score at or above the threshold and lasts until more than ``silence_us`` pass
    without another such chunk. ``speech_no`` counts the starts so far (0 before the first).
    """
    is_speech = F.col("speech_score") >= threshold
    heard = running(
        chunks.withColumn("is_speech", is_speech),
        slices,
        [order],
        lasts={"_prev": F.when(F.col("is_speech"), F.col("ts_us"))},
        inclusive=False,
    )
    fresh = F.col("_prev").isNull() | (F.col("ts_us") - F.col("_prev") > silence_us)
    last = F.when(F.col("is_speech"), F.col("ts_us")).otherwise(F.col("_prev"))
    flagged = heard.withColumns(
        {
            "speech_start": (F.col("is_speech") & fresh),
            "in_speech": F.coalesce(F.col("ts_us") - last <= silence_us, F.lit(False)),
        }
    ).drop("_prev")
    return running(flagged, slices, [order], sums={"speech_no": F.col("speech_start").cast("long")})


def speech_segments(tagged: DataFrame, pad_us: int = 1_500_000, silence_us: int = 800_000) -> DataFrame:
    """One row per speech segment. ``end_us`` is the last speech chunk minus the pad; ``forced`` marks a segment that
    was still open when the stream ended."""
    stream_end = tagged.groupBy(KEY).agg(F.max("ts_us").alias("_stream_end"))
    segs = (
        tagged.filter("is_speech")
        .groupBy(KEY, "speech_no")
        .agg(
            F.min("ts_us").alias("start_us"),
            F.max("ts_us").alias("last_speech_us"),
            F.count(F.lit(1)).alias("n_speech_chunks"),
        )
    )
    return (
        segs.join(stream_end, KEY)
        .withColumns(
            {
                "end_us": F.col("last_speech_us") - pad_us,
                "forced": F.col("_stream_end") - F.col("last_speech_us") <= silence_us,
            }
        )
        .drop("_stream_end")
    )


def vad_events(segments: DataFrame, silence_us: int = 800_000) -> DataFrame:
    """Speech start and stop events of the segments, stops at the end of the silence."""
    kinds = F.array(
        F.struct(F.lit("AudioSpeechStartEvent").alias("event_class"), F.col("start_us").alias("ts_us")),
        F.struct(
            F.lit("AudioSpeechStopEvent").alias("event_class"),
            (F.col("last_speech_us") + silence_us + 1).alias("ts_us"),
        ),
    )
    return segments.select(KEY, "speech_no", "end_us", F.inline(kinds))


def speech_gate(tagged: DataFrame) -> DataFrame:
    return tagged.filter("in_speech")


def merge_vad(
    chunks: DataFrame, vad: DataFrame, slices: KeySlices, time: str, keep: list[str]
) -> DataFrame:
    """As-of merge: each chunk gets the state of the latest speech event at or before it.

    One union and one running pass per source; at equal times the speech event comes first.
    """
    state = F.when(F.col("event_class") == "AudioSpeechStartEvent", True).when(
        F.col("event_class") == "AudioSpeechStopEvent", False
    )
    marks = vad.select(KEY, time, state.alias("_state"), F.lit(0).alias("_prio"))
    rows = chunks.select(KEY, time, *keep, F.lit(1).alias("_prio"))
    both = union_all([rows, marks])
    merged = running(both, slices, [time, "_prio"], lasts={"_vad": F.col("_state")})
    return merged.filter(F.col("_prio") == 1).select(
        KEY, time, *keep, F.coalesce("_vad", F.lit(False)).alias("in_speech")
    )


def prebuffered(tagged: DataFrame, segments: DataFrame, reach_us: int = 1_000_000) -> DataFrame:
    """Silent chunks of the last ``reach_us`` before each speech start, with the segment they lead into."""
    quiet = tagged.filter(~F.col("in_speech")).select(KEY, "chunk_id", "ts_us", "n_samples")
    marks = segments.select(KEY, F.col("speech_no").alias("into_speech_no"), F.col("start_us").alias("mark_us"))
    return lookback(quiet, marks, KEY, "ts_us", "mark_us", reach_us)


def sample_batches(
    tagged: DataFrame, slices: KeySlices, batch_samples: int = 80_000, order: str = "chunk_id"
) -> DataFrame:
    """Number the transcription batch of every speech chunk, from 0 within each speech segment.

    A chunk belongs to the batch in which its first sample falls; nothing is lost at the borders.
    """
    counted = running(
        tagged.filter("in_speech"), slices, [order], sums={"_before": F.col("n_samples").cast("long")}, inclusive=False
    )
    based = running(
        counted, slices, [order], lasts={"_base": F.when(F.col("speech_start"), F.col("_before"))}
    )
    batch = F.floor((F.col("_before") - F.col("_base")) / batch_samples)
    return based.withColumn("batch_no", batch).drop("_before", "_base")


def speech_batches(batched: DataFrame, min_seconds: float = 0.03) -> DataFrame:
    """One row per batch that is long enough to transcribe (more than ``min_seconds`` of samples)."""
    return (
        batched.groupBy(KEY, "speech_no", "batch_no")
        .agg(
            F.min_by("chunk_id", "ts_us").alias("first_chunk"),
            F.max_by("chunk_id", "ts_us").alias("last_chunk"),
            F.sum("n_samples").alias("samples"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.max("sample_rate").alias("sample_rate"),
        )
        .filter(F.col("samples") > F.col("sample_rate") * min_seconds)
    )


def batch_audio(batched: DataFrame, min_seconds: float = 0.03) -> DataFrame:
    """The samples of each batch in order, for the batches of ``speech_batches``. A batch holds ``batch_samples`` at most (plus one chunk)."""
    ordered = F.sort_array(F.collect_list(F.struct("ts_us", "chunk_id", "data")))
    rows = batched.groupBy(KEY, "speech_no", "batch_no").agg(
        F.flatten(F.transform(ordered, lambda c: c["data"])).alias("samples"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.max("sample_rate").alias("sample_rate"),
    )
    return rows.filter(F.size("samples") > F.col("sample_rate") * min_seconds)


def job_metrics(jobs: DataFrame, slices: KeySlices) -> DataFrame:
    """Per job: seconds of sound, processing seconds, and jobs still pending when it finished.

    ``jobs(source_id, job_id, first_us, last_us, issued_us, finished_us, n_segments)``.
    """
    keep = ["job_id", "first_us", "last_us", "issued_us", "finished_us", "n_segments"]
    issued = jobs.select(KEY, F.col("issued_us").alias("at_us"), F.lit(0).alias("_end"), F.lit(1).alias("_d"), "job_id")
    done = jobs.select(
        KEY, F.col("finished_us").alias("at_us"), F.lit(1).alias("_end"), F.lit(-1).alias("_d"), *keep
    )
    flow = running(
        union_all([done, issued]), slices.rekey(KEY, "at_us"), ["at_us", "_end", "job_id"], sums={"pending": F.col("_d")}
    )
    return flow.filter(F.col("_end") == 1).select(
        KEY,
        "job_id",
        ((F.col("last_us") - F.col("first_us")) / 1e6).alias("sound_sec"),
        ((F.col("finished_us") - F.col("issued_us")) / 1e6).alias("work_sec"),
        "n_segments",
        F.col("pending").cast("long").alias("pending"),
    )


def recording_pieces(
    chunks: DataFrame, slices: KeySlices, segment_sec: float = 15.0, order: str = "chunk_id"
) -> DataFrame:
    """Cut chunks at the exact sample borders of fixed-length segments. Adds ``segment_index``, ``piece_from`` (offset in
    the chunk) and ``piece_samples``."""
    need = F.floor(F.lit(segment_sec) * F.col("sample_rate"))
    counted = running(chunks, slices, [order], sums={"_before": F.col("n_samples").cast("long")}, inclusive=False)
    first = F.floor(F.col("_before") / need)
    last = F.floor((F.col("_before") + F.col("n_samples") - 1) / need)
    out = counted.filter(F.col("n_samples") > 0).withColumn("segment_index", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("segment_index") * need - F.col("_before"), F.lit(0))
    hi = F.least((F.col("segment_index") + 1) * need - F.col("_before"), F.col("n_samples"))
    return out.withColumns({"piece_from": lo, "piece_samples": hi - lo}).drop("_before")


def recording_segments(pieces: DataFrame, segment_sec: float = 15.0) -> DataFrame:
    """One side-car row per recording segment."""
    need = F.floor(F.lit(segment_sec) * F.col("sample_rate"))
    return (
        pieces.groupBy(KEY, "segment_index", "sample_rate")
        .agg(F.sum("piece_samples").alias("samples"))
        .select(
            KEY,
            "segment_index",
            "samples",
            F.round(F.col("samples") / F.col("sample_rate"), 6).alias("duration_sec"),
            (F.col("segment_index") * segment_sec).alias("start_offset_sec"),
            (F.col("samples") < need).alias("is_partial"),
        )
    )


def recording_audio(pieces: DataFrame, order: str = "chunk_id") -> DataFrame:
    """The 16-bit samples of each segment; a group holds one segment."""
    part = pcm16_encode(F.slice("data", F.col("piece_from").cast("int") + 1, F.col("piece_samples").cast("int")))
    ordered = F.sort_array(F.collect_list(F.struct(order, part.alias("p"))))
    return pieces.groupBy(KEY, "segment_index").agg(F.flatten(F.transform(ordered, lambda c: c["p"])).alias("pcm"))


def session_manifest(segments: DataFrame) -> DataFrame:
    """Totals per session. The session's segment list is the segment table itself, see ``manifest_rows``."""
    return segments.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total_segments"), F.round(F.sum("duration_sec"), 6).alias("total_duration_sec")
    )


def manifest_rows(segments: DataFrame) -> DataFrame:
    """Every segment with the totals of its session."""
    return segments.join(session_manifest(segments), KEY)


def draft_audio_range(
    chunks: DataFrame, drafts: DataFrame, bin_us: int | None = 30_000_000, spread: int = 1
) -> DataFrame:
    """Chunks of each draft, start and end inclusive. ``drafts(source_id, draft_id, start_us, stop_us)``. Without ``bin_us`` the bins are planned from the data."""
    if bin_us is None:
        bins = plan_bins(chunks, drafts, KEY, "ts_us", F.col("start_us"), F.col("stop_us"))
        return planned_range_join(chunks, drafts, KEY, "ts_us", F.col("start_us"), F.col("stop_us"), bins)
    return range_join(chunks, drafts, KEY, "ts_us", F.col("start_us"), F.col("stop_us"), bin_us, spread=spread)


def rescan_ranges(drafts: DataFrame, slices: KeySlices, reach_us: int = 30_000_000) -> DataFrame:
    """From and to of the audio that a rescan hears: ``_from``, ``_to`` (inclusive).

    ``drafts(source_id, draft_id, start_us, audio_start_us, end_us)``: the times of the start and end events (null: none came) and of the first audio. Audio is
    held ``reach_us`` before the start event at most, from the end of the draft before; a start ends the draft before.
    """
    order = ["start_us", "draft_id"]
    next_ = neighbour(drafts, slices, order, {"_next": F.col("start_us")})
    both = neighbour(next_, slices, order, {"_prev": F.struct("start_us", F.coalesce("end_us", F.lit((1 << 62))).alias("end_us"))}, forward=False)
    fresh = F.when(F.col("_prev.end_us") < F.col("start_us"), F.col("_prev.end_us") + 1).otherwise(F.when(F.col("_prev").isNotNull(), F.col("start_us")))
    low = F.greatest(F.least(F.coalesce("audio_start_us", "start_us"), F.col("start_us")), F.col("start_us") - reach_us, fresh)
    high = F.least(F.col("end_us"), F.col("_next") - 1)
    return both.withColumns({"_from": low, "_to": high}).drop("_next", "_prev")


def rescan_audio_range(chunks: DataFrame, drafts: DataFrame, slices: KeySlices, reach_us: int = 30_000_000, bin_us: int = 30_000_000) -> DataFrame:
    """Chunks that a rescan of each draft hears (``replayed``: held before its start event). A draft without an end hears up to the next start or the last chunk."""
    ranges = rescan_ranges(drafts, slices, reach_us)
    last = chunks.groupBy(KEY).agg(F.max("ts_us").alias("_last"))
    ranges = ranges.join(last, KEY).withColumn("_to", F.coalesce("_to", "_last")).drop("_last")
    pairs = range_join(chunks, ranges, KEY, "ts_us", F.col("_from"), F.col("_to"), bin_us)
    return pairs.withColumn("replayed", F.col("ts_us") < F.col("start_us")).drop("_from", "_to")


def draft_clips(
    chunks: DataFrame,
    drafts: DataFrame,
    lead_us: int = 3_000_000,
    pause_sec: float = 0.4,
    part_us: int = 60_000_000,
    bin_us: int = 30_000_000,
) -> DataFrame:
    """Audio of each draft: a short silence, then the chunks from ``lead_us`` before its start to its end.

    Cut into parts of ``part_us`` so that no group grows with the length of a draft.
    """
    wider = drafts.withColumns({"_from": F.col("start_us") - lead_us, "_to": F.col("stop_us")})
    pairs = range_join(chunks, wider, KEY, "ts_us", F.col("_from"), F.col("_to"), bin_us)
    part = F.floor((F.col("ts_us") - F.col("_from")) / part_us)
    ordered = F.sort_array(F.collect_list(F.struct("ts_us", "chunk_id", "data")))
    clips = (
        pairs.withColumn("part_no", part)
        .groupBy(KEY, "draft_id", "part_no")
        .agg(
            F.flatten(F.transform(ordered, lambda c: c["data"])).alias("_audio"),
            F.max("sample_rate").alias("sample_rate"),
            F.min("part_no").alias("_p"),
        )
    )
    firsts = clips.groupBy("draft_id").agg(F.min("part_no").alias("_first"))
    pause = F.when(F.col("part_no") == F.col("_first"), silence(F.lit(pause_sec), F.col("sample_rate"))).otherwise(
        F.array().cast("array<float>")
    )
    return clips.join(firsts, "draft_id").select(
        KEY, "draft_id", "part_no", "sample_rate", F.concat(pause, F.col("_audio")).alias("data")
    )
