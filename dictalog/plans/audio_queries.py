"""Registered queries on sample chunks and scripted segments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from dictalog.functions import plugins, samples
from dictalog.operators import speech as A
from dictalog.operators.matching import assemble_text, drop_blank_audio
from dictalog.operators.slices import plan_slices
from dictalog.plans import views
from dictalog.plans.registry import query
from dictalog.plans.text_queries import DRAFTS_SQL, persisted
from dictalog.session import shared_dir
from dictalog.sources import audio_files, segment_spec
from dictalog.streaming import audio as SA
from dictalog.streaming import hearing, live, rescan
from dictalog.streaming.runner import run_available, stream_of

SILENCE_US = 64_000
THRESHOLD = 0.5
BATCH = 160
SEGMENT_SEC = 0.25  # 500 samples: not a multiple of the chunk size

# Speech islands of the chunks, shared by many oracles.
TAGGED_SQL = """(SELECT *, CAST(sum(CASE WHEN is_start THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY chunk_id) AS BIGINT) AS speech_no,
 coalesce(ts_us - CASE WHEN speech_score >= 0.5 THEN ts_us ELSE prev END <= 64000, false) AS in_speech FROM (SELECT *,
 speech_score >= 0.5 AND (prev IS NULL OR ts_us - prev > 64000) AS is_start FROM (SELECT *,
 last_value(CASE WHEN speech_score >= 0.5 THEN ts_us END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY chunk_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v_chunks) a) b)"""

SEGMENTS_SQL = f"""(SELECT t.source_id, t.speech_no, min(ts_us) AS start_us, max(ts_us) AS last_speech_us, count(*) AS n_speech_chunks,
 max(ts_us) - 32000 AS end_us, max(z.stop) - max(ts_us) <= 64000 AS forced FROM {TAGGED_SQL} t JOIN (SELECT source_id, max(ts_us) AS stop FROM v_chunks
 GROUP BY 1) z ON z.source_id = t.source_id WHERE speech_score >= 0.5 GROUP BY 1, 2)"""


def _tagged(spark, sf, with_data=False):
    rows, slices = views.chunks(spark, sf)
    if not with_data:
        rows = rows.drop("data")
    return A.speech_segments_of_chunks(rows, slices, THRESHOLD, SILENCE_US), slices


def _segments(spark, sf):
    tagged, slices = _tagged(spark, sf)
    return A.speech_segments(tagged, 32_000, SILENCE_US), tagged, slices


@query("w3_time_cursor", "SELECT chunk_id, source_id, ts_us + 1000000 AS cursor_us FROM v_chunks")
def w3(spark, sf):
    rows, slices = views.chunks(spark, sf)
    return A.time_cursor(rows, slices, F.lit(1_000_000)).select("chunk_id", "source_id", "cursor_us")


@query("w4_speech_segments", f"SELECT * FROM {SEGMENTS_SQL} s")
def w4(spark, sf):
    return _segments(spark, sf)[0]


@query("w4_chunk_flags", f"SELECT chunk_id, source_id, in_speech, speech_no FROM {TAGGED_SQL} t")
def w4_flags(spark, sf):
    return _tagged(spark, sf)[0].select("chunk_id", "source_id", "in_speech", "speech_no")


@query("p2_speech_gate", f"SELECT chunk_id, source_id FROM {TAGGED_SQL} t WHERE in_speech")
def p2(spark, sf):
    return A.speech_gate(_tagged(spark, sf)[0]).select("chunk_id", "source_id")


@query(
    "n3_speech_only_fan_out",
    f"""SELECT chunk_id, subscriber FROM {TAGGED_SQL} t JOIN (SELECT 'archive' AS subscriber, false AS speech_only UNION ALL SELECT 'transcriber', true) s
        ON in_speech OR NOT speech_only""",
)
def n3(spark, sf):
    """One subscriber wants all chunks, the other only those in speech."""
    wants = F.when(F.col("in_speech"), F.array(F.lit("archive"), F.lit("transcriber"))).otherwise(F.array(F.lit("archive")))
    return _tagged(spark, sf)[0].select("chunk_id", F.explode(wants).alias("subscriber"))


@query(
    "j6_merge_vad_chunks",
    f"SELECT chunk_id, source_id, in_speech FROM {TAGGED_SQL} t",
)
def j6_chunks(spark, sf):
    """Speech events derived from the segments, merged back into the chunks: gives the flags of w4."""
    segs, tagged, _ = _segments(spark, sf)
    chunks = tagged.select("source_id", "chunk_id", "ts_us")
    got = A.merge_vad(chunks, A.vad_events(segs, SILENCE_US), plan_slices(chunks, "source_id", "ts_us"), "ts_us", ["chunk_id"])
    return got.select("chunk_id", "source_id", "in_speech")


@query(
    "j7_lookback_chunks",
    f"""SELECT c.chunk_id, s.source_id, s.speech_no AS into_speech_no FROM {SEGMENTS_SQL} s JOIN {TAGGED_SQL} c ON c.source_id = s.source_id
        AND NOT c.in_speech AND c.ts_us >= s.start_us - 1000000 AND c.ts_us < s.start_us""",
)
def j7_chunks(spark, sf):
    segs, tagged, _ = _segments(spark, sf)
    return A.prebuffered(tagged, segs).select("chunk_id", "source_id", "into_speech_no")


def _drafts(segs):
    """Each speech segment as a draft."""
    name = F.concat_ws("-", "source_id", "speech_no")
    return segs.select("source_id", name.alias("draft_id"), "start_us", F.col("last_speech_us").alias("stop_us"))


DRAFT_AUDIO_SQL = f"""SELECT concat(s.source_id, '-', CAST(s.speech_no AS STRING)) AS draft_id, c.chunk_id FROM {SEGMENTS_SQL} s JOIN v_chunks c
        ON c.source_id = s.source_id AND c.ts_us BETWEEN s.start_us AND s.last_speech_us"""


@query("j8_draft_audio_range", DRAFT_AUDIO_SQL)
def j8(spark, sf):
    segs, tagged, _ = _segments(spark, sf)
    chunks = tagged.select("source_id", "chunk_id", "ts_us")
    return A.draft_audio_range(chunks, _drafts(segs), bin_us=1_000_000).select("draft_id", "chunk_id")


@query("j8_planned_bins", DRAFT_AUDIO_SQL)
def j8_planned(spark, sf):
    """The same with bins planned from the lengths of the drafts and the density of the chunks."""
    segs, tagged, _ = _segments(spark, sf)
    chunks = tagged.select("source_id", "chunk_id", "ts_us")
    return A.draft_audio_range(chunks, _drafts(segs), bin_us=None).select("draft_id", "chunk_id")


BATCHED_SQL = f"""(SELECT *, CAST(floor((cum - n_samples - base) / 160) AS BIGINT) AS batch_no FROM (SELECT *,
 min(cum - n_samples) OVER (PARTITION BY source_id, speech_no) AS base FROM (SELECT *, sum(n_samples) OVER (PARTITION BY source_id ORDER BY chunk_id) AS cum
 FROM {TAGGED_SQL} t WHERE in_speech) a) b)"""


def _batched(spark, sf, with_data=False):
    tagged, slices = _tagged(spark, sf, with_data)
    return A.sample_batches(tagged, slices, BATCH), slices


@query("w5_sample_batches", f"SELECT chunk_id, source_id, speech_no, batch_no FROM {BATCHED_SQL} x")
def w5(spark, sf):
    return _batched(spark, sf)[0].select("chunk_id", "source_id", "speech_no", "batch_no")


JOBS_SQL = f"""(SELECT source_id, speech_no, batch_no, arg_min(chunk_id, ts_us) AS first_chunk, arg_max(chunk_id, ts_us) AS last_chunk,
 CAST(sum(n_samples) AS BIGINT) AS samples, min(ts_us) AS first_us, max(ts_us) AS last_us, max(sample_rate) AS sample_rate
 FROM {BATCHED_SQL} x GROUP BY 1, 2, 3 HAVING sum(n_samples) > 60)"""


@query("a4_speech_batch", f"SELECT * FROM {JOBS_SQL} j")
def a4(spark, sf):
    return A.speech_batches(_batched(spark, sf)[0])


@query(
    "a12_job_metrics",
    f"""WITH j AS (SELECT source_id, first_chunk AS job_id, first_us, last_us, last_us + 32000 AS issued_us, last_us + 32000 + samples * 500 AS finished_us,
        CAST(batch_no + 1 AS BIGINT) AS n_segments FROM {JOBS_SQL} b)
        SELECT a.source_id, a.job_id, (a.last_us - a.first_us) / 1e6 AS sound_sec, (a.finished_us - a.issued_us) / 1e6 AS work_sec, a.n_segments,
        count(*) FILTER (b.issued_us <= a.finished_us) - count(*) FILTER (b.finished_us < a.finished_us OR (b.finished_us = a.finished_us
        AND b.job_id <= a.job_id)) AS pending FROM j a JOIN j b ON a.source_id = b.source_id GROUP BY ALL""",
)
def a12(spark, sf):
    """Jobs are issued when their last chunk ends; work takes half a millisecond per sample."""
    jobs = A.speech_batches(_batched(spark, sf)[0])
    issued = F.col("last_us") + 32_000
    jobs = jobs.select(
        "source_id", F.col("first_chunk").alias("job_id"), "first_us", "last_us", issued.alias("issued_us"),
        (issued + F.col("samples") * 500).alias("finished_us"), (F.col("batch_no") + 1).alias("n_segments"),
    )
    return A.job_metrics(jobs, plan_slices(jobs, "source_id", "issued_us"))


PIECES_SQL = """(SELECT *, greatest(segment_index * 500 - b, 0) AS lo, least((segment_index + 1) * 500 - b, n_samples) AS hi FROM (SELECT *,
 unnest(generate_series(CAST(floor(b / 500) AS BIGINT), CAST(floor((b + n_samples - 1) / 500) AS BIGINT))) AS segment_index FROM (SELECT *,
 CAST(sum(n_samples) OVER (PARTITION BY source_id ORDER BY chunk_id) - n_samples AS BIGINT) AS b FROM v_chunks) a) p)"""

RECORDED_SQL = f"""(SELECT source_id, segment_index, CAST(sum(hi - lo) AS BIGINT) AS samples, round(sum(hi - lo) / 2000.0e0, 6) AS duration_sec,
 segment_index * 0.25e0 AS start_offset_sec, sum(hi - lo) < 500 AS is_partial FROM {PIECES_SQL} x GROUP BY 1, 2)"""


def _pieces(spark, sf, with_data=False):
    rows, slices = views.chunks(spark, sf)
    return A.recording_pieces(rows if with_data else rows.drop("data"), slices, SEGMENT_SEC)


@query("w6_fixed_segments", f"SELECT chunk_id, source_id, segment_index, CAST(hi - lo AS BIGINT) AS piece_samples FROM {PIECES_SQL} x")
def w6(spark, sf):
    got = _pieces(spark, sf)
    return got.select("chunk_id", "source_id", "segment_index", F.col("piece_samples").cast("long").alias("piece_samples"))


@query("s13_segment_recording", f"SELECT * FROM {RECORDED_SQL} s")
def s13(spark, sf):
    return A.recording_segments(_pieces(spark, sf), SEGMENT_SEC)


PCM_SQL = "CAST(trunc(CAST(x * CAST(32767 AS FLOAT) AS FLOAT)) AS INT)"


@query(
    "s13_recorded_samples",
    f"""SELECT source_id, segment_index, count(*) AS n, CAST(sum(CAST(trunc(CAST(data[i] * CAST(32767 AS FLOAT) AS FLOAT)) AS INT)) AS BIGINT) AS total
        FROM (SELECT source_id, segment_index, data, unnest(generate_series(lo + 1, hi)) AS i FROM {PIECES_SQL} x) y GROUP BY 1, 2""",
)
def s13_samples(spark, sf):
    audio = A.recording_audio(_pieces(spark, sf, with_data=True))
    total = F.aggregate("pcm", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return audio.select("source_id", "segment_index", F.size("pcm").cast("long").alias("n"), total.alias("total"))


@query(
    "a5_session_manifest",
    f"SELECT source_id, count(*) AS total_segments, round(sum(duration_sec), 6) AS total_duration_sec FROM {RECORDED_SQL} s GROUP BY 1",
)
def a5(spark, sf):
    return A.session_manifest(A.recording_segments(_pieces(spark, sf), SEGMENT_SEC))


@query(
    "s12_extract_draft_audio",
    f"""SELECT draft_id, part_no, count(c.chunk_id) * 64 + CASE WHEN part_no = min(part_no) OVER (PARTITION BY draft_id) THEN 800 ELSE 0 END AS n_samples,
        round(sum(list_sum(list_transform(data, lambda x: CAST(x AS DOUBLE)))), 4) AS total
        FROM (SELECT concat(s.source_id, '-', CAST(s.speech_no AS STRING)) AS draft_id, c.chunk_id, c.data,
        CAST(floor((c.ts_us - (s.start_us - 100000)) / 500000) AS BIGINT) AS part_no FROM {SEGMENTS_SQL} s JOIN v_chunks c ON c.source_id = s.source_id AND
        c.ts_us BETWEEN s.start_us - 100000 AND s.last_speech_us) c GROUP BY 1, 2""",
)
def s12(spark, sf):
    """0.4 s of silence, a tenth of a second before the speech, and the speech, in parts of half a second."""
    segs, tagged, _ = _segments(spark, sf)
    rows, _ = views.chunks(spark, sf)
    clips = A.draft_clips(rows, _drafts(segs), lead_us=100_000, part_us=500_000, bin_us=1_000_000)
    total = F.aggregate("data", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return clips.select("draft_id", "part_no", F.size("data").cast("long").alias("n_samples"), F.round(total, 4).alias("total"))


@query(
    "s4_read_audio_corpus",
    f"""SELECT chunk_no, count(*) AS n_files, CAST(sum(least(100, samples - chunk_no * 100)) AS BIGINT) AS samples FROM (SELECT samples,
        unnest(generate_series(0, CAST(ceil(samples / 100.0) AS BIGINT) - 1)) AS chunk_no FROM {RECORDED_SQL} r) x GROUP BY 1""",
)
def s4(spark, sf):
    """The recorded segments as WAV bytes, one per segment, decoded again in 50 ms chunks."""
    pieces = _pieces(spark, sf, with_data=True)
    part = F.slice("data", F.col("piece_from").cast("int") + 1, F.col("piece_samples").cast("int"))
    ordered = F.sort_array(F.collect_list(F.struct("chunk_id", part.alias("p"))))  # one segment
    clips = pieces.groupBy("source_id", "segment_index").agg(
        F.flatten(F.transform(ordered, lambda c: c["p"])).alias("data"), F.max("sample_rate").alias("sample_rate")
    )
    wav = audio_files.to_wav(clips, ["source_id", "segment_index"])
    files = wav.select(F.concat_ws("/", "source_id", "segment_index").alias("path"), F.col("wav").alias("content"))
    got = audio_files.decode_audio(files, chunk_sec=0.05)
    return got.filter("event_class = 'AudioChunkEvent'").groupBy("chunk_no").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.size("data").cast("long")).alias("samples")
    )


@query(
    "s5_pcm_decode",
    """SELECT chunk_id, width, len(data) AS n, round(list_sum(list_transform(data, lambda x: CASE width
       WHEN 2 THEN trunc(CAST(x AS FLOAT) * CAST(32767 AS FLOAT)) / 32767.0e0 ELSE trunc(CAST(x AS DOUBLE) * 2147483647.0e0) / 2147483647.0e0 END)), 4) AS total
       FROM v_chunks, (SELECT unnest([2, 4]) AS width) w""",
)
def s5(spark, sf):
    """Samples written as 16-bit and 32-bit values and read back."""
    rows, _ = views.chunks(spark, sf)
    rows = rows.select("chunk_id", "data", F.explode(F.array(F.lit(2), F.lit(4))).alias("width"))

    def read(batches):
        for pdf in batches:
            for width, part in pdf.groupby("width"):
                sizes = part["data"].map(len).to_numpy()
                flat = np.concatenate(part["data"].to_list())
                wide = (flat * np.float32(32767.0)).astype("<i2") if width == 2 else (flat.astype(np.float64) * 2147483647.0).astype("<i4")
                back = audio_files.decode_pcm(wide.tobytes(), int(width)).astype(np.float64)  # the whole batch at once
                total = np.add.reduceat(back, np.cumsum(sizes) - sizes)
                yield part[["chunk_id", "width"]].assign(n=sizes, total=total)

    got = rows.mapInPandas(read, "chunk_id BIGINT, width INT, n BIGINT, total DOUBLE")
    return got.select("chunk_id", "width", "n", F.round("total", 4).alias("total"))


_SUM = "round(list_sum(list_transform(range(1, len({x}) + 1), lambda i: i * CAST({x}[i] AS DOUBLE))), 4)"
_MIXED = "list_transform(range(1, 33), lambda i: CAST((CAST(data[2 * i - 1] AS DOUBLE) + CAST(data[2 * i] AS DOUBLE)) / 2 AS FLOAT))"


@query(
    "f13_mix_channels",
    f"""SELECT chunk_id, {_SUM.format(x="data")} AS repeated, {_SUM.format(x=_MIXED)} AS mixed, 0.0e0 AS padded,
        {_SUM.format(x="list_transform(range(1, 33), lambda i: data[2 * i - 1])")} AS truncated FROM v_chunks""",
)
def f13(spark, sf):
    """Every sample counts, with its place: one channel to two, two to one, two to three, two to one by way of three."""
    rows, _ = views.chunks(spark, sf)
    mono = F.transform("data", lambda x: F.array(x))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(F.get("data", 2 * i), F.get("data", 2 * i + 1)))

    def weighed(frames, channel):
        placed = F.transform(frames, lambda f, i: (i + 1) * f[channel].cast("double"))
        return F.round(F.aggregate(placed, F.lit(0.0), lambda acc, x: acc + x), 4)

    return rows.select(
        "chunk_id",
        weighed(samples.mix_channels(mono, 1, 2), 1).alias("repeated"),
        weighed(samples.mix_channels(pairs, 2, 1), 0).alias("mixed"),
        weighed(samples.mix_channels(pairs, 2, 3), 2).alias("padded"),
        weighed(samples.mix_channels(samples.mix_channels(pairs, 2, 3), 3, 2), 0).alias("truncated"),
    )


# The filter itself: 64 samples at 2 kHz to 512 at 16 kHz, 16 taps on both sides under a Hann window.
RESAMPLED_SQL = """
SELECT chunk_id, j, CAST(sum(w * CAST(data[near + 1] AS DOUBLE)) / CASE WHEN abs(sum(w)) > 1e-9 THEN sum(w) ELSE 1 END AS FLOAT) AS v FROM (
  SELECT chunk_id, data, j, near, CASE WHEN gap = 0 THEN 1.0e0 ELSE sin(pi() * gap) / (pi() * gap) END
         * (0.5e0 + 0.5e0 * cos(pi() * greatest(-1.0e0, least(1.0e0, gap / 16.0e0)))) AS w FROM (
    SELECT chunk_id, data, j, CAST(floor(j / 8.0e0) AS BIGINT) + k AS near, j / 8.0e0 - (floor(j / 8.0e0) + k) AS gap
    FROM v_chunks, (SELECT unnest(range(0, 512)) AS j) js, (SELECT unnest(range(-15, 17)) AS k) ks) g
  WHERE near >= 0 AND near < 64) t GROUP BY chunk_id, j
"""


@query(
    "f14_resample",
    f"""SELECT chunk_id, count(*) AS n, CAST(16000 AS BIGINT) AS rate, 512 / 16000.0e0 AS duration, round(sum(CAST(v AS DOUBLE)), 3) AS total,
        round(max(CASE WHEN j = 101 THEN CAST(v AS DOUBLE) END), 5) AS early, round(max(CASE WHEN j = 509 THEN CAST(v AS DOUBLE) END), 5) AS late
        FROM ({RESAMPLED_SQL}) r GROUP BY chunk_id""",
)
def f14(spark, sf):
    rows, _ = views.chunks(spark, sf)
    got = audio_files.resample(rows.select("chunk_id", "data", "sample_rate"), 16_000)
    total = F.aggregate("data", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    at = lambda i: F.round(F.get("data", F.lit(i)).cast("double"), 5)
    return got.select(
        "chunk_id", F.size("data").cast("long").alias("n"), F.col("sample_rate").cast("long").alias("rate"), "duration",
        F.round(total, 3).alias("total"), at(101).alias("early"), at(509).alias("late"),
    )


@query(
    "f17_fit_512",
    """SELECT chunk_id, CAST(512 AS BIGINT) AS n, round(list_sum(list_transform(data, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM v_chunks""",
)
def f17(spark, sf):
    rows, _ = views.chunks(spark, sf)
    fit = samples.fit_512(F.col("data"))
    total = F.aggregate(fit, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return rows.select("chunk_id", F.size(fit).cast("long").alias("n"), F.round(total, 5).alias("total"))


@query(
    "f18_frames_per_chunk",
    "SELECT chunk_id, CAST(greatest(1, round_even(chunk_id / 2.0e0, 0)) AS BIGINT) AS frames FROM v_chunks",
)
def f18(spark, sf):
    rows, _ = views.chunks(spark, sf)
    got = samples.frames_per_chunk(F.col("chunk_id") / 2, F.lit(1.0))
    return rows.select("chunk_id", got.cast("long").alias("frames"))


@query(
    "f19_pcm16_encode",
    f"SELECT chunk_id, CAST(list_sum(list_transform(data, lambda x: {PCM_SQL})) AS BIGINT) AS total FROM v_chunks",
)
def f19(spark, sf):
    rows, _ = views.chunks(spark, sf)
    total = F.aggregate(samples.pcm16_encode(F.col("data")), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.select("chunk_id", total.alias("total"))


@query("x3_score_speech", "SELECT chunk_id, round(sqrt(list_sum(list_transform(data, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 64), 6) AS score FROM v_chunks")
def x3(spark, sf):
    rows, _ = views.chunks(spark, sf)
    return plugins.score_speech(rows.drop("speech_score")).select("chunk_id", F.round("speech_score", 6).alias("score"))


def _hear():
    """A stand-in transcriber: says how many samples it got; nothing for batches below the full length."""
    return lambda data, rate, prompt: ["[BLANK_AUDIO]"] if data.size < 128 else ["heard", f" {data.size} "]


@query(
    "x2_transcribe",
    f"""SELECT source_id, speech_no, batch_no, concat('heard ', CAST(n AS STRING)) AS text FROM (SELECT source_id, speech_no, batch_no,
        CAST(sum(n_samples) AS BIGINT) AS n FROM {BATCHED_SQL} x GROUP BY 1, 2, 3) y WHERE n >= 128""",
)
def x2(spark, sf):
    """Batches to the transcriber, blanks dropped, segments joined."""
    heard = plugins.transcribe(A.batch_audio(_batched(spark, sf, with_data=True)[0]), _hear)
    kept = drop_blank_audio(heard).select("source_id", "speech_no", "batch_no", F.posexplode("segments").alias("seq", "text"))
    return assemble_text(kept, ["source_id", "speech_no", "batch_no"])


CHECKED_SQL = """(SELECT *, CASE WHEN text IS NULL THEN 'missing_text' WHEN silence_after IS NULL THEN 'missing_silence'
 WHEN silence_after < 0 THEN 'negative_silence' END AS error FROM v_segments)"""


def _checked(spark, sf):
    segs = views.segments(spark, sf)
    return segs.withColumn("error", segment_spec.segment_error(F.col("text"), F.col("silence_after").cast("string")))


@query("s7_read_segment_spec", f"SELECT spec_id, seg_no, error FROM {CHECKED_SQL} c")
def s7(spark, sf):
    return _checked(spark, sf).select("spec_id", "seg_no", "error")


@query("a6_spec_summary", f"SELECT spec_id, count(*) AS n_segments, CAST(sum(silence_after) AS BIGINT) AS total_silence FROM {CHECKED_SQL} c WHERE error IS NULL GROUP BY 1")
def a6(spark, sf):
    return segment_spec.spec_summary(_checked(spark, sf).filter(F.col("error").isNull()))


@query(
    "w9_timeline",
    f"""SELECT spec_id, seg_no, CAST(coalesce(sum(duration_units + silence_after) OVER (PARTITION BY spec_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS BIGINT) AS start_at FROM {CHECKED_SQL} c WHERE error IS NULL""",
)
def w9(spark, sf):
    good = _checked(spark, sf).filter(F.col("error").isNull()).drop("text", "error")
    got = segment_spec.timeline(good, plan_slices(good, "spec_id", "seg_no"), "duration_units")
    return got.select("spec_id", "seg_no", "start_at")


@query("f15_silence", f"SELECT spec_id, seg_no, CAST(floor(silence_after * 0.35e0 * 1000) AS BIGINT) AS n FROM {CHECKED_SQL} c WHERE error IS NULL")
def f15(spark, sf):
    good = _checked(spark, sf).filter(F.col("error").isNull())
    hush = samples.silence(F.col("silence_after") * F.lit(0.35), F.lit(1000))
    return good.select("spec_id", "seg_no", F.size(hush).cast("long").alias("n"))


@query(
    "f16_concat_audio",
    """SELECT spec_id, CAST(sum(length(text) + CASE WHEN turn_silence < 0 THEN 0 ELSE turn_silence * 100 END) AS BIGINT) AS n
       FROM (SELECT spec_id, text, silence_after AS turn_silence FROM v_segments) x GROUP BY 1 HAVING count(DISTINCT CASE WHEN turn_silence < 0 THEN 1 ELSE 0 END) = 1""",
)
def f16(spark, sf):
    """One sample per character; an invalid segment comes with another rate, which spoils its script."""
    rate = F.when(F.col("silence_after") < 0, 200).otherwise(100)
    ones = F.array_repeat(F.lit(1.0).cast("float"), F.length("text"))
    clips = views.segments(spark, sf).select(
        "spec_id", "seg_no", ones.alias("data"), rate.alias("sample_rate"), F.lit(1).alias("channels"), "silence_after"
    )
    good, _ = segment_spec.concat_audio(clips, "spec_id", "seg_no")
    return good.groupBy("spec_id").agg(F.sum(F.size("data").cast("long")).alias("n"))


def _timed(df):
    return df.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", "1 second")


def _end_row(rows, columns):
    """A row per source far behind its last one, to move the watermark past everything."""
    last = rows.groupBy("source_id").agg((F.max("ts_us") + 3_600_000_000).alias("ts_us"))
    return last.select(*[F.col(c) if c in ("source_id", "ts_us") else F.lit(None).cast(t).alias(c) for c, t in columns])


@query(
    "t4_vad_sessionizer",
    f"SELECT source_id, start_us, last_speech_us, n_speech_chunks FROM {SEGMENTS_SQL} s",
)
def t4(spark, sf):
    rows = views.chunks(spark, sf)[0].select("source_id", "ts_us", "speech_score")
    ends = _end_row(rows, [("source_id", None), ("ts_us", None), ("speech_score", "double")])
    stream = stream_of(rows.unionByName(ends), "chunks")
    return run_available(SA.vad_sessions(_timed(stream), THRESHOLD, SILENCE_US), "vad")


_MERGE_COLUMNS = [("source_id", None), ("ts_us", None), ("prio", "int"), ("chunk_id", "bigint"), ("state", "boolean")]


def _both(spark, sf, chunk_filter=None):
    segs, tagged, _ = _segments(spark, sf)
    chunks = tagged if chunk_filter is None else tagged.filter(chunk_filter)
    chunks = chunks.select("source_id", "ts_us", F.lit(1).alias("prio"), "chunk_id", F.lit(None).cast("boolean").alias("state"))
    vad = A.vad_events(segs, SILENCE_US)
    return chunks, vad.select(
        "source_id", "ts_us", F.lit(0).alias("prio"), F.lit(None).cast("bigint").alias("chunk_id"),
        (F.col("event_class") == "AudioSpeechStartEvent").alias("state"),
    )


EPOCH_US = 10_000_000  # rows at time 0 would count as late: the first watermark is 0


def _closed(chunks, vad):
    both = chunks.unionByName(vad).withColumn("ts_us", F.col("ts_us") + EPOCH_US)
    return both.unionByName(_end_row(both, _MERGE_COLUMNS).withColumn("prio", F.lit(0)).withColumn("state", F.lit(False)))


@query("t6_merge_vad_stream", f"SELECT chunk_id, source_id, in_speech FROM {TAGGED_SQL} t")
def t6(spark, sf):
    stream = stream_of(_closed(*_both(spark, sf)), "merge")
    return run_available(SA.merge_vad_stream(_timed(stream)), "merged").select("chunk_id", "source_id", "in_speech")


# A silent chunk is replayed once, at the first start after it, if that start is near enough.
@query(
    "t5_prebuffer_replay",
    f"""SELECT chunk_id, source_id, min(start_us) AS mark_us FROM (SELECT c.chunk_id, s.source_id, s.start_us, c.ts_us FROM {SEGMENTS_SQL} s
        JOIN {TAGGED_SQL} c ON c.source_id = s.source_id AND NOT c.in_speech AND c.ts_us < s.start_us) x GROUP BY chunk_id, source_id
        HAVING min(start_us) - max(ts_us) <= 1000000""",
)
def t5(spark, sf):
    chunks, vad = _both(spark, sf, ~F.col("in_speech"))
    stream = stream_of(_closed(chunks, vad.filter("state")), "replay")
    got = run_available(SA.prebuffer_replay(_timed(stream)), "replayed")
    return got.select("chunk_id", "source_id", (F.col("mark_us") - EPOCH_US).alias("mark_us"))


@query(
    "t9_micro_batch_transcribe",
    f"""SELECT source_id, speech_no, batch_no, first_us, last_us, concat('heard ', CAST(n AS STRING)) AS text FROM (SELECT source_id, speech_no, batch_no,
        CAST(sum(n_samples) AS BIGINT) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM {BATCHED_SQL} x GROUP BY 1, 2, 3) y WHERE n >= 128""",
)
def t9(spark, sf):
    """Batches of a stream through the transcriber, within the stream."""
    tagged = _tagged(spark, sf, with_data=True)[0].filter("in_speech").select("source_id", "speech_no", "ts_us", "sample_rate", "data")
    cols = [("source_id", None), ("speech_no", "bigint"), ("ts_us", None), ("sample_rate", "int"), ("data", "array<float>")]
    stream = stream_of(tagged.unionByName(_end_row(tagged, cols)), "speech")
    batches = SA.stream_batches(stream, BATCH)
    texts = run_available(hearing.texts_of_stream(batches, _hear), "texts").filter("text IS NOT NULL")
    last = F.round(F.col("audio_end_time") * 1e6).cast("bigint") - 32_000
    return texts.select("source_id", "speech_no", "batch_no", F.col("seq").alias("first_us"), last.alias("last_us"), "text")


_CHUNK_COLUMNS = [("source_id", None), ("ts_us", None), ("chunk_id", "bigint"), ("speech_score", "double"), ("sample_rate", "int"), ("data", "array<float>")]


def chunk_stream(spark, sf):
    """The scored chunks as a watermarked stream, later by EPOCH_US, each source followed by a row without a chunk."""
    rows = views.chunks(spark, sf)[0].select(*[c for c, _ in _CHUNK_COLUMNS]).withColumn("ts_us", F.col("ts_us") + EPOCH_US)
    ends = _end_row(rows, _CHUNK_COLUMNS)
    clock = ends.withColumns({"source_id": F.lit("\u0000clock"), "ts_us": F.col("ts_us") + 3_600_000_000})  # lets the ends through
    return _timed(stream_of(rows.unionByName(ends).unionByName(clock), "chunks"))


def _dictate():
    """A stand-in transcriber: full batches open a draft, those of 128 samples close it, others are words in between."""

    def hear(data, rate, prompt):
        n = str(data.size)
        return {192: ["Freddy take this down. heard", n], 128: ["heard", n, " Freddy break break."]}.get(data.size, ["heard", n])

    return hear


# What the stand-in says, as a text table.
DICTATED_SQL = f"""(SELECT source_id, min(ts_us) + {EPOCH_US} AS seq, concat('t-', CAST(min(chunk_id) AS STRING)) AS event_id, CASE sum(n_samples) WHEN 192 THEN 'Freddy take this down. heard 192'
 WHEN 128 THEN 'heard 128 Freddy break break.' ELSE concat('heard ', CAST(sum(n_samples) AS STRING)) END AS text, CASE sum(n_samples) WHEN 192 THEN 'start' WHEN 128 THEN 'end' END AS marker,
 (min(ts_us) + {EPOCH_US}) / 1e6 AS audio_start_time, (max(ts_us) + {EPOCH_US} + 32000) / 1e6 AS audio_end_time FROM {BATCHED_SQL} x GROUP BY source_id, speech_no, batch_no)"""


@query("t9_audio_to_drafts", f"SELECT source_id, opened_at, full_text, forced FROM ({DRAFTS_SQL.replace('v_texts', DICTATED_SQL)}) x")
def t9_drafts(spark, sf):
    """Chunks to stored drafts in one stream: speech, batches, transcriber, boundaries, validated append."""
    events = hearing.stream_audio_to_drafts(
        chunk_stream(spark, sf), _dictate, threshold=THRESHOLD, silence_us=SILENCE_US, batch_samples=BATCH, prebuffer_us=0
    )
    return persisted(spark, events)


@query(
    "x1_three_taps",
    f"""SELECT 'raw' AS tap, source_id, 'AudioChunkEvent' AS event_class, ts_us, chunk_id, CAST(NULL AS BOOLEAN) AS in_speech FROM v_chunks UNION ALL
        SELECT 'merged', source_id, 'AudioChunkEvent', ts_us, chunk_id, in_speech FROM {TAGGED_SQL} t UNION ALL
        SELECT tap, source_id, 'AudioSpeechStartEvent', start_us, NULL, true FROM {SEGMENTS_SQL} s, (SELECT unnest(['vad', 'merged']) AS tap) UNION ALL
        SELECT tap, source_id, 'AudioSpeechStopEvent', last_speech_us + 64001, NULL, false FROM {SEGMENTS_SQL} s, (SELECT unnest(['vad', 'merged']) AS tap)""",
)
def x1_three(spark, sf):
    """A handler on each tap of one stream stores what it gets."""
    path = shared_dir(spark, "three-taps")
    taps = live.Taps()
    columns = ["source_id", "event_class", "ts_us", "chunk_id", "in_speech"]
    store = lambda tap: lambda group, rows: rows.select(*columns).write.mode("append").parquet(f"{path}/tap={tap}") if group == "audio" else None
    for tap in taps.NAMES:
        taps.attach(tap, store(tap))
    live.listen(hearing.tapped(chunk_stream(spark, sf), THRESHOLD, SILENCE_US), taps, "three-taps")
    got = spark.read.schema("source_id STRING, event_class STRING, ts_us BIGINT, chunk_id BIGINT, in_speech BOOLEAN, tap STRING").parquet(path)
    return got.withColumn("ts_us", F.col("ts_us") - EPOCH_US)


RING_US = 320_000
# Every second speech segment as a remote draft: its start event comes at the last speech, its audio from well before it, its end event later; every sixth never ends.
REMOTE_SQL = f"""(SELECT source_id, concat(source_id, '-', CAST(speech_no AS STRING)) AS draft_id, start_us - 480000 AS audio_start_us, last_speech_us AS start_us,
 CASE WHEN speech_no % 6 <> 0 THEN last_speech_us + 96000 * (speech_no % 4) END AS end_us FROM {SEGMENTS_SQL} g WHERE speech_no % 2 = 0)"""


def _remote_drafts(segs):
    no = F.col("speech_no")
    return segs.filter(no % 2 == 0).select(
        "source_id", F.concat_ws("-", "source_id", "speech_no").alias("draft_id"), (F.col("start_us") - 480_000).alias("audio_start_us"),
        F.col("last_speech_us").alias("start_us"), F.when(no % 6 != 0, F.col("last_speech_us") + 96_000 * (no % 4)).alias("end_us"),
    )


RESCANNED_SQL = f"""SELECT w.draft_id, c.chunk_id, c.ts_us < w.start_us AS replayed FROM (SELECT *, greatest(audio_start_us, start_us - {RING_US},
 CASE WHEN before IS NULL THEN audio_start_us WHEN before.stop < start_us THEN before.stop + 1 ELSE start_us END) AS low,
 coalesce(least(end_us, after - 1), 1000000000000000) AS high FROM (SELECT *, lead(start_us) OVER o AS after,
 lag(struct_pack(stop := coalesce(end_us, 1000000000000000))) OVER o AS before FROM {REMOTE_SQL} d WINDOW o AS (PARTITION BY source_id ORDER BY start_us, draft_id)) a) w
 JOIN v_chunks c ON c.source_id = w.source_id AND c.ts_us BETWEEN w.low AND w.high"""


@query("t7_rescan_audio", RESCANNED_SQL)
def t7_audio(spark, sf):
    """Each remote draft with its audio: what the ring held from its audio start on, then the chunks until its end."""
    segs, tagged, _ = _segments(spark, sf)
    rows = tagged.select("source_id", "ts_us", "chunk_id", "sample_rate", F.array(F.lit(0.0)).cast("array<float>").alias("data"))
    remote = _remote_drafts(segs)
    starts = remote.select("source_id", F.col("start_us").alias("ts_us"), "draft_id", "audio_start_us")
    ends = remote.filter("end_us IS NOT NULL").select("source_id", F.col("end_us").alias("ts_us"), "draft_id")
    events = rescan.rescan_events(rows, starts, ends).withColumn("ts_us", F.col("ts_us") + EPOCH_US).withColumn("audio_start_us", F.col("audio_start_us") + EPOCH_US)
    columns = [(c, t) for c, t in events.dtypes]
    flow = events.unionByName(_end_row(events, columns).withColumn("prio", F.lit(rescan.END)))
    audio = run_available(rescan.rescan_audio(_timed(stream_of(flow, "remote")), RING_US), "rescan-audio")
    return audio.filter("kind <> 'end'").select("draft_id", "chunk_id", (F.col("kind") == "replay").alias("replayed"))


@query("t7_rescan_audio_batch", RESCANNED_SQL)
def t7_audio_batch(spark, sf):
    """The same from stored chunks: a range join with the ring's bounds."""
    segs, tagged, _ = _segments(spark, sf)
    remote = _remote_drafts(segs)
    got = A.rescan_audio_range(tagged.select("source_id", "ts_us", "chunk_id"), remote, plan_slices(remote, "source_id", "start_us"), RING_US)
    return got.select("draft_id", "chunk_id", "replayed")


@query(
    "t7_rescan_coordinator",
    """SELECT draft_id AS original_draft_id, CASE WHEN n % 4 = 3 THEN NULL ELSE concat('local-', draft_id) END AS revision_id,
       CASE n % 4 WHEN 0 THEN 'paired' WHEN 1 THEN 'paired' WHEN 2 THEN 'forced' ELSE 'failed' END AS outcome
       FROM (SELECT draft_id, length(full_text) AS n FROM v_drafts) x""",
)
def t7(spark, sf):
    """A remote and a local draft per stored draft. By text length the local one ends early, ends late, never ends, or never
    comes."""
    rows = views.drafts(spark, sf)
    n = F.length("full_text") % 4
    base = (F.col("timestamp") * 1000).cast("bigint")
    times = {("remote", "start", 0): F.lit(True), ("local", "start", 1000): n != 3, ("local", "end", 8000): n == 0}
    times |= {("remote", "end", 9000): F.lit(True), ("local", "end", 12000): n == 1}
    return _rescanned(rows.select(F.col("draft_id").alias("source_id"), "draft_id", base.alias("base"), *[u.alias(f"_{i}") for i, u in enumerate(times.values())]), list(times))


@query(
    "t7_overlapping_rescans",
    """SELECT draft_id AS original_draft_id, CASE WHEN n % 3 = 2 THEN NULL ELSE concat('local-', draft_id) END AS revision_id,
       CASE n % 3 WHEN 0 THEN 'paired' WHEN 1 THEN 'forced' ELSE 'failed' END AS outcome FROM (SELECT draft_id, length(full_text) AS n FROM v_drafts) x""",
)
def t7_overlapping(spark, sf):
    """Many drafts of one source, each starting while those before it still wait for their local draft."""
    rows = views.drafts(spark, sf)
    n = F.length("full_text") % 3
    number = F.row_number().over(Window.partitionBy("author_uri").orderBy("timestamp"))
    times = {("remote", "start", 0): F.lit(True), ("local", "start", 1000): n != 2, ("remote", "end", 9000): F.lit(True), ("local", "end", 12000): n == 0}
    return _rescanned(rows.select(F.col("author_uri").alias("source_id"), "draft_id", (number * 10_000).cast("bigint").alias("base"), *[u.alias(f"_{i}") for i, u in enumerate(times.values())]), list(times))


def _rescanned(rows, times):
    """Events of (origin, kind, time after the base) where the column of that number is true, as a stream through the coordinator."""

    def event(i, origin, kind, at):
        ident = F.col("draft_id") if origin == "remote" else F.concat(F.lit("local-"), F.col("draft_id"))
        return F.when(
            F.col(f"_{i}"),
            F.struct(
                F.lit(origin).alias("origin"), F.lit(kind).alias("kind"), (F.col("base") + at).alias("ts_ms"),
                ident.alias("draft_id"), F.lit(None).cast("string").alias("full_text"),
            ),
        )

    made = F.array(*[event(i, *t) for i, t in enumerate(times)])
    flow = rows.select("source_id", F.explode(made).alias("e")).filter(F.col("e").isNotNull()).select("source_id", "e.*")
    tail = flow.agg((F.max("ts_ms") + 3_600_000).alias("ts_ms")).select(
        F.lit("\u0000clock").alias("source_id"), F.lit("local").alias("origin"), F.lit("start").alias("kind"), "ts_ms",
        F.lit("-").alias("draft_id"), F.lit(None).cast("string").alias("full_text"),
    )
    stream = stream_of(flow.unionByName(tail), "rescan").withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", "1 second")
    return run_available(live.rescan_revisions(stream), "rescan").select("original_draft_id", "revision_id", "outcome")
