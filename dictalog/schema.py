"""Fixed event classes and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The wire names of the event classes, by group.
AUDIO_CLASSES = [
    "AudioStartEvent",
    "AudioStopEvent",
    "AudioChunkEvent",
    "AudioSpeechStartEvent",
    "AudioSpeechStopEvent",
    "AudioErrorEvent",
]
TEXT_CLASSES = ["TextEvent"]
DRAFT_CLASSES = ["DraftStartEvent", "DraftEndEvent"]
RESCAN_CLASS = "DraftRescanEvent"
CHUNK_CLASS = "AudioChunkEvent"

SUBSCRIBABLE = AUDIO_CLASSES + TEXT_CLASSES + DRAFT_CLASSES
DECODABLE = SUBSCRIBABLE + [RESCAN_CLASS]
GROUPS = {"audio": AUDIO_CLASSES, "text": TEXT_CLASSES, "draft": DRAFT_CLASSES + [RESCAN_CLASS]}

# The classes shown in the live feed.
FEED_CLASSES = [
    "AudioSpeechStartEvent",
    "AudioSpeechStopEvent",
    "TextEvent",
    "DraftStartEvent",
    "DraftEndEvent",
]
SPEECH_CLASSES = ["AudioSpeechStartEvent", "AudioSpeechStopEvent"]

DRAFT = T.StructType(
    [
        T.StructField("start_text", T.StringType()),
        T.StructField("end_text", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("draft_id", T.StringType()),
        T.StructField("parent_draft_id", T.StringType()),
        T.StructField("audio_start_time", T.DoubleType()),
        T.StructField("audio_end_time", T.DoubleType()),
    ]
)

# One row per JSON line; fields of all event classes side by side, absent ones null.
WIRE = T.StructType(
    [
        T.StructField("event_class", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("stream_start_time", T.DoubleType()),
        T.StructField("speech_start_time", T.DoubleType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("creation_location", T.StringType()),
        T.StructField("author_uri", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("blocksize", T.IntegerType()),
        T.StructField("datatype", T.StringType()),
        T.StructField("data", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("duration", T.DoubleType()),
        T.StructField("in_speech", T.BooleanType()),
        T.StructField("meta_data", T.MapType(T.StringType(), T.StringType())),
        T.StructField("silence_period_ms", T.IntegerType()),
        T.StructField("vad_threshold", T.DoubleType()),
        T.StructField("sampling_rate", T.DoubleType()),
        T.StructField("speech_pad_ms", T.IntegerType()),
        T.StructField("last_in_speech_chunk_time", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("audio_source_id", T.StringType()),
        T.StructField("audio_start_time", T.DoubleType()),
        T.StructField("audio_end_time", T.DoubleType()),
        T.StructField("original_draft_id", T.StringType()),
        T.StructField("draft", DRAFT),
        T.StructField("_malformed", T.StringType()),
    ]
)

AUDIO_ROWS = T.StructType(
    [
        T.StructField("event_class", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("chunk_no", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("blocksize", T.IntegerType()),
        T.StructField("datatype", T.StringType()),
        T.StructField("data", T.ArrayType(T.FloatType())),
        T.StructField("meta_data", T.MapType(T.StringType(), T.StringType())),
        T.StructField("message", T.StringType()),
    ]
)
