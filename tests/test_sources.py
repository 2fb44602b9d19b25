import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from dictalog import schema
from dictalog.operators import speech as A
from dictalog.operators.slices import KeySlices
from dictalog.sources import audio_files, event_log, segment_spec, sinks

FIELDS = {
    "AudioStartEvent": {"event_type": "audio_start", "sample_rate": 44100, "channels": 2, "blocksize": 1323, "datatype": "float32"},
    "AudioStopEvent": {"event_type": "audio_stop"},
    "AudioChunkEvent": {"event_type": "audio_chunk", "data": [[0.5, -0.5], [0.25, 0.0]], "duration": 0.03, "in_speech": True, "meta_data": {"file": "a.wav"}},
    "AudioSpeechStartEvent": {"event_type": "audio_speech_start", "silence_period_ms": 800, "vad_threshold": 0.5, "speech_pad_ms": 1500},
    "AudioSpeechStopEvent": {"event_type": "audio_speech_stop", "last_in_speech_chunk_time": 3.5},
    "AudioErrorEvent": {"event_type": "audio_input_error", "message": "gone"},
    "TextEvent": {"text": "hello \"you\"", "audio_source_id": "s", "audio_start_time": 1.0, "audio_end_time": 2.0},
    "DraftStartEvent": {"draft": {"start_text": "Freddy take this down", "end_text": None, "full_text": "", "draft_id": "d1"}},
    "DraftEndEvent": {"draft": {"start_text": "Freddy take this down", "end_text": "bye", "full_text": "body\nof it", "draft_id": "d1"}},
}


def test_wire_round_trip_of_every_class(spark, tmp_path):
    lines = [
        json.dumps({"event_class": f"<class 'x.y.{c}'>" if i % 2 else c, "source_id": "s", "timestamp": 1.5, "event_id": str(i), "author_uri": None, **f})
        for i, (c, f) in enumerate(FIELDS.items())
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines + ["{broken", json.dumps({"event_class": "Other"})]))
    good, bad = event_log.read_event_log(spark, str(tmp_path))
    assert sorted(r["reason"] for r in bad.collect()) == ["malformed", "unknown_class"]
    again, none = event_log.decode_events(event_log.encode_events(good))
    key = lambda rows: sorted(json.dumps(r.asDict(True), sort_keys=True) for r in rows)
    assert key(good.collect()) == key(again.collect()) and none.count() == 0
    by_class = {r["event_class"]: r for r in again.collect()}
    assert set(by_class) == set(FIELDS) == set(schema.SUBSCRIBABLE)
    assert by_class["AudioChunkEvent"]["data"] == [[0.5, -0.5], [0.25, 0.0]]
    assert by_class["DraftEndEvent"]["draft"]["full_text"] == "body\nof it"


def test_block_records(spark, tmp_path):
    text = lambda i, t: {"event_id": i, "text": t}
    rows = [
        {"classname": "a.TextEvent", "properties": text("1", "one")},
        {"classname": "a.ScribeCommandEvent", "properties": {"text_event": {"properties": text("2", "two")}, "attention_text_event": text("1", "not this")}},
        {"classname": "a.ScribeCommandEvent", "properties": {"text_event": text("3", "three"), "attention_text_event": text("4", "four")}},
        {"classname": "a.AudioStopEvent", "properties": {"event_id": "9"}},
    ]
    (tmp_path / "meta_events.json").write_text(json.dumps(rows))
    got = event_log.read_block_records(spark, str(tmp_path)).collect()
    assert {(r["event_id"], r["text"]) for r in got} == {("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")}


def wav(path, samples, rate, channels, width):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(samples.tobytes())


@pytest.mark.parametrize("channels, width, rate", [(1, 2, 16000), (2, 2, 44100), (1, 4, 16000), (2, 4, 8000)])
def test_audio_corpus(spark, tmp_path, channels, width, rate):
    n = rate // 10 + 7
    tone = np.sin(np.arange(n * channels) / 9) * 0.8
    scale = 32767 if width == 2 else 2147483647
    wav(tmp_path / "a.wav", (tone * scale).astype(f"<i{width}"), rate, channels, width)
    rows = audio_files.read_audio_corpus(spark, str(tmp_path), start_time=100.0).collect()
    assert [r["event_class"] for r in rows][0] == "AudioStartEvent" and rows[-1]["event_class"] == "AudioStopEvent"
    chunks = [r for r in rows if r["event_class"] == "AudioChunkEvent"]
    size = round(0.03 * rate)
    assert [len(r["data"]) for r in chunks] == [size * channels] * (n // size) + ([n % size * channels] if n % size else [])
    assert np.allclose(np.concatenate([r["data"] for r in chunks]), tone, atol=1e-4)
    assert chunks[0]["timestamp"] == 100.0 and abs(rows[-1]["timestamp"] - (100.0 + n / rate)) < 1e-9


def test_unreadable_audio_gives_error_rows(spark, tmp_path):
    wav(tmp_path / "eight.wav", np.zeros(10, dtype=np.uint8), 8000, 1, 1)
    (tmp_path / "no.wav").write_bytes(b"not a wav")
    rows = audio_files.read_audio_corpus(spark, str(tmp_path)).collect()
    assert [r["event_class"] for r in rows] == ["AudioErrorEvent"] * 2
    assert any("samples of 1 bytes" in r["message"] for r in rows)


def test_clip_to_wav_bytes(spark):
    df = spark.createDataFrame([("d", [0.5, -0.5, 0.0], 16000)], "id STRING, data ARRAY<FLOAT>, sample_rate INT")
    raw = audio_files.to_wav(df, ["id"]).first()["wav"]
    assert raw[:4] == b"RIFF" and struct.unpack("<3h", raw[-6:]) == (16383, -16383, 0)


def test_segment_specs(spark, tmp_path):
    specs = {
        "good.json": {"segments": [{"text": "a", "silence_after": 1}, {"text": "b", "silence_after": 0.5}]},
        "none.json": {"other": 1},
        "notlist.json": {"segments": {"text": "a"}},
        "empty.json": {"segments": []},
        "mixed.json": {
            "segments": [
                {"silence_after": 1},
                {"text": "x"},
                {"text": 5, "silence_after": 1},
                {"text": "x", "silence_after": "1"},
                {"text": "x", "silence_after": -1},
                "str",
                {"text": "fine", "silence_after": 2},
            ]
        },
    }
    for name, body in specs.items():
        (tmp_path / name).write_text(json.dumps(body))
    good, bad = segment_spec.read_segment_spec(spark, str(tmp_path))
    assert sorted((r["text"], r["silence_after"]) for r in good.collect()) == [("a", 1.0), ("b", 0.5), ("fine", 2.0)]
    got = sorted((r["spec_id"].rsplit("/", 1)[1], -1 if r["seg_no"] is None else r["seg_no"], r["error"]) for r in bad.collect())
    assert got == [
        ("empty.json", -1, "empty_segments"),
        ("mixed.json", 0, "missing_text"),
        ("mixed.json", 1, "missing_silence"),
        ("mixed.json", 2, "bad_text"),
        ("mixed.json", 3, "bad_silence"),
        ("mixed.json", 4, "negative_silence"),
        ("mixed.json", 5, "not_an_object"),
        ("none.json", -1, "no_segments"),
        ("notlist.json", -1, "segments_not_a_list"),
    ]


def test_concat_audio_mismatch(spark):
    ones = F.array_repeat(F.lit(1.0).cast("float"), 4)
    df = spark.createDataFrame(
        [("a", 0, 10, 1, 0.5), ("a", 1, 10, 1, 0.0), ("b", 0, 10, 1, 0.0), ("b", 1, 20, 1, 0.0), ("c", 0, 10, 1, 0.0), ("c", 1, 10, 2, 0.0)],
        "spec_id STRING, seg_no INT, sample_rate INT, channels INT, silence_after DOUBLE",
    ).withColumn("data", ones)
    good, bad = segment_spec.concat_audio(df, "spec_id", "seg_no")
    assert [(r["spec_id"], r["data"]) for r in good.collect()] == [("a", [1.0] * 4 + [0.0] * 5 + [1.0] * 4)]
    assert {tuple(r) for r in bad.collect()} == {("b", "sample_rate_mismatch"), ("c", "channel_mismatch")}


def test_batches_lose_no_sample(spark):
    rows = [("s", i, i * 1000, 64, 2000, 0.9 if i % 11 < 7 else 0.1) for i in range(200)]
    df = spark.createDataFrame(rows, "source_id STRING, chunk_id BIGINT, ts_us BIGINT, n_samples INT, sample_rate INT, speech_score DOUBLE")
    slices = KeySlices("source_id", "chunk_id")
    tagged = A.speech_segments_of_chunks(df, slices, 0.5, 2000)
    jobs = A.speech_batches(A.sample_batches(tagged, slices, 150))
    assert jobs.agg(F.sum("samples")).first()[0] == tagged.filter("in_speech").agg(F.sum("n_samples")).first()[0]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("d1", 1.0, "line one\nline two")], "draft_id STRING, timestamp DOUBLE, full_text STRING")
    sinks.export_draft_text(df, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/text").first()["text_line"] == "line one\nline two"
    assert spark.read.json(f"{tmp_path}/json").first()["properties"]["draft_id"] == "d1"


def wav_file(path, n_frames, rate=1000, channels=2, width=2, junk=b"", cut=0):
    """A WAV file, with another block before the samples, and its last bytes missing."""
    samples = np.random.default_rng(n_frames).integers(-20000, 20000, n_frames * channels).astype({2: "<i2", 4: "<i4"}[width]).tobytes()
    fmt = struct.pack("<4sLHHLLHH", b"fmt ", 16, 1, channels, rate, rate * channels * width, channels * width, 8 * width)
    more = struct.pack("<4sL", b"LIST", len(junk)) + junk + b"\0" * (len(junk) % 2) if junk else b""
    body = b"WAVE" + fmt + more + struct.pack("<4sL", b"data", len(samples)) + samples
    whole = b"RIFF" + struct.pack("<L", len(body)) + body
    path.write_bytes(whole[: len(whole) - cut])


def test_long_file_in_parts_gives_the_rows_of_one_task(spark, tmp_path):
    wav_file(tmp_path / "long.wav", 1237)
    wav_file(tmp_path / "wide.wav", 300, width=4, channels=1, junk=b"odd")
    wav_file(tmp_path / "exact.wav", 300)
    wav_file(tmp_path / "empty.wav", 0)
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxJUNK")
    (tmp_path / "short.wav").write_bytes(b"RI")
    wav_file(tmp_path / "bytes.wav", 10)
    raw = bytearray((tmp_path / "bytes.wav").read_bytes())
    raw[34] = 8  # one byte a sample
    (tmp_path / "bytes.wav").write_bytes(bytes(raw))
    name = lambda r: (r["source_id"] or "").rsplit("/", 1)[-1]
    key = lambda r: (name(r), r["event_class"], r["chunk_no"] or 0, r["timestamp"], r["duration"], r["sample_rate"], r["channels"], r["blocksize"], r["data"])
    whole = sorted((key(r) for r in audio_files.read_audio_corpus(spark, str(tmp_path), start_time=5.0).collect() if r["event_class"] != "AudioErrorEvent"), key=str)
    for part_sec in (0.06, 0.3, 100.0):
        rows = audio_files.read_long_audio(spark, str(tmp_path), start_time=5.0, part_sec=part_sec)
        assert sorted((key(r) for r in rows.collect() if r["event_class"] != "AudioErrorEvent"), key=str) == whole
        errors = [r["message"] for r in rows.collect() if r["event_class"] == "AudioErrorEvent"]
        assert len(errors) == 3 and any("samples of 1 bytes" in m for m in errors)
    spread = audio_files.read_long_audio(spark, str(tmp_path), part_sec=0.06).filter(F.col("source_id").endswith("long.wav"))
    assert spread.select(F.spark_partition_id()).distinct().count() > 1
