"""Audio to drafts to revisions, with a transcriber that reads the text out of the samples."""

from pyspark.sql import functions as F

from dictalog.operators import drafts as D
from dictalog.plans import flows
from dictalog.session import shared_dir
from dictalog.sources import sinks

RATE, PER_CHUNK = 1000, 10  # one character per millisecond sample, 10 ms chunks


def spoken(source, pieces):
    """Chunks whose samples are the characters of the text, with pauses between the pieces."""
    rows, at = [], 0
    for text in pieces:
        for i in range(0, len(text), PER_CHUNK):
            part = text[i : i + PER_CHUNK].ljust(PER_CHUNK)
            rows.append((source, at, at * 10_000, [ord(c) / 1000 for c in part], PER_CHUNK, RATE, 0.9))
            at += 1
        for _ in range(12):
            rows.append((source, at, at * 10_000, [0.0] * PER_CHUNK, PER_CHUNK, RATE, 0.1))
            at += 1
    return rows


SCHEMA = "source_id STRING, chunk_id BIGINT, ts_us BIGINT, data ARRAY<FLOAT>, n_samples INT, sample_rate INT, speech_score DOUBLE"


def reader(mark=""):
    def make():
        def hear(samples, rate, prompt):
            text = "".join(chr(round(float(x) * 1000)) for x in samples if x > 0).strip()
            return [text.replace("wrold", "world") if mark else text] if text else ["[BLANK_AUDIO]"]

        return hear

    return make


def test_audio_to_drafts_and_rescan(spark):
    rows = spoken("mic-1", ["hello there ", "Freddy take this down. hello wrold ", "and more. Freddy break break. "])
    rows += spoken("mic-2", ["Freddy take this down. never closed "])
    chunks = spark.createDataFrame(rows, SCHEMA)
    drafts = flows.audio_to_drafts(
        chunks, reader(), silence_us=40_000, pad_us=10_000, batch_samples=400, prebuffer_us=20_000
    ).cache()
    got = {(r["source_id"], " ".join(r["full_text"].split()), r["forced"]) for r in drafts.collect()}
    assert got == {("mic-1", "hello wrold and more.", False), ("mic-2", "never closed", True)}

    path = shared_dir(spark, "flow")
    stored = drafts.withColumn("timestamp", F.col("audio_start_time")).withColumn("parent_draft_id", F.lit(None).cast("string"))
    assert sinks.append_drafts(stored, path, ["timestamp", "draft_id"]).count() == 0
    spans = drafts.select(
        "source_id", "draft_id", (F.col("audio_start_time") * 1e6).cast("long").alias("start_us"),
        (F.col("audio_end_time") * 1e6).cast("long").alias("stop_us"),
    )
    revisions = flows.rescan(spans, chunks, reader("better"), batch_samples=600, bin_us=1_000_000)
    assert sinks.append_drafts(D.import_revision(revisions), path, ["timestamp", "draft_id"]).count() == 0
    pairs = D.revision_similarity(D.pair_rescans(sinks.read_drafts(spark, path)), 75.0).collect()
    texts = {" ".join(r["revision_text"].split()) for r in pairs}
    assert "hello world and more." in texts and all(r["score"] >= 75 for r in pairs)
