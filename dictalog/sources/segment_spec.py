"""Scripts of spoken segments: reading, checking, time line, assembled audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dictalog.functions.samples import silence
from dictalog.operators.slices import KeySlices, running

SPEC = "segments STRING"
SEGMENT = "text STRING, silence_after STRING"


def segment_error(text: Column, silence_after: Column) -> Column:
    """Error code of one segment, or null: missing_text, missing_silence, bad_silence, negative_silence."""
    number = silence_after.try_cast("double")
    return (
        F.when(text.isNull(), "missing_text")
        .when(silence_after.isNull(), "missing_silence")
        .when(number.isNull(), "bad_silence")
        .when(number < 0, "negative_silence")
    )


def read_segment_spec(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good segments (spec_id, seg_no, text, silence_after) and errors (spec_id, seg_no, error).

    A file without a non-empty segment list is one error row; one bad segment does not spoil the others of its file.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("spec_id"), "value")
    body = F.get_json_object("value", "$.segments")
    listed = raw.select("spec_id", body.alias("_body"), F.from_json(body, "ARRAY<STRING>").alias("_list"))
    bare = listed.select(
        "spec_id",
        F.lit(None).cast("int").alias("seg_no"),
        F.when(F.col("_body").isNull(), "no_segments")
        .when(F.col("_list").isNull(), "segments_not_a_list")
        .when(F.size("_list") == 0, "empty_segments")
        .alias("error"),
    ).filter(F.col("error").isNotNull())
    items = listed.select("spec_id", F.posexplode("_list").alias("seg_no", "_json"))
    quoted = F.col("_json").rlike(r'"text"\s*:\s*"')
    number = F.col("_json").rlike(r'"silence_after"\s*:\s*-?[0-9.]')
    text = F.get_json_object("_json", "$.text")
    wait = F.get_json_object("_json", "$.silence_after")
    error = (
        F.when(~F.col("_json").startswith("{"), "not_an_object")
        .when(text.isNull(), "missing_text")
        .when(~quoted, "bad_text")
        .when(wait.isNotNull() & ~number, "bad_silence")
        .otherwise(segment_error(text, wait))
    )
    checked = items.select("spec_id", "seg_no", text.alias("text"), wait.try_cast("double").alias("silence_after"), error.alias("error"))
    bad = checked.filter(F.col("error").isNotNull()).select("spec_id", "seg_no", "error")
    return checked.filter(F.col("error").isNull()).drop("error"), bare.unionByName(bad)


def spec_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("silence_after").alias("total_silence")
    )


def timeline(segments: DataFrame, slices: KeySlices, duration: str) -> DataFrame:
    """Start of each segment: everything before it, spoken and silent."""
    own = F.col(duration) + F.col("silence_after")
    return running(segments, slices, ["seg_no"], sums={"start_at": own}, inclusive=False)


def concat_audio(clips: DataFrame, by: str, order: str, part_size: int = 256) -> tuple[DataFrame, DataFrame]:
    """Audio of a script: its clips in order, each followed by its silence; and the scripts that mix rates or channels.

    ``clips(<by>, <order>, data, sample_rate, channels, silence_after)``. The audio comes in parts (``part_no``) of
    ``part_size`` clips, so that no group grows with the length of a script; most scripts have one part.
    """
    formats = clips.groupBy(by).agg(
        (F.min("sample_rate") != F.max("sample_rate")).alias("_rates"),
        (F.min("channels") != F.max("channels")).alias("_channels"),
    )
    reason = F.when(F.col("_rates"), "sample_rate_mismatch").otherwise("channel_mismatch")
    errors = formats.filter(F.col("_rates") | F.col("_channels")).select(by, reason.alias("error"))
    padded = append_silence(F.col("data"), F.col("silence_after"), F.col("sample_rate"))
    ordered = F.sort_array(F.collect_list(F.struct(order, padded.alias("p"))))
    good = clips.join(errors, by, "left_anti").withColumn("part_no", F.floor(F.col(order) / part_size))
    return (
        good.groupBy(by, "part_no").agg(
            F.flatten(F.transform(ordered, lambda c: c["p"])).alias("data"), F.max("sample_rate").alias("sample_rate")
        ),
        errors,
    )


def append_silence(data: Column, seconds: Column, rate: Column) -> Column:
    return F.concat(data, silence(F.greatest(seconds, F.lit(0)), rate))
