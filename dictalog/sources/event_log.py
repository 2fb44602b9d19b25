"""The event log as JSON lines: reader (batch and stream), writer, and recorder files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dictalog import schema
from dictalog.operators.events import dedup_events


def class_name(spelled: Column) -> Column:
    """Bare class name from either wire spelling, ``<class 'a.b.Name'>`` or ``Name``."""
    return F.regexp_extract(spelled, r"([A-Za-z_]\w*)(?:'>)?\s*$", 1)


def decode_events(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Typed rows and quarantined lines. A line is quarantined (``line``, ``reason``) if it is not JSON or its class is
    unknown."""
    parsed = lines.withColumn(
        "_e",
        F.from_json(column, schema.WIRE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}),
    )
    cls = class_name(F.col("_e.event_class"))
    bad_json = F.col("_e").isNull() | F.col("_e._malformed").isNotNull()
    known = F.coalesce(cls.isin(schema.DECODABLE), F.lit(False))
    reason = F.when(bad_json, "malformed").when(~known, "unknown_class")
    tagged = parsed.withColumn("_reason", reason)
    fields = [f.name for f in schema.WIRE.fields if f.name not in ("event_class", "_malformed")]
    good = tagged.filter(F.col("_reason").isNull()).select(
        cls.alias("event_class"), *[F.col(f"_e.{f}").alias(f) for f in fields]
    )
    bad = tagged.filter(F.col("_reason").isNotNull()).select(F.col(column).alias("line"), F.col("_reason").alias("reason"))
    return good, bad


def read_event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return decode_events(spark.read.text(path))


def read_event_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The good events of a growing folder of JSON lines. Any source with a string column works with
    ``decode_events``, Kafka for instance."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return decode_events(lines)[0]


def subscribe_stream(events: DataFrame, audio_only: bool = True) -> DataFrame:
    """What a listener asks for: the audio classes, or also text and draft events."""
    classes = schema.AUDIO_CLASSES if audio_only else schema.SUBSCRIBABLE
    return events.filter(F.col("event_class").isin(classes))


def encode_events(events: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One JSON line per event (column ``value``), the class first, nulls kept."""
    names = fields or [c for c in events.columns if c != "event_class"]
    return events.select(
        F.to_json(F.struct("event_class", *names), {"ignoreNullFields": "false"}).alias("value")
    )


def write_event_log(events: DataFrame, path: str, mode: str = "append") -> None:
    encode_events(events).write.mode(mode).text(path)


TEXT_FIELDS = "event_id STRING, text STRING, timestamp DOUBLE, audio_source_id STRING, audio_start_time DOUBLE, audio_end_time DOUBLE"
RECORDS = (
    "classname STRING, properties STRUCT<"
    f"{', '.join(f.replace(' ', ': ', 1) for f in TEXT_FIELDS.split(', '))}, "
    f"text_event: STRUCT<properties: STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in TEXT_FIELDS.split(', '))}>, "
    f"{', '.join(f.replace(' ', ': ', 1) for f in TEXT_FIELDS.split(', '))}>, "
    f"attention_text_event: STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in TEXT_FIELDS.split(', '))}>>"
)


def read_block_records(spark: SparkSession, path: str) -> DataFrame:
    """Text events of recorder files (one JSON array per file), also those nested in command events."""
    rows = spark.read.schema(RECORDS).option("multiLine", True).json(path)
    placed = rows.select("*", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("pos"))
    return nested_text_events(placed, ["_file", "pos"])


def nested_text_events(records: DataFrame, order_by: list[str]) -> DataFrame:
    """First text event per id over three paths: the event itself, a command's text, a command's attention text."""
    names = [f.split(" ")[0] for f in TEXT_FIELDS.split(", ")]
    plain = F.col("classname").contains("TextEvent") & ~F.col("classname").contains("ScribeCommandEvent")
    command = F.col("classname").contains("ScribeCommandEvent")
    p = F.col("properties")
    inner = F.coalesce(p["text_event"]["properties"], F.struct(*[p["text_event"][n].alias(n) for n in names]))
    own = F.struct(*[p[n].alias(n) for n in names])
    path = lambda use, no, s: F.struct(F.when(use, s).alias("e"), F.lit(no).alias("path_no"))
    found = records.select(
        *order_by,
        F.explode(
            F.array(path(plain, 0, own), path(command, 1, inner), path(command, 2, p["attention_text_event"]))
        ).alias("x"),
    )
    flat = found.filter(F.col("x.e.event_id").isNotNull()).select(
        F.col("x.e.event_id").alias("event_id"),
        *[F.col(f"x.e.{n}").alias(n) for n in names if n != "event_id"],
        F.col("x.path_no").alias("path_no"),
        *order_by,
    )
    return dedup_events(flat, "event_id", [*order_by, "path_no"])
