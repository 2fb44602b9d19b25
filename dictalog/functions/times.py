"""Time parsing and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain decimal numbers only: 'nan', 'inf' and '1_0' are not times.
_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,6})?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def parse_timestamp(text: Column) -> Column:
    """Epoch seconds from a number or an ISO time (no zone means UTC); null if it is neither."""
    as_time = F.when(text.rlike(_ISO), F.unix_micros(text.try_cast("timestamp")) / F.lit(1e6))
    return F.when(text.rlike(_NUMBER), text.try_cast("double")).otherwise(as_time)


def parse_error(text: Column) -> Column:
    """Message for a value that ``parse_timestamp`` cannot read, else null."""
    return F.when(
        parse_timestamp(text).isNull(),
        F.concat(F.lit("Invalid timestamp format: '"), F.coalesce(text, F.lit("")), F.lit("'")),
    )


def format_timestamp(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def time_ago(seconds: Column, now: Column) -> Column:
    """Elapsed time in the largest whole unit, truncated towards zero."""
    gone = now - seconds

    def whole(unit: int, suffix: str) -> Column:
        return F.concat((gone / unit).cast("bigint").cast("string"), F.lit(f"{suffix} ago"))

    return (
        F.when(gone < 60, whole(1, "s"))
        .when(gone < 3600, whole(60, "m"))
        .when(gone < 86400, whole(3600, "h"))
        .when(gone.isNotNull(), whole(86400, "d"))
    )


def draft_dir(seconds: Column) -> Column:
    """Folder name of a draft's files."""
    return F.concat(F.lit("draft-"), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd_HH-mm-ss-SSSSSS"))


def source_uri(ip: Column, port: Column, kind: Column, start: Column, prefix: str = "dictalog") -> Column:
    stamp = F.date_format(start, "yyyy-MM-dd'T'HHmmss")
    return F.format_string(f"ase://%s:%d/{prefix}/audio_source/%s/%s", ip, port, kind, stamp)


def parse_source_uri(uri: Column) -> Column:
    """Struct of the parts of a source uri; parts are null if the uri is malformed."""
    pattern = r"^ase://([^:/]+):([0-9]+)/(.+/)?audio_source/([^/]+)/([^/]+)$"

    def part(i: int) -> Column:
        return F.when(uri.rlike(pattern), F.regexp_extract(uri, pattern, i))

    start = F.try_to_timestamp(part(5), F.lit("yyyy-MM-dd'T'HHmmss"))
    return F.struct(
        part(1).alias("ip"), part(2).cast("int").alias("port"), part(4).alias("kind"), start.alias("start")
    )
