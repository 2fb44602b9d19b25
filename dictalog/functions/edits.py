"""Prompts for, and replies from, a user-supplied editing model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUGGESTIONS = (
    "full_text STRING, "
    "parts ARRAY<STRUCT<start: INT, `end`: INT, suggestions: ARRAY<STRUCT<"
    "action: STRING, confidence: DOUBLE, reason: STRING, new_text: STRING>>>>, "
    "suggestions ARRAY<STRUCT<old_text: STRING, new_text: STRING, confidence: DOUBLE, reason: STRING>>, "
    "_malformed STRING"
)

VERSIONS = ["v2", "v3_concise", "v4"]
DEFAULT_VERSION = "v4"
HEAD = "\n\n--- Text ---\n\n"
TASK = "\n\n--- Reply ---\n\nList your changes to the text as one JSON object.\n"


def edit_prompt(full_text: Column, preambles: dict[str, str], version: str = DEFAULT_VERSION, head: str = HEAD, task: str = TASK) -> Column:
    """Preamble, draft and task in one text. An unknown version means the default one."""
    wanted = version if version in VERSIONS else DEFAULT_VERSION
    return F.concat(F.lit(preambles[wanted]), F.lit(head), full_text, F.lit(task))


def parse_suggestions(replies: DataFrame, reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Split model replies into one row per suggestion and the malformed replies.

    Both reply shapes are read: a flat list with old and new text, and parts with their own suggestions.
    """
    parsed = replies.withColumn(
        "_r", F.from_json(reply, SUGGESTIONS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    )
    broken = F.col("_r").isNull() | F.col("_r._malformed").isNotNull() | (
        F.col("_r.suggestions").isNull() & F.col("_r.parts").isNull()
    )
    flat = F.transform(
        F.coalesce("_r.suggestions", F.array()),
        lambda s: F.struct(
            F.lit("replace").alias("action"),
            s["old_text"].alias("old_text"),
            s["new_text"].alias("new_text"),
            s["confidence"].alias("confidence"),
            s["reason"].alias("reason"),
        ),
    )
    text = F.col("_r.full_text")
    nested = F.flatten(
        F.transform(
            F.coalesce("_r.parts", F.array()),
            lambda p: F.transform(
                F.coalesce(p["suggestions"], F.array()),
                lambda s: F.struct(
                    s["action"].alias("action"),
                    F.substring(text, p["start"] + 1, p["end"] - p["start"]).alias("old_text"),
                    s["new_text"].alias("new_text"),
                    s["confidence"].alias("confidence"),
                    s["reason"].alias("reason"),
                ),
            ),
        )
    )
    good = (
        parsed.filter(~broken)
        .select(*replies.columns, F.posexplode(F.concat(flat, nested)).alias("suggestion_no", "_s"))
        .select(*[c for c in replies.columns if c != reply], "suggestion_no", "_s.*")
    )
    return good, parsed.filter(broken).select(*replies.columns)


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.9, "certain")
        .when(confidence >= 0.7, "high")
        .when(confidence >= 0.5, "moderate")
        .when(confidence.isNotNull(), "low")
    )
