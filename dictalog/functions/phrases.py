"""The default boundary phrases, and phrase tables as DataFrames."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession

from dictalog.functions.fuzzy import Pattern

# The spoken names and the words that open and close a draft.
NAMES = ["freddy", "rupert"]
PREAMBLES = ["", "hey ", "wake up "]
GLUE = ["", "a ", "the ", "uh "]
OPEN_VERBS = ["start", "new"]
CLOSE_VERBS = ["stop", "close", "end"]
OBJECT = "draft"
OPEN_PHRASES = [("take this down", [])]
CLOSE_PHRASES = [
    ("break break", ["break"]),
    ("great great", ["great"]),
    ("stop stop", ["stop"]),
    ("stop now", ["stop"]),
]
BARE_CLOSE = ["break break break", "great great great", "stop stop stop"]


def default_patterns() -> list[Pattern]:
    """98 start and 47 end phrases, generated from the word lists."""
    found: list[Pattern] = []
    for name in NAMES:
        found += [Pattern("start", f"{name} {p}", (name, *req)) for p, req in OPEN_PHRASES]
        found += [Pattern("end", f"{name} {p}", (name, *req)) for p, req in CLOSE_PHRASES]
        for pre, tail in product(PREAMBLES, ["", " now"]):
            found += [
                Pattern("start", f"{pre}{name} {verb} {glue}{OBJECT}{tail}", (name, OBJECT, verb))
                for glue, verb in product(GLUE, OPEN_VERBS)
            ]
            found += [Pattern("end", f"{pre}{name} {verb} {OBJECT}{tail}", (name, OBJECT, verb)) for verb in CLOSE_VERBS]
    return found + [Pattern("end", p) for p in BARE_CLOSE]


def patterns_frame(spark: SparkSession, patterns: list[Pattern] | None = None) -> DataFrame:
    """One short row per phrase: kind, phrase, required words, position in the list."""
    rows = [(p.kind, p.phrase, list(p.required), i) for i, p in enumerate(patterns or default_patterns())]
    return spark.createDataFrame(rows, "kind STRING, phrase STRING, required ARRAY<STRING>, ord INT")
