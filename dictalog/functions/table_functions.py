"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from dictalog.functions import fuzzy
from dictalog.functions.phrases import default_patterns

MATCHES = "match_no INT, kind STRING, phrase STRING, m_start INT, m_end INT, score DOUBLE"


def register_all_matches(spark: SparkSession, patterns: list[fuzzy.Pattern] | None = None, name: str = "all_matches") -> None:
    """Register ``name(text)`` for use in ``LATERAL``: the boundaries of a text in order, by the given phrases. A text without one gives no row."""
    wanted = patterns or default_patterns()

    class AllMatches:
        def __init__(self):
            self.matcher = fuzzy.PhraseMatcher(wanted)

        def eval(self, text: str) -> Iterator[tuple]:
            at = number = 0
            while text and (hit := self.matcher.match_first(text[at:])) is not None:
                low, high = fuzzy.snap(text[at:], hit)
                yield number, hit.kind, hit.phrase, at + low, at + high, hit.score
                at, number = at + high, number + 1

    spark.udtf.register(name, udtf(AllMatches, returnType=MATCHES))


def register_phrase_table(spark: SparkSession, table: str, name: str = "all_matches") -> None:
    """The same with the phrases of a table (kind, phrase, required): a parameter of a few hundred rows."""
    rows = spark.table(table).select("kind", "phrase", "required").collect()
    register_all_matches(spark, [fuzzy.Pattern(r["kind"], r["phrase"], tuple(r["required"] or ())) for r in rows], name)
