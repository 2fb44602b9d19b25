"""Boundary phrases in texts: candidates, alignment, best matches, running text positions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dictalog.functions import fuzzy
from dictalog.functions.phrases import default_patterns
from dictalog.functions.texts import clean_text, near_pattern, near_word, seam, tokens
from dictalog.operators.slices import KeySlices, neighbour, running

KEY = "source_id"
_ALIGNED = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)


def text_offset_map(texts: DataFrame, slices: KeySlices, order: str = "seq") -> DataFrame:
    """Place of each text in the running text of its source: ``seam`` (0 or 1 space before it), ``start_pos``,
    ``end_pos`` (exclusive). Empty texts are left out: they add nothing to the running text."""
    rows = texts.filter(F.length("text") > 0)
    last_char = F.substring("text", -1, 1)
    prev = neighbour(rows, slices, [order], {"_last": last_char}, forward=False)
    seamed = prev.withColumn("seam", seam(F.coalesce("_last", F.lit("")), F.col("text"))).drop("_last")
    own = (F.col("seam") + F.length("text")).cast("long")
    placed = running(seamed, slices, [order], sums={"end_pos": own})
    return placed.withColumn("start_pos", F.col("end_pos") - F.length("text"))


def concat_search_text(texts: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """Texts of a group joined, with one space where neither side has whitespace. Groups are jobs or drafts."""
    ordered = F.sort_array(F.collect_list(F.struct(order, F.col("text").alias("t"))))
    join = lambda acc, x: F.concat(acc, F.when(seam(acc, x["t"]) == 1, F.lit(" ")).otherwise(F.lit("")), x["t"])
    return texts.groupBy(*by).agg(F.aggregate(ordered, F.lit(""), join).alias("search_text"))


def assemble_text(segments: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """Segments of a transcription job joined by a space, with runs of whitespace collapsed."""
    ordered = F.sort_array(F.collect_list(F.struct(order, F.col("text").alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["t"]), " ")
    return segments.groupBy(*by).agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("text"))


def has_text(segments: Column) -> Column:
    """Some segment, and not just one '[BLANK_AUDIO]'."""
    blank = (F.size(segments) == 1) & (F.get(segments, F.lit(0)) == "[BLANK_AUDIO]")
    return (F.size(segments) > 0) & ~blank


def drop_blank_audio(jobs: DataFrame, segments: str = "segments") -> DataFrame:
    """Jobs that produced text."""
    return jobs.filter(has_text(F.col(segments)))


def pattern_candidates(texts: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """Patterns that can occur in a text: their first word is a word of the text and all required words are near one.

    An equi join on the first word replaces pairing every text with every pattern. The pattern table is a parameter of a
    few hundred rows and is broadcast.
    """
    firsts = patterns.withColumn("_first", F.split("phrase", " ")[0])
    listed = firsts.select("_first", "required").collect()  # the pattern list
    heads = sorted({r[0] for r in listed})
    wanted = sorted({q for r in listed for q in r[1]})
    words = texts.withColumn("_words", F.array_distinct(tokens(F.col(text))))
    near = F.filter(_strings(wanted), lambda q: F.exists("_words", lambda w: near_word(w, q)))
    split = words.withColumn("_first", F.array_intersect("_words", _strings(heads))).filter(F.size("_first") > 0)
    split = split.withColumn("_near", near).drop("_words").withColumn("_first", F.explode("_first"))
    joined = split.join(F.broadcast(firsts), "_first").filter(F.size(F.array_except("required", "_near")) == 0)
    return joined.drop("_first", "_near")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def exact_candidates(texts: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """Leftmost exact occurrence of each pattern in the cleaned text, with its place there and score 100."""
    cleaned = clean_text(F.col(text))
    found = pattern_candidates(texts.withColumn("_clean", cleaned), patterns, text)
    found = found.withColumn("_at", F.expr("locate(trim(phrase), _clean)"))
    return (
        found.filter(F.col("_at") > 0)
        .withColumns(
            {
                "m_start": (F.col("_at") - 1).cast("long"),
                "m_end": (F.col("_at") - 1 + F.length(F.trim("phrase"))).cast("long"),
                "score": F.lit(100.0),
            }
        )
        .drop("_at", "_clean")
    )


def scored_candidates(texts: DataFrame, patterns: list[fuzzy.Pattern] | None = None, text: str = "text") -> DataFrame:
    """Every pattern that scores in a text, with its best place in the cleaned text and that score.

    Each pattern is aligned with every window of the text, misspelt ones too; texts without a plausible boundary word never
    reach Python.
    """
    wanted = patterns or default_patterns()

    def scan(batches: Iterator) -> Iterator:
        matcher = fuzzy.PhraseMatcher(wanted)
        for pdf in batches:
            found = [matcher.best_per_pattern(t) for t in pdf["_clean"]]
            pdf["_m"] = [[(m.kind, m.phrase, m.start, m.end, m.score) for m in hits] for hits in found]
            yield pdf

    rows = dealt(texts.withColumn("_clean", clean_text(F.col(text))).filter(may_hold_boundary(F.col(text), wanted)))
    schema = widen(rows.schema, _m=T.ArrayType(T.StructType(MATCH_FIELDS)))
    return rows.mapInPandas(scan, schema).select(*texts.columns, F.explode("_m").alias("_x")).select(
        *texts.columns,
        F.col("_x.kind").alias("kind"),
        F.trim("_x.phrase").alias("phrase"),
        F.col("_x.start").cast("long").alias("m_start"),
        F.col("_x.end").cast("long").alias("m_end"),
        F.col("_x.score").alias("score"),
    )


def best_match_per_pattern(candidates: DataFrame, text_key: str) -> DataFrame:
    """Highest score, then leftmost start, then longest, per text and pattern."""
    best = F.min_by(
        F.struct("kind", "m_start", "m_end", "score"),
        F.struct((-F.col("score")).alias("s"), F.col("m_start"), (-F.col("m_end")).alias("e")),
    )
    return candidates.groupBy(text_key, "phrase").agg(best.alias("b")).select(text_key, "phrase", "b.*")


def best_match_overall(best: DataFrame, text_key: str) -> DataFrame:
    """Across patterns: earliest end, then highest score; a longer match from the same start with at least the same
    score wins. A group has one row per pattern."""
    m = F.struct("m_start", "m_end", "score", "kind", "phrase")
    lead_order = F.struct("m_end", (-F.col("score")).alias("s"), "m_start", "kind", "phrase")
    lead = best.groupBy(text_key).agg(F.min_by(m, lead_order).alias("lead"), F.collect_list(m).alias("all"))
    rivals = F.filter(
        "all", lambda x: (x["m_start"] == F.col("lead.m_start")) & (x["score"] >= F.col("lead.score"))
    )
    ranked = F.transform(
        rivals,
        lambda x: F.struct((-x["m_end"]).alias("a"), (-x["score"]).alias("b"), x["kind"].alias("c"), x["phrase"].alias("d"), x.alias("x")),
    )
    return lead.select(text_key, F.array_min(ranked)["x"].alias("x")).select(text_key, "x.*")


def partial_align(phrase: str | Column, text: str | Column) -> Column:
    """Struct (score, start, end): best indel ratio of the phrase with any part of the text no longer than the phrase."""
    return _partial_align(phrase, text)


@F.pandas_udf(_ALIGNED)
def _partial_align(phrase, text):
    import pandas as pd

    made: dict[str, fuzzy.PhraseMatcher] = {}
    out = []
    for p, t in zip(phrase, text):
        hit = None
        if p and t:
            if p not in made:
                made[p] = fuzzy.PhraseMatcher([fuzzy.Pattern("start", p)])
            hit = next(iter(made[p].best_per_pattern(t)), None)
        out.append((hit.score, hit.start, hit.end) if hit else (None, None, None))
    return pd.DataFrame(out, columns=["score", "start", "end"]).astype(
        {"score": "float64", "start": "Int32", "end": "Int32"}
    )


@F.pandas_udf(T.DoubleType())
def indel_ratio(a, b):
    import pandas as pd

    return pd.Series([fuzzy.indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def indel_ratio_from(minimum: float):
    """``indel_ratio`` where it reaches ``minimum``, else null: texts that differ little, or far too much, cost little."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a, b):
        import pandas as pd

        return pd.Series([fuzzy.indel_ratio(x, y, minimum) for x, y in zip(a, b)], dtype="float64")

    return ratio


MATCH_FIELDS = [
    T.StructField("kind", T.StringType()),
    T.StructField("phrase", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
]


def widen(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    """A copy of a schema with more fields."""
    return T.StructType(schema.fields + [T.StructField(n, t) for n, t in fields.items()])


def all_matches(texts: DataFrame, patterns: list[fuzzy.Pattern] | None = None, text: str = "text") -> DataFrame:
    """Table-valued matcher: one row per text and boundary in it, in order.

    Texts without a plausible boundary word are dropped on the JVM side before any row goes to Python.
    """
    wanted = patterns or default_patterns()

    def scan(batches: Iterator) -> Iterator:
        matcher = fuzzy.PhraseMatcher(wanted)
        for pdf in batches:
            pdf["_m"] = [_match_list(matcher, t) for t in pdf[text]]
            yield pdf

    schema = widen(texts.schema, _m=T.ArrayType(T.StructType(MATCH_FIELDS)))
    found = dealt(texts.filter(may_hold_boundary(F.col(text), wanted))).mapInPandas(scan, schema)
    return found.select(*texts.columns, F.posexplode("_m").alias("match_no", "_x")).select(
        *texts.columns,
        "match_no",
        F.col("_x.kind").alias("kind"),
        F.col("_x.start").alias("m_start"),
        F.col("_x.end").alias("m_end"),
        F.col("_x.score").alias("score"),
    )


def _match_list(matcher: fuzzy.PhraseMatcher, text: str) -> list[dict]:
    out, at = [], 0
    while (hit := matcher.match_first(text[at:])) is not None:
        lo, hi = fuzzy.snap(text[at:], hit)
        out.append({"kind": hit.kind, "phrase": hit.phrase, "start": at + lo, "end": at + hi, "score": hit.score})
        at += hi
    return out


def match_first(texts: DataFrame, patterns: list[fuzzy.Pattern] | None = None, text: str = "text") -> DataFrame:
    """The first boundary of each text (rows without one are dropped), before it is snapped to whole words."""
    wanted = patterns or default_patterns()

    def scan(batches: Iterator) -> Iterator:
        matcher = fuzzy.PhraseMatcher(wanted)
        for pdf in batches:
            hits = [matcher.match_first(t) for t in pdf[text]]
            pdf = pdf.assign(
                kind=[h.kind if h else None for h in hits],
                m_start=[h.start if h else -1 for h in hits],
                m_end=[h.end if h else -1 for h in hits],
                score=[h.score if h else -1.0 for h in hits],
            )
            yield pdf[pdf["m_start"] >= 0]

    schema = widen(
        texts.schema, kind=T.StringType(), m_start=T.IntegerType(), m_end=T.IntegerType(), score=T.DoubleType()
    )
    return dealt(texts.filter(may_hold_boundary(F.col(text), wanted))).mapInPandas(scan, schema)


def may_hold_boundary(text: Column, patterns: list[fuzzy.Pattern]) -> Column:
    """Necessary condition for any pattern to match, as a JVM expression.

    For patterns with required words, some word near the pattern's first required word; for the others, a stretch of the text that is nearly all of the
    phrase's own characters.
    """
    anchors = sorted({clean_required(p.required[0]) for p in patterns if p.required})
    bare = sorted({fuzzy.normal(p.phrase) for p in patterns if not p.required})
    tests = []
    cleaned = clean_text(text)
    if anchors:
        near = near_pattern(anchors)
        tests.append(cleaned.rlike(near) if near else F.exists(tokens(text), lambda w: _any(near_word(w, F.lit(a)) for a in anchors)))
    tests += [_dense(cleaned, fuzzy.Dense.of(p, fuzzy.RATIO_MIN)) for p in bare]
    return _any(tests)


def _dense(cleaned: Column, d: fuzzy.Dense) -> Column:
    """Some stretch has ``least`` own characters with ``foreign`` others between at most: neighbouring runs of own characters are long enough together."""
    runs = F.transform(F.split(cleaned, d.others, -1), F.length)
    near = lambda i: F.aggregate(F.slice(runs, i, F.lit(d.foreign + 1)), F.lit(0), lambda t, n: t + n)
    return cleaned.rlike(d.run) & F.exists(F.sequence(F.lit(1), F.size(runs)), lambda i: near(i) >= d.least)


def dealt(rows: DataFrame) -> DataFrame:
    """For a costly step on few large splits: a table in fewer of them than there are cores is dealt out, any other stays where it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.isStreaming or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)


def clean_required(word: str) -> str:
    return fuzzy.clean_with_map(word)[0]


def _any(tests) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out | t
    return F.lit(False) if out is None else out


def draft_spans(markers: DataFrame, slices: KeySlices, order: list[str]) -> DataFrame:
    """Drafts from boundary markers (column ``marker`` start/end, others null).

    A start opens; the next marker, start or end, closes; an end without an open draft is ignored; a draft that nothing
    closes is a forced end. Returns the opening row's columns and those of the closing marker (``end_*``).
    """
    only = markers.filter(F.col("marker").isNotNull())
    fields = {f"end_{c}": F.col(c) for c in markers.columns if c != slices.key}
    paired = neighbour(only, slices, order, fields)
    return paired.filter(F.col("marker") == "start").withColumn("forced", F.col("end_marker").isNull())


def classify_draft_event(drafts: DataFrame) -> DataFrame:
    """Start events have no end text yet."""
    cls = F.when(F.col("end_text").isNull(), "DraftStartEvent").otherwise("DraftEndEvent")
    return drafts.withColumn("event_class", cls)
