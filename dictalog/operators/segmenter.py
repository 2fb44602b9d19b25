"""Texts to drafts in batch, without walking a source row by row.

Each text is looked at together with the last characters of the texts before it, and the required words heard in the
last seconds, so boundary phrases are found with bounded memory, and within a hot source in parallel. Boundaries then open and close drafts by looking at the next
boundary, and the texts, cut at the boundaries, are put together per draft. The streaming form in
``streaming.segmenter`` gives the same drafts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dictalog.functions.fuzzy import SPACES, Match, Pattern, PhraseMatcher, clean_with_map, snap
from dictalog.functions.phrases import default_patterns
from dictalog.functions.texts import clean_text, near_pattern, near_word
from dictalog.operators.matching import KEY, MATCH_FIELDS, draft_spans, may_hold_boundary, text_offset_map, widen
from dictalog.operators.ranges import overlap_join
from dictalog.operators.slices import KeySlices, neighbour, plan_slices, row_numbers, running
from dictalog.session import materialize

CONTEXT = 68  # least number of characters carried over: twice the longest default phrase
EXPIRY_S = 20.0
FORCED = "forced end"
PART_CHARS = 16_000_000

_FOUND = T.ArrayType(T.StructType(MATCH_FIELDS + [T.StructField("text", T.StringType())]))


def context_width(patterns: list[Pattern]) -> int:
    """Characters carried over: twice the longest phrase, which leaves room for punctuation."""
    return max([CONTEXT, *(2 * len(clean_with_map(p.phrase)[0]) for p in patterns)])


def add_heard(texts: DataFrame, slices: KeySlices, order: str, patterns: list[Pattern], expiry_s: float) -> DataFrame:
    """Add ``heard``: the required words of the texts before each row that are not older than ``expiry_s`` when it arrives,
    each with the place in the running text of the last word near it."""
    required = sorted({q for p in patterns for q in p.required})
    none = F.array().cast("array<struct<word: string, at: bigint>>")
    if not required:
        return texts.withColumn("heard", none)
    words = F.split("text", f"[{SPACES}]", -1)
    rows = texts.withColumns({"_w": words, "_clean": F.transform(words, clean_text)})

    def last_near(q: str) -> Column:
        last = F.array_max(F.transform("_clean", lambda w, n: F.when(near_word(w, F.lit(q)), n)))
        some = near_pattern([q])  # most texts have no such word at all
        return F.when(clean_text(F.col("text")).rlike(some), last) if some else last

    last = {f"_n{i}": last_near(q) for i, q in enumerate(required)}
    rows = rows.withColumns(last)

    def place(n: Column) -> Column:
        before = F.length(F.array_join(F.slice("_w", F.lit(1), n), " ")) + F.when(n > 0, 1).otherwise(0)
        return F.when(n.isNotNull(), F.struct((F.col("start_pos") + before).alias("at"), F.col("audio_end_time").alias("t")))

    rows = rows.withColumns({f"_h{i}": place(F.col(f"_n{i}")) for i in range(len(required))}).drop("_w", "_clean", *last)
    got = running(rows, slices, [order], lasts={f"_b{i}": F.col(f"_h{i}") for i in range(len(required))}, inclusive=False)
    fresh = lambda i: F.col("audio_end_time") - F.col(f"_b{i}.t") <= expiry_s
    each = [F.when(fresh(i), F.struct(F.lit(q).alias("word"), F.col(f"_b{i}.at").alias("at"))) for i, q in enumerate(required)]
    heard = F.filter(F.array(*each), lambda x: x.isNotNull()).cast("array<struct<word: string, at: bigint>>")
    return got.withColumn("heard", heard).select(*texts.columns, "heard")


def add_context(texts: DataFrame, slices: KeySlices, order: str, expiry_s: float, width: int = CONTEXT) -> DataFrame:
    """Add ``ctx``: the last ``width`` characters of the running text before each row (with its seam).

    Text that is older than ``expiry_s`` when the row arrives is not carried. The tail doubles its reach in each
    round, so ``log2(width)`` rounds over the same partitioning cover ``width`` one-character rows.
    """
    pad = F.when(F.col("seam") == 1, F.lit(" ")).otherwise(F.lit(""))
    gap = F.col("audio_end_time") - F.col("_prev_end") > expiry_s
    rows = neighbour(texts, slices, [order], {"_prev_end": F.col("audio_end_time")}, forward=False)
    rows = rows.withColumns(
        {"_stale": F.coalesce(gap, F.lit(True)), "_tail": F.substring(F.concat(pad, F.col("text")), -width, width)}
    ).withColumn("_cut", F.col("_stale"))
    rows = rows.drop("_prev_end")
    if not slices.trivial:
        rows = materialize(slices.tag(rows), "context")
        rows = _doubled(rows, [slices.key, "_slice"], order, width)
        rows = _across_slices(rows, slices, order, width).drop("_slice")
    else:
        rows = _doubled(rows, [slices.key], order, width)
    before = neighbour(rows, slices, [order], {"_ctx": F.col("_tail")}, forward=False)
    ctx = F.when(F.col("_stale"), F.lit("")).otherwise(F.concat(F.coalesce("_ctx", F.lit("")), pad))
    return before.withColumn("ctx", F.substring(ctx, -width, width)).drop("_ctx", "_tail", "_cut", "_stale")


def _doubled(rows: DataFrame, by: list[str], order: str, width: int) -> DataFrame:
    """Let ``_tail`` reach back over up to ``width`` rows; ``_cut`` says that it must not be prolonged any more."""
    w = Window.partitionBy(*by).orderBy(order)
    packed = F.struct(F.col("_tail").alias("t"), F.col("_cut").alias("c"))
    reach = 1
    while reach < width:
        rows = rows.withColumn("_far", F.lag(packed, reach).over(w))
        stay = F.col("_cut") | F.col("_far").isNull()
        longer = F.substring(F.concat(F.col("_far.t"), F.col("_tail")), -width, width)
        rows = rows.withColumns(
            {
                "_tail": F.when(stay, F.col("_tail")).otherwise(longer),
                "_cut": F.when(stay, F.col("_cut")).otherwise(F.col("_far.c")),
            }
        ).drop("_far")
        reach *= 2
    return rows


def _across_slices(rows: DataFrame, slices: KeySlices, order: str, width: int) -> DataFrame:
    """Prolong tails that reach the start of their slice by the tails of the slices before it (one row per slice)."""
    by = [slices.key, "_slice"]
    last = F.max_by(F.struct(F.col("_tail").alias("t"), F.col("_cut").alias("c")), order)
    ends = rows.join(F.broadcast(slices.cuts.select(slices.key)), slices.key, "left_semi").groupBy(*by).agg(last.alias("l"))
    near = Window.partitionBy(slices.key).orderBy("_slice").rowsBetween(-width, -1)
    fold = F.aggregate(
        F.reverse(F.collect_list("l").over(near)),
        F.struct(F.lit("").alias("t"), F.lit(False).alias("c")),
        lambda acc, x: F.struct(
            F.when(acc["c"], acc["t"]).otherwise(F.concat(x["t"], acc["t"])).alias("t"), (acc["c"] | x["c"]).alias("c")
        ),
    )
    carry = ends.select(*by, F.substring(fold["t"], -width, width).alias("_carry"))
    longer = F.substring(F.concat(F.coalesce("_carry", F.lit("")), F.col("_tail")), -width, width)
    return (
        rows.join(F.broadcast(carry), by, "left")
        .withColumn("_tail", F.when(F.col("_cut"), F.col("_tail")).otherwise(longer))
        .drop("_carry")
    )


def walk(matcher: PhraseMatcher, view: str, fixed: int, used: int, heard: dict[str, int] | None = None) -> list[tuple[Match, int, int, str]]:
    """All boundaries of ``view`` in order. ``fixed`` leading characters are context; a boundary must end after them.
    ``used`` leading characters belong to an earlier boundary. ``heard`` are required words behind the last boundary, and their
    places seen from the start of ``view``."""
    out, at, heard = [], used, heard or {}
    while (hit := matcher.match_first(view[at:], max(0, fixed - at), heard)) is not None:
        lo, hi = snap(view[at:], hit)
        out.append((hit, at + lo, at + hi, view[at + hit.start : at + hit.end]))
        at += hi
        heard = {q: n for q, n in heard.items() if n >= at}
    return out


def _places(heard, view_start: int, used_upto: int = -1) -> dict[str, int]:
    """Required words that no boundary has used up, and their places seen from ``view_start``."""
    return {x["word"]: x["at"] - view_start for x in heard if x["at"] >= used_upto}


def _as_rows(found: list, fixed: int) -> list[dict]:
    return [
        {"kind": m.kind, "phrase": m.phrase, "start": lo - fixed, "end": hi - fixed, "score": m.score, "text": said}
        for m, lo, hi, said in found
    ]


def find_boundaries(
    placed: DataFrame, slices: KeySlices, order: str, patterns: list[Pattern], expiry_s: float = EXPIRY_S
) -> DataFrame:
    """Boundaries with absolute positions: source, row order, kind, text said, start and end in the running text.

    Rows without a plausible boundary word never reach Python. The others of an ordinary source are brought together in order for one
    pass. Hot sources are spread over slices: their rows are
    looked at on their own first, and only rows whose result depends on the rows before are then gone through in order.
    """
    rows = add_context(add_heard(placed, slices, order, patterns, expiry_s), slices, order, expiry_s, context_width(patterns))
    anchors = sorted({p.required[0] for p in patterns if p.required})
    near = F.exists("heard", lambda x: x["word"].isin(anchors)) if anchors else F.lit(False)
    likely = rows.select(KEY, order, "start_pos", "text", "ctx", "heard").filter(near | may_hold_boundary(F.concat("ctx", "text"), patterns))
    if slices.trivial:
        # the pass needs whole sources in order: say so, whatever the plan before it has left
        ordered = spread(likely.withColumn("_chain", F.lit(0).cast("long")), KEY).sortWithinPartitions(KEY, order)
        settled = ordered.mapInPandas(_in_order(patterns), widen(ordered.schema, found=_FOUND))
    else:
        active = materialize(likely.mapInPandas(_alone(patterns), widen(likely.schema, found=_FOUND, depends=T.BooleanType())), "active")
        head = (~F.col("depends")).cast("long")
        chained = running(active, slices, [order], sums={"_chain": head})
        ordered = spread(chained, KEY, "_chain").sortWithinPartitions(KEY, "_chain", order)
        settled = ordered.mapInPandas(_in_order(patterns), ordered.schema)
    return settled.select(KEY, order, "start_pos", F.posexplode("found").alias("match_no", "m")).select(
        KEY,
        order,
        "match_no",
        F.col("m.kind").alias("marker"),
        F.col("m.text").alias("said"),
        F.col("m.score").alias("score"),
        (F.col("start_pos") + F.col("m.start")).alias("m_start"),
        (F.col("start_pos") + F.col("m.end")).alias("m_end"),
        (F.col("m.start") < 0).alias("crosses"),
    )


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Hash partitions that stay as many as configured, for steps whose cost is in Python and not in bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _alone(patterns: list[Pattern]):
    """Boundaries of each row as if nothing of its context were used up, and whether that can matter.

    A smaller context can only take candidates away. If each pattern's best match is the same with the whole context and
    with none, it is the same with any part of it.
    """

    def scan(batches: Iterator) -> Iterator:
        matcher = PhraseMatcher(patterns)
        for pdf in batches:
            found, depends = [], []
            for ctx, text, start, heard in zip(pdf["ctx"], pdf["text"], pdf["start_pos"], pdf["heard"]):
                places = _places(heard, start - len(ctx))
                full = matcher.best_per_pattern(ctx + text, len(ctx), places)
                bare = matcher.best_per_pattern(text, 0)
                moved = [Match(m.kind, m.phrase, m.start + len(ctx), m.end + len(ctx), m.score) for m in bare]
                found.append(_as_rows(walk(matcher, ctx + text, len(ctx), 0, places), len(ctx)) if full else [])
                depends.append(full != moved)
            pdf["found"], pdf["depends"] = found, depends
            yield pdf[[bool(f) or d for f, d in zip(found, depends)]]

    return scan


def _in_order(patterns: list[Pattern]):
    """One pass over sorted rows. Only the end of the last boundary is carried from row to row, so a chain may be of any
    length. Rows that do not depend on it keep the boundaries they have."""

    def scan(batches: Iterator) -> Iterator:
        matcher = PhraseMatcher(patterns)
        chain, used_upto = None, -1
        for pdf in batches:
            known = list(pdf["found"]) if "found" in pdf else [None] * len(pdf)
            settled = ~pdf["depends"] if "depends" in pdf else [False] * len(pdf)
            out = []
            for source, number, ctx, text, start, heard, have, done in zip(
                pdf[KEY], pdf["_chain"], pdf["ctx"], pdf["text"], pdf["start_pos"], pdf["heard"], known, settled
            ):
                if (source, number) != chain:
                    chain, used_upto = (source, number), -1
                view_start = start - len(ctx)
                if done:
                    rows = list(have)
                else:
                    places = _places(heard, view_start, used_upto)
                    rows = _as_rows(walk(matcher, ctx + text, len(ctx), max(0, used_upto - view_start), places), len(ctx))
                if rows:
                    used_upto = start + rows[-1]["end"]
                out.append(rows)
            yield pdf.assign(found=out)

    return scan


def draft_id(source: Column, opened_at: Column) -> Column:
    """Same input, same id: a hash of the source and the place where the draft opened."""
    return F.sha2(F.concat(source, F.lit("#"), opened_at.cast("string")), 256)


def build_drafts(
    texts: DataFrame,
    slices: KeySlices,
    order: str = "seq",
    patterns: list[Pattern] | None = None,
    expiry_s: float = EXPIRY_S,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Drafts of every source. ``texts(source_id, <order>, text, audio_start_time, audio_end_time)``.

    One row per draft, with ``part_no`` 0. The text of a draft that goes on beyond ``part_chars`` comes as several rows,
    so that a source that never closes its draft does not end up in one value.
    """
    wanted = patterns or default_patterns()
    base = texts.select(KEY, order, "text", "audio_start_time", "audio_end_time")
    base, slices, order = _one_order(base, slices, order)
    placed = materialize(text_offset_map(base, slices, order), "placed")
    bounds = materialize(find_boundaries(placed, slices, order, wanted, expiry_s), "bounds")
    bounds = _with_times(bounds, placed, order)
    opened = draft_spans(bounds, slices, [order, "m_start"])
    stream_end = placed.groupBy(KEY).agg(
        F.max("end_pos").alias("_last_pos"), F.max_by("audio_end_time", order).alias("_last_time")
    )
    heads = opened.join(stream_end, KEY).select(
        KEY,
        F.col("m_start").alias("opened_at"),
        F.col("m_end").alias("body_start"),
        F.coalesce("end_m_start", "_last_pos").alias("body_end"),
        F.col("said").alias("start_text"),
        F.coalesce("end_said", F.lit(FORCED)).alias("end_text"),
        F.col("first_time").alias("audio_start_time"),
        F.coalesce("end_last_time", "_last_time").alias("audio_end_time"),
        "forced",
    )
    bodies = _bodies(_pieces(placed, bounds, slices, order), heads, order, part_chars)
    joined = heads.join(bodies, [KEY, "opened_at"], "left")
    return joined.select(
        draft_id(F.col(KEY), F.col("opened_at")).alias("draft_id"),
        KEY,
        "start_text",
        "end_text",
        F.coalesce("_body", F.lit("")).alias("full_text"),
        "audio_start_time",
        "audio_end_time",
        "forced",
        "opened_at",
        F.coalesce("part_no", F.lit(0).cast("long")).alias("part_no"),
    )


def _one_order(base: DataFrame, slices: KeySlices, order: str) -> tuple[DataFrame, KeySlices, str]:
    """Rows numbered within their source, so that no two have one place: equal order values are told apart by time, then text."""
    place = [order, "audio_start_time", "audio_end_time", "_hash"]
    numbered = row_numbers(base.withColumn("_hash", F.xxhash64("text")), slices, place, "_number")
    numbered = numbered.select(KEY, "_number", "text", "audio_start_time", "audio_end_time")
    if slices.trivial:
        return numbered, KeySlices(slices.key, "_number"), "_number"
    numbered = materialize(numbered, "numbered")
    return numbered, plan_slices(numbered, KEY, "_number"), "_number"


def _with_times(bounds: DataFrame, placed: DataFrame, order: str) -> DataFrame:
    """Audio times of the first and last text each boundary touches. Most lie inside one text, which is a plain join;
    only those that cross a seam need the interval join."""
    times = placed.select(KEY, order, "audio_start_time", F.col("audio_end_time").alias("last_time"))
    own = bounds.join(times, [KEY, order])
    inside = own.filter(~F.col("crosses")).withColumnRenamed("audio_start_time", "first_time")
    crossing = own.filter("crosses").drop("audio_start_time")
    spans = placed.select(KEY, F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e"), "audio_start_time")
    touched = overlap_join(spans, crossing, KEY, ("_s", "_e"), ("m_start", "m_end"), 4096)
    firsts = (
        touched.filter(F.col("_e") > F.col("m_start"))
        .groupBy(*crossing.columns)
        .agg(F.min_by("audio_start_time", "_s").alias("first_time"))
    )
    return inside.unionByName(firsts).drop("crosses")


def _pieces(placed: DataFrame, bounds: DataFrame, slices: KeySlices, order: str) -> DataFrame:
    """The texts cut at the boundaries found in them, each piece with the opening boundary it follows.

    A piece may run into a boundary that was only recognised with the next text; it is trimmed when the draft's end is
    known.
    """
    cuts = bounds.groupBy(KEY, order).agg(
        F.sort_array(F.collect_list(F.struct("m_start", "m_end", "marker"))).alias("_cuts")
    )  # boundaries of one text
    rows = placed.join(cuts, [KEY, order], "left")
    begin = F.col("start_pos") - F.col("seam")
    whole = F.concat(F.when(F.col("seam") == 1, F.lit(" ")).otherwise(F.lit("")), F.col("text"))
    none = F.array().cast("array<struct<m_start: bigint, m_end: bigint, marker: string>>")
    got = rows.select(KEY, order, begin.alias("_b"), whole.alias("_w"), "end_pos", F.coalesce("_cuts", none).alias("_cuts"))
    edge = F.struct(
        F.lit(None).cast("long").alias("m_start"), F.col("_b").alias("m_end"), F.lit(None).cast("string").alias("marker")
    )
    owners = F.concat(F.array(edge), F.col("_cuts"))
    pieces = got.select(KEY, order, "_b", "_w", "end_pos", "_cuts", F.posexplode(owners).alias("_i", "o"))
    stop = F.coalesce(F.get("_cuts", F.col("_i"))["m_start"], F.col("end_pos"))
    own = F.struct(F.col("o.m_start").alias("at"), F.col("o.marker").alias("marker"))
    pieces = pieces.select(
        KEY,
        order,
        "_i",
        F.when(F.col("_i") > 0, own).alias("_own"),
        F.col("o.m_end").alias("_from"),
        F.substring(
            F.col("_w"),
            (F.col("o.m_end") - F.col("_b") + 1).cast("int"),
            F.greatest(stop - F.col("o.m_end"), F.lit(0)).cast("int"),
        ).alias("_piece"),
    )
    owned = running(pieces, slices, [order, "_i"], lasts={"_owner": F.col("_own")})
    ours = owned.filter((F.col("_owner.marker") == "start") & (F.length("_piece") > 0))
    return ours.withColumn("opened_at", F.col("_owner.at")).drop("_owner", "_own")


def _bodies(pieces: DataFrame, heads: DataFrame, order: str, part_chars: int) -> DataFrame:
    """Text of each draft, in parts."""
    spans = heads.select(KEY, "opened_at", "body_start", "body_end")
    room = F.greatest(F.col("body_end") - F.col("_from"), F.lit(0)).cast("int")
    trimmed = pieces.join(spans, [KEY, "opened_at"]).select(
        KEY,
        "opened_at",
        F.floor((F.col("_from") - F.col("body_start")) / part_chars).alias("part_no"),
        order,
        "_i",
        F.substring(F.col("_piece"), F.lit(1), room).alias("_piece"),
    )
    ordered = F.sort_array(F.collect_list(F.struct(order, "_i", "_piece")))
    return trimmed.groupBy(KEY, "opened_at", "part_no").agg(
        F.array_join(F.transform(ordered, lambda x: x["_piece"]), "").alias("_body")
    )


def draft_events(drafts: DataFrame) -> DataFrame:
    """A start and an end event for every draft, also when both lie in one text."""
    kinds = F.array(
        F.struct(F.lit("start").alias("kind"), F.col("audio_start_time").alias("timestamp")),
        F.struct(F.lit("end").alias("kind"), F.col("audio_end_time").alias("timestamp")),
    )
    return drafts.select("*", F.inline(kinds))
