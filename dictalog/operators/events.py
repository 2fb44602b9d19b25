"""Operators over the event log: subscriptions, gates, feed, counts, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dictalog import schema
from dictalog.operators.slices import KeySlices, row_numbers, running, trailing_range, union_all


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def invalid_types(requested: Column) -> Column:
    """Requested classes that cannot be subscribed to."""
    return F.array_except(requested, _literals(schema.SUBSCRIBABLE + ["all", "all_but_chunks"]))


def expand_subscription(requested: Column) -> Column:
    """Classes meant by a request: ``all_but_chunks``, ``all``, or the named classes; null if one is unknown."""
    no_chunks = [c for c in schema.SUBSCRIBABLE if c != schema.CHUNK_CLASS]
    return (
        F.when(F.array_contains(requested, "all_but_chunks"), _literals(no_chunks))
        .when(F.array_contains(requested, "all"), _literals(schema.SUBSCRIBABLE))
        .when((F.size(requested) > 0) & (F.size(invalid_types(requested)) == 0), F.array_distinct(requested))
    )


def match_subscribers(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row per event and subscriber of its class. ``subscriptions(subscriber, requested ARRAY)``.

    The subscriber side is one row per live client and class, so it is broadcast when it is small; the planner decides
    by its size.
    """
    wanted = subscriptions.select("subscriber", F.explode(expand_subscription(F.col("requested"))).alias("event_class"))
    return events.join(wanted, "event_class")


def split_by_group(events: DataFrame) -> DataFrame:
    """Add the group (audio, text, draft) of each event; unknown classes get null."""
    group = F.lit(None).cast("string")
    for name, classes in schema.GROUPS.items():
        group = F.when(F.col("event_class").isin(classes), F.lit(name)).otherwise(group)
    return events.withColumn("event_group", group)


def group_of(events: DataFrame, name: str) -> DataFrame:
    """The events of one group; the filter reaches the scan."""
    return events.filter(F.col("event_class").isin(schema.GROUPS[name]))


def split_chunk_vs_change(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audio chunks, and audio state changes."""
    audio = group_of(events, "audio")
    is_chunk = F.col("event_class") == schema.CHUNK_CLASS
    return audio.filter(is_chunk), audio.filter(~is_chunk)


def stamp_author(events: DataFrame, uri: Column) -> DataFrame:
    return events.withColumn("author_uri", F.coalesce("author_uri", uri))


def pause_gate(
    events: DataFrame, slices: KeySlices, order_by: list[str], pause: Column, resume: Column
) -> DataFrame:
    """Drop what a source sends between a pause marker and the next resume marker (the markers stay)."""
    mark = F.when(pause, "pause").when(resume, "resume")
    got = running(events, slices, order_by, lasts={"_gate": mark})
    keep = F.coalesce(F.col("_gate"), F.lit("resume")) != "pause"
    return got.filter(keep | F.coalesce(pause, F.lit(False))).drop("_gate")


def feed_filter(events: DataFrame, hide_speech: bool = False) -> DataFrame:
    classes = [c for c in schema.FEED_CLASSES if not (hide_speech and c in schema.SPEECH_CLASSES)]
    return events.filter(F.col("event_class").isin(classes))


def feed_item(events: DataFrame, text: Column, start_text: Column, full_text: Column) -> DataFrame:
    """Label, badge and detail shown for an event."""
    # Label and badge of each feed class.
    labels = {
        "AudioSpeechStartEvent": ("Speech Start", "badge-info"),
        "AudioSpeechStopEvent": ("Speech Stop", "badge-error"),
        "TextEvent": ("Text", "badge-accent"),
        "DraftStartEvent": ("Draft Start", "badge-primary"),
        "DraftEndEvent": ("Draft End", "badge-secondary"),
    }
    cls = F.col("event_class")
    label = badge = F.lit(None).cast("string")
    for name, (shown, css) in labels.items():
        label = F.when(cls == name, F.lit(shown)).otherwise(label)
        badge = F.when(cls == name, F.lit(css)).otherwise(badge)
    detail = (
        F.when(cls == "TextEvent", text)
        .when(cls == "DraftStartEvent", F.concat(F.lit("Start: "), start_text))
        .when(cls == "DraftEndEvent", F.concat(F.lit("Text: "), F.substring(full_text, 1, 100), F.lit("...")))
    )
    return events.withColumns({"label": label, "badge": badge, "detail": detail})


def event_sequence(events: DataFrame, slices: KeySlices, order_by: list[str], out: str = "seq") -> DataFrame:
    return row_numbers(events, slices, order_by, out)


def last_n_events(events: DataFrame, key: str, order_by: list[str], n: int = 100) -> DataFrame:
    """The ``n`` most recent events of each source. The rank filter is pushed below the shuffle by the planner, so
    each map task sends at most ``n`` rows of a source."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order_by])
    return events.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def feed_table(
    events: DataFrame, slices: KeySlices, order_by: list[str], n: int = 100
) -> DataFrame:
    """The last ``n`` feed events per source, numbered from 1 over all feed events of that source."""
    feed = feed_filter(events)
    totals = feed.groupBy(slices.key).agg(F.count(F.lit(1)).alias("_total"))
    kept = last_n_events(feed, slices.key, order_by, n)
    w = Window.partitionBy(slices.key).orderBy(*[F.col(c).desc() for c in order_by])
    back = kept.withColumn("_back", F.row_number().over(w)).join(totals, slices.key)
    return back.withColumn("seq", F.col("_total") - F.col("_back") + 1).drop("_total", "_back")


def poll_since(feed: DataFrame, since: int, key: str = "source_id") -> DataFrame:
    """Feed rows newer than ``since``, with the current sequence number of the source."""
    current = feed.groupBy(key).agg(F.max("seq").alias("current_seq"))
    return feed.filter(F.col("seq") > since).join(current, key)


def ring_buffer(events: DataFrame, slices: KeySlices, reach_us: int, aggs: dict[str, Column]) -> DataFrame:
    """Per event, aggregates over the events its ring buffer would hold (the last ``reach_us``)."""
    return trailing_range(events, slices, reach_us, aggs)


def dedup_events(events: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """First event per id. An aggregate, not a window: copies are folded before the shuffle."""
    rest = [c for c in events.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order_by))
    return events.groupBy(key).agg(first.alias("_first")).select(key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def union_events(*frames: DataFrame) -> DataFrame:
    return union_all(list(frames))


def event_counts(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"))


def worker_liveness(pings: DataFrame, now_us: Column, timeout_us: int = 5_000_000) -> DataFrame:
    """Per worker: last ping, last url, available iff the ping is less than the timeout ago.
    ``pings(worker, url, us)``."""
    return (
        pings.groupBy("worker")
        .agg(F.max("us").alias("last_us"), F.max_by("url", F.struct("us", "url")).alias("url"))
        .withColumn("available", (now_us - F.col("last_us")) < timeout_us)
    )


def status_snapshot(events: DataFrame, ping: Column, client: Column, now_us: Column) -> DataFrame:
    """One row: pipeline state, number of clients, worker availability, last ping."""
    return events.agg(
        F.lit("running").alias("status"),
        (F.count(F.lit(1)) > 0).alias("pipeline_active"),
        F.countDistinct(client).alias("event_clients"),
        F.max(F.when(ping, F.col("us"))).alias("last_ping_us"),
    ).withColumn("worker_available", F.coalesce((now_us - F.col("last_ping_us")) < 5_000_000, F.lit(False)))


def draft_lifecycle(events: DataFrame, key: str = "draft_id") -> DataFrame:
    """Per draft: first start, first end, first rescan, and whether it was finalized. ``events(.., kind, us)``."""

    def first(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.col("us"))).alias(f"{kind}_us")

    return (
        events.groupBy(key)
        .agg(first("start"), first("end"), first("rescan"), F.count(F.lit(1)).alias("n_events"))
        .withColumn("finalized", F.col("end_us").isNotNull())
    )


def untranscribed_tail(
    speech: DataFrame, texts: DataFrame, tolerance: float = 0.5, key: str = "source_id"
) -> DataFrame:
    """Per source: seconds of speech after the last text, and whether audio is still waiting for text.
    ``speech(source_id, speech_end)``, ``texts(source_id, text_end)``."""
    heard = speech.groupBy(key).agg(F.max("speech_end").alias("last_speech"))
    written = texts.groupBy(key).agg(F.max("text_end").alias("last_text"))
    gap = F.col("last_speech") - F.col("last_text")
    return heard.join(written, key, "left").withColumns(
        {"gap": gap, "pending": F.coalesce(gap > tolerance, F.lit(False))}
    )
