"""Registered queries on the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from dictalog import schema
from dictalog.functions import times
from dictalog.operators import events as E
from dictalog.operators.ranges import lookback
from dictalog.operators.speech import merge_vad
from dictalog.plans import views
from dictalog.plans.registry import query
from dictalog.session import shared_dir
from dictalog.sources import event_log, sinks
from dictalog.streaming import live
from dictalog.streaming.runner import read_table_stream, run_available, run_each_batch, stream_of

NOW = "2024-01-31 00:00:00"
NOW_US = 1706659200000000
DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000

# A spoken-class name as the other wire spelling has it.
SPELLED = "concat('<class ''audio.events.', event_class, '''>')"


def _wire(spark, sf):
    """The event log in wire form: one JSON line per event."""
    ev = views.events(spark, sf)
    draft = F.when(
        F.col("event_class").isin(schema.DRAFT_CLASSES),
        F.struct(
            F.lit("open").alias("start_text"),
            F.col("props").alias("full_text"),
            F.concat(F.lit("d-"), F.col("event_id").cast("string")).alias("draft_id"),
        ),
    )
    rows = ev.select(
        F.expr(SPELLED).alias("event_class"),
        "source_id",
        F.col("event_id").cast("string").alias("event_id"),
        (F.col("us") / 1e6).alias("timestamp"),
        F.lit(None).cast("string").alias("author_uri"),
        F.when(F.col("event_class") == "TextEvent", F.col("props")).alias("text"),
        draft.alias("draft"),
    )
    return event_log.encode_events(rows)


@query(
    "s1_read_event_log",
    """SELECT event_class, source_id, CAST(event_id AS STRING) AS event_id, epoch_us(ts) AS us,
       CASE WHEN event_class = 'TextEvent' THEN props END AS text,
       CASE WHEN event_class LIKE 'Draft%' THEN concat('d-', CAST(event_id AS STRING)) END AS draft_id FROM v_events""",
)
def s1(spark, sf):
    path = shared_dir(spark, "wire")
    _wire(spark, sf).write.text(path)
    good, _ = event_log.read_event_log(spark, path)
    return good.select(
        "event_class", "source_id", "event_id", F.round(F.col("timestamp") * 1e6).cast("long").alias("us"), "text",
        F.col("draft.draft_id").alias("draft_id"),
    )


@query(
    "s1_quarantine",
    """SELECT CAST(event_id AS STRING) AS event_id, CASE WHEN event_class = 'TextEvent' THEN 'unknown_class' ELSE 'malformed' END
       AS reason FROM v_events WHERE event_class IN ('TextEvent', 'DraftEndEvent')""",
)
def s1_bad(spark, sf):
    """Text events under an unknown name, draft ends as cut-off lines: both are put aside, the rest decodes."""
    ev = views.events(spark, sf)
    ident = F.col("event_id").cast("string")
    line = (
        F.when(F.col("event_class") == "TextEvent", F.concat(F.lit('{"event_class":"OtherEvent","event_id":"'), ident, F.lit('"}')))
        .when(F.col("event_class") == "DraftEndEvent", F.concat(F.lit('{"event_class":"DraftEndEvent","event_id":"'), ident))
        .otherwise(F.concat(F.lit('{"event_class":"'), F.col("event_class"), F.lit('","event_id":"'), ident, F.lit('"}')))
    )
    bad = event_log.decode_events(ev.select(line.alias("value")))[1]
    return bad.select(F.regexp_extract("line", r'event_id":"(\d+)', 1).alias("event_id"), "reason")


@query(
    "s2_write_event_log",
    """SELECT concat('{"event_class":"', event_class, '","event_id":', CAST(event_id AS STRING), ',"source_id":"', source_id,
       '","value":', CAST(value AS STRING), ',"author_uri":null}') AS value FROM v_events""",
)
def s2(spark, sf):
    ev = views.events(spark, sf).withColumn("author_uri", F.lit(None).cast("string"))
    path = shared_dir(spark, "log")
    fields = ["event_id", "source_id", "value", "author_uri"]
    event_log.encode_events(ev, fields).write.text(path)
    return spark.read.text(path)


@query(
    "s3_split_by_group",
    """SELECT event_id, event_class, CASE WHEN event_class LIKE 'Audio%' THEN 'audio' WHEN event_class = 'TextEvent' THEN 'text'
       ELSE 'draft' END AS event_group FROM v_events""",
)
def s3(spark, sf):
    return E.split_by_group(views.events(spark, sf)).select("event_id", "event_class", "event_group")


@query(
    "s6_subscribe_stream",
    "SELECT event_id, event_class, source_id FROM v_events WHERE event_class LIKE 'Audio%'",
)
def s6(spark, sf):
    ev = spark.sql(views.V_EVENTS, events=read_table_stream(spark, sf, "events"))
    heard = event_log.subscribe_stream(ev, audio_only=True).select("event_id", "event_class", "source_id")
    return run_available(heard, "subscribed")


def _records(spark, sf):
    """Recorder records: draft ends are commands that carry the two events before them."""
    ev = views.events(spark, sf)
    blank = lambda i: F.struct(
        i.cast("string").alias("event_id"),
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("double").alias("timestamp"),
        F.lit(None).cast("string").alias("audio_source_id"),
        F.lit(None).cast("double").alias("audio_start_time"),
        F.lit(None).cast("double").alias("audio_end_time"),
    )
    command = F.col("event_class") == "DraftEndEvent"
    names = ["event_id", "text", "timestamp", "audio_source_id", "audio_start_time", "audio_end_time"]
    own, near, far = (blank(F.col("event_id") - k) for k in (0, 1, 2))
    nothing = F.lit(None).cast("struct<event_id:string,text:string,timestamp:double,audio_source_id:string,audio_start_time:double,audio_end_time:double>")
    inner = F.struct(nothing.alias("properties"), *[near[n].alias(n) for n in names])
    props = F.struct(
        *[own[n].alias(n) for n in names], F.when(command, inner).alias("text_event"), F.when(command, far).alias("attention_text_event")
    )
    name = F.when(command, "scribe.ScribeCommandEvent").otherwise(F.concat(F.lit("scribe."), F.col("event_class")))
    return ev.select(F.col("us").alias("pos"), name.alias("classname"), props.alias("properties"))


@query(
    "s8_read_block_records",
    """SELECT event_id, path_no FROM (SELECT event_id, path_no, row_number() OVER (PARTITION BY event_id ORDER BY pos, path_no) AS rn
       FROM (SELECT CAST(event_id AS STRING) AS event_id, 0 AS path_no, epoch_us(ts) AS pos FROM v_events WHERE event_class = 'TextEvent'
       UNION ALL SELECT CAST(event_id - 1 AS STRING), 1, epoch_us(ts) FROM v_events WHERE event_class = 'DraftEndEvent'
       UNION ALL SELECT CAST(event_id - 2 AS STRING), 2, epoch_us(ts) FROM v_events WHERE event_class = 'DraftEndEvent') x) y
       WHERE rn = 1""",
)
def s8(spark, sf):
    return event_log.nested_text_events(_records(spark, sf), ["pos"]).select("event_id", "path_no")


SUBSCRIPTIONS = [("screen", ["all_but_chunks"]), ("notes", ["TextEvent", "DraftEndEvent"]), ("meter", ["AudioSpeechStartEvent", "AudioSpeechStopEvent"])]
SUBSCRIBED_SQL = """SELECT e.event_id, s.subscriber FROM v_events e JOIN (SELECT 'screen' AS subscriber, unnest(['AudioSpeechStartEvent',
 'AudioSpeechStopEvent', 'TextEvent', 'DraftStartEvent', 'DraftEndEvent']) AS event_class UNION ALL SELECT 'notes', unnest(['TextEvent',
 'DraftEndEvent']) UNION ALL SELECT 'meter', unnest(['AudioSpeechStartEvent', 'AudioSpeechStopEvent'])) s ON s.event_class = e.event_class"""


def _subscriptions(spark):
    return spark.createDataFrame(SUBSCRIPTIONS, "subscriber STRING, requested ARRAY<STRING>")


@query("j10_match_subscribers", SUBSCRIBED_SQL)
def j10(spark, sf):
    return E.match_subscribers(views.events(spark, sf), _subscriptions(spark)).select("event_id", "subscriber")


@query("s14_fan_out", SUBSCRIBED_SQL)
def s14(spark, sf):
    path = shared_dir(spark, "fan-out")
    matched = E.match_subscribers(views.events(spark, sf), _subscriptions(spark))
    sinks.write_fan_out(matched.select("event_id", "event_class", "subscriber"), path)
    return spark.read.schema("event_id BIGINT, event_class STRING, subscriber STRING").parquet(path).drop("event_class")


@query("t11_live_fan_out", SUBSCRIBED_SQL)
def t11(spark, sf):
    path = shared_dir(spark, "live-fan-out")
    ev = spark.sql(views.V_EVENTS, events=read_table_stream(spark, sf, "events")).select("event_id", "event_class")
    run_each_batch(ev, "fan-out", live.fan_out_batch(_subscriptions(spark), path))
    got = spark.read.schema("event_id BIGINT, event_class STRING, batch_no INT, subscriber STRING").parquet(path)
    return got.select("event_id", "subscriber")


@query(
    "p1_expand_subscription",
    """SELECT e.event_id, CASE WHEN event_class = 'TextEvent' THEN 8 WHEN event_class = 'DraftEndEvent' THEN 9
       WHEN event_class = 'DraftStartEvent' THEN NULL ELSE 1 END AS n_classes FROM v_events e""",
)
def p1(spark, sf):
    """Requests made from the events: a text asks for all but chunks, a draft end for all, a draft start for an unknown class."""
    cls = F.col("event_class")
    asked = (
        F.when(cls == "TextEvent", F.array(F.lit("all_but_chunks")))
        .when(cls == "DraftEndEvent", F.array(F.lit("all")))
        .when(cls == "DraftStartEvent", F.array(F.lit("NoSuchEvent"), cls))
        .otherwise(F.array(cls))
    )
    return views.events(spark, sf).select("event_id", F.size(E.expand_subscription(asked)).alias("n_classes"))


@query(
    "u3_invalid_types",
    """SELECT event_id, CASE WHEN event_class = 'DraftStartEvent' THEN 'NoSuchEvent' ELSE '' END AS invalid FROM v_events""",
)
def u3(spark, sf):
    cls = F.col("event_class")
    asked = F.when(cls == "DraftStartEvent", F.array(F.lit("NoSuchEvent"), cls)).otherwise(F.array(cls))
    return views.events(spark, sf).select("event_id", F.array_join(E.invalid_types(asked), ",").alias("invalid"))


@query(
    "p3_pause_gate",
    """SELECT event_id, event_class FROM (SELECT *, last_value(CASE event_class WHEN 'DraftEndEvent' THEN 'pause' WHEN 'DraftStartEvent'
       THEN 'resume' END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY ts) AS gate FROM v_events) x
       WHERE gate IS NULL OR gate <> 'pause' OR event_class = 'DraftEndEvent'""",
)
def p3(spark, sf):
    ev = views.events(spark, sf).select("event_id", "event_class", "source_id", "us")
    cls = F.col("event_class")
    got = E.pause_gate(ev, views.event_slices(ev), ["us"], cls == "DraftEndEvent", cls == "DraftStartEvent")
    return got.select("event_id", "event_class")


@query(
    "p4_stamp_author",
    "SELECT event_id, CASE WHEN event_class = 'TextEvent' THEN source_id ELSE 'http://edge/routes' END AS author_uri FROM v_events",
)
def p4(spark, sf):
    ev = views.events(spark, sf).withColumn("author_uri", F.when(F.col("event_class") == "TextEvent", F.col("source_id")))
    return E.stamp_author(ev, F.lit("http://edge/routes")).select("event_id", "author_uri")


@query(
    "p12_feed_item",
    """SELECT event_id, CASE event_class WHEN 'AudioSpeechStartEvent' THEN 'Speech Start' WHEN 'AudioSpeechStopEvent' THEN 'Speech Stop'
       WHEN 'TextEvent' THEN 'Text' WHEN 'DraftStartEvent' THEN 'Draft Start' ELSE 'Draft End' END AS label,
       CASE event_class WHEN 'AudioSpeechStartEvent' THEN 'badge-info' WHEN 'AudioSpeechStopEvent' THEN 'badge-error'
       WHEN 'TextEvent' THEN 'badge-accent' WHEN 'DraftStartEvent' THEN 'badge-primary' ELSE 'badge-secondary' END AS badge,
       CASE event_class WHEN 'TextEvent' THEN props WHEN 'DraftStartEvent' THEN concat('Start: ', source_id)
       WHEN 'DraftEndEvent' THEN concat('Text: ', substring(repeat(props, 20), 1, 100), '...') END AS detail FROM v_events""",
)
def p12(spark, sf):
    got = E.feed_item(views.events(spark, sf), F.col("props"), F.col("source_id"), F.repeat("props", F.lit(20)))
    return got.select("event_id", "label", "badge", "detail")


@query("p13_feed_filter", "SELECT event_id, event_class FROM v_events WHERE event_class NOT LIKE 'AudioSpeech%'")
def p13(spark, sf):
    return E.feed_filter(views.events(spark, sf), hide_speech=True).select("event_id", "event_class")


@query(
    "p14_split_chunk_vs_change",
    """SELECT event_id, event_class, CASE WHEN event_class = 'AudioSpeechStartEvent' THEN 'chunk' ELSE 'change' END AS side FROM v_events
       WHERE event_class LIKE 'Audio%'""",
)
def p14(spark, sf):
    """Speech starts stand in for chunks, of which the table has none."""
    as_chunk = F.when(F.col("event_class") == "AudioSpeechStartEvent", schema.CHUNK_CLASS).otherwise(F.col("event_class"))
    ev = views.events(spark, sf).select("event_id", F.col("event_class").alias("_was"), as_chunk.alias("event_class"))
    chunk, change = E.split_chunk_vs_change(ev)
    both = chunk.withColumn("side", F.lit("chunk")).unionByName(change.withColumn("side", F.lit("change")))
    return both.select("event_id", F.col("_was").alias("event_class"), "side")


@query(
    "u1_union_events",
    """SELECT source_id, 'event' AS origin, count(*) AS n FROM v_events GROUP BY source_id UNION ALL
       SELECT source_id, 'text', count(*) FROM v_texts GROUP BY source_id UNION ALL
       SELECT author_uri, 'draft', count(*) FROM v_drafts GROUP BY author_uri""",
)
def u1(spark, sf):
    both = E.union_events(
        views.events(spark, sf).withColumn("origin", F.lit("event")),
        views.texts(spark, sf).withColumn("origin", F.lit("text")).drop("event_id"),
        views.drafts(spark, sf).withColumnsRenamed({"author_uri": "source_id"}).withColumn("origin", F.lit("draft")),
    )
    return both.groupBy("source_id", "origin").agg(F.count(F.lit(1)).alias("n"))


DUPLICATED_SQL = "SELECT event_id, event_class, source_id FROM v_events"


@query("u2_dedup_events", DUPLICATED_SQL)
def u2(spark, sf):
    """Every event comes again a second later, with another class; the first stays."""
    ev = views.events(spark, sf).select("event_id", "event_class", "source_id", "us")
    again = ev.withColumns({"us": F.col("us") + 1_000_000, "event_class": F.lit("Again")})
    return E.dedup_events(ev.unionByName(again), "event_id", ["us"]).select("event_id", "event_class", "source_id")


@query("u2_dedup_stream", "SELECT event_id, source_id FROM v_events")
def u2_stream(spark, sf):
    ev = views.events(spark, sf).select("event_id", "source_id", F.col("ts").cast("timestamp").alias("ts"))
    twice = stream_of(ev.unionByName(ev.withColumn("ts", F.col("ts") + F.expr("interval 1 second"))), "twice")
    return run_available(live.dedup_stream(twice, "1 day").select("event_id", "source_id"), "dedup")


RING_SQL = """SELECT event_id, count(*) OVER w AS held, CAST(round(sum(value) OVER w, 4) AS DOUBLE) AS held_value FROM v_events
WINDOW w AS (PARTITION BY source_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)"""


@query("w1_ring_buffer", RING_SQL)
def w1(spark, sf):
    ev = views.events(spark, sf).select("event_id", "source_id", "us", "value")
    got = E.ring_buffer(ev, views.event_slices(ev), DAY_US, {"held": F.count(F.lit(1)), "held_value": F.sum("value")})
    return got.select("event_id", "held", F.round("held_value", 4).alias("held_value"))


@query("w2_event_sequence", "SELECT event_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY ts) AS seq FROM v_events")
def w2(spark, sf):
    ev = views.events(spark, sf).select("event_id", "source_id", "us")
    return E.event_sequence(ev, views.event_slices(ev), ["us"]).select("event_id", "source_id", "seq")


@query(
    "o4_last_n_events",
    """SELECT event_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC) AS rn FROM v_events) x
       WHERE rn <= 100""",
)
def o4(spark, sf):
    ev = views.events(spark, sf).select("event_id", "source_id", "us")
    return E.last_n_events(ev, "source_id", ["us"], 100).select("event_id", "source_id")


FEED_SQL = """SELECT event_id, source_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts) AS seq,
row_number() OVER (PARTITION BY source_id ORDER BY ts DESC) AS back FROM v_events) x WHERE back <= 100"""


def _feed(spark, sf):
    ev = views.events(spark, sf).select("event_id", "source_id", "us", "event_class")
    return E.feed_table(ev, views.event_slices(ev), ["us"], 100)


@query("s15_feed_table", FEED_SQL)
def s15(spark, sf):
    return _feed(spark, sf).select("event_id", "source_id", "seq")


@query(
    "o5_poll_since",
    f"SELECT event_id, f.source_id, seq, max(seq) OVER (PARTITION BY f.source_id) AS current_seq FROM ({FEED_SQL}) f QUALIFY seq > 60",
)
def o5(spark, sf):
    return E.poll_since(_feed(spark, sf), 60).select("event_id", "source_id", "seq", "current_seq")


@query(
    "a7_draft_lifecycle",
    """SELECT source_id AS draft_id, min(epoch_us(ts)) FILTER (event_class = 'DraftStartEvent') AS start_us,
       min(epoch_us(ts)) FILTER (event_class = 'DraftEndEvent') AS end_us, min(epoch_us(ts)) FILTER (event_class = 'TextEvent') AS rescan_us,
       count(*) AS n_events, min(epoch_us(ts)) FILTER (event_class = 'DraftEndEvent') IS NOT NULL AS finalized
       FROM v_events WHERE event_class NOT LIKE 'Audio%' GROUP BY source_id""",
)
def a7(spark, sf):
    kind = F.expr("CASE event_class WHEN 'DraftStartEvent' THEN 'start' WHEN 'DraftEndEvent' THEN 'end' WHEN 'TextEvent' THEN 'rescan' END")
    ev = views.events(spark, sf).select(F.col("source_id").alias("draft_id"), kind.alias("kind"), "us")
    return E.draft_lifecycle(ev.filter(F.col("kind").isNotNull()))


PINGS_SQL = f"""SELECT source_id AS worker, max(epoch_us(ts)) AS last_us, arg_max(props, epoch_us(ts)) AS url,
{NOW_US} - max(epoch_us(ts)) < {DAY_US} AS available FROM v_events WHERE event_class = 'AudioSpeechStartEvent' GROUP BY source_id"""


def _pings(ev):
    own = ev.filter(F.col("event_class") == "AudioSpeechStartEvent")
    return own.select(F.col("source_id").alias("worker"), F.col("props").alias("url"), "us")


@query("a10_worker_liveness", PINGS_SQL)
def a10(spark, sf):
    return E.worker_liveness(_pings(views.events(spark, sf)), F.lit(NOW_US), DAY_US)


@query("t8_heartbeat_ttl", PINGS_SQL)
def t8(spark, sf):
    """The same from a stream: the last state of a complete-mode aggregate."""
    raw = spark.sql(views.V_EVENTS, events=read_table_stream(spark, sf, "events"))
    ev = raw.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    states = run_available(live.heartbeats(_pings(ev)), "heartbeat", mode="complete")
    last = states.groupBy("worker").agg(F.max_by(F.struct("last_us", "url"), "batch_no").alias("s")).select("worker", "s.*")
    return last.withColumn("available", (F.lit(NOW_US) - F.col("last_us")) < DAY_US)


# A worker's pings are gaps and islands: each island begins alive and ends dead a day after its last ping.
@query(
    "t8_worker_flips",
    f"""WITH p AS (SELECT source_id AS worker, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER w AS before, lead(epoch_us(ts)) OVER w AS after FROM v_events
        WINDOW w AS (PARTITION BY source_id ORDER BY ts))
        SELECT worker, true AS alive, us AS at_us FROM p WHERE before IS NULL OR us - before > {DAY_US} UNION ALL
        SELECT worker, false, us + {DAY_US} FROM p WHERE after IS NULL OR after - us > {DAY_US}""",
)
def t8_flips(spark, sf):
    """Flips of a stream of pings; one row far behind moves the time on, so that the last silences are told too."""
    raw = spark.sql(views.V_EVENTS, events=views.table(spark, sf, "events"))
    pings = raw.select(F.col("source_id").alias("worker"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    clock = pings.agg((F.max("us") + 30 * DAY_US).alias("us")).select(F.lit("\u0000clock").alias("worker"), "us")
    stream = stream_of(pings.unionByName(clock), "pings").withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "1 second")
    return run_available(live.worker_flips(stream, DAY_US), "flips")


@query(
    "a11_status_snapshot",
    f"""SELECT 'running' AS status, count(*) > 0 AS pipeline_active, count(DISTINCT source_id) AS event_clients,
        max(epoch_us(ts)) FILTER (event_class = 'AudioSpeechStartEvent') AS last_ping_us,
        {NOW_US} - max(epoch_us(ts)) FILTER (event_class = 'AudioSpeechStartEvent') < 5000000 AS worker_available FROM v_events""",
)
def a11(spark, sf):
    ev = views.events(spark, sf)
    return E.status_snapshot(ev, F.col("event_class") == "AudioSpeechStartEvent", F.col("source_id"), F.lit(NOW_US))


@query(
    "a13_untranscribed_tail",
    """SELECT s.source_id, s.last_speech, t.last_text, s.last_speech - t.last_text AS gap,
       coalesce(s.last_speech - t.last_text > 0.5, false) AS pending
       FROM (SELECT source_id, max(epoch_us(ts)) / 1e6 AS last_speech FROM v_events WHERE event_class = 'AudioSpeechStopEvent' GROUP BY 1) s
       LEFT JOIN (SELECT source_id, max(epoch_us(ts)) / 1e6 AS last_text FROM v_events WHERE event_class = 'TextEvent' GROUP BY 1) t
       ON s.source_id = t.source_id""",
)
def a13(spark, sf):
    ev = views.events(spark, sf).withColumn("sec", F.col("us") / 1e6)
    speech = ev.filter(F.col("event_class") == "AudioSpeechStopEvent").select("source_id", F.col("sec").alias("speech_end"))
    texts = ev.filter(F.col("event_class") == "TextEvent").select("source_id", F.col("sec").alias("text_end"))
    return E.untranscribed_tail(speech, texts)


@query("a14_event_counts", "SELECT source_id, event_class, count(*) AS n_events FROM v_events GROUP BY 1, 2")
def a14(spark, sf):
    return E.event_counts(views.events(spark, sf), "source_id", "event_class")


MERGED_SQL = """SELECT event_id, source_id, coalesce(last_value(CASE event_class WHEN 'AudioSpeechStartEvent' THEN true
WHEN 'AudioSpeechStopEvent' THEN false END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY ts), false) AS in_speech FROM v_events"""


@query("j6_merge_vad", f"SELECT * FROM (SELECT m.*, e.event_class FROM ({MERGED_SQL}) m JOIN v_events e ON m.event_id = e.event_id) x WHERE event_class NOT LIKE 'Audio%'")
def j6(spark, sf):
    ev = views.events(spark, sf).select("event_id", "event_class", "source_id", "us")
    is_vad = F.col("event_class").isin(schema.SPEECH_CLASSES)
    got = merge_vad(ev.filter(~is_vad), ev.filter(is_vad), views.event_slices(ev), "us", ["event_id", "event_class"])
    return got.select("event_id", "event_class", "source_id", "in_speech")


@query(
    "j7_lookback",
    f"""SELECT s.event_id AS mark_id, e.event_id, e.source_id FROM v_events s JOIN v_events e ON e.source_id = s.source_id
        AND epoch_us(e.ts) >= epoch_us(s.ts) - {6 * HOUR_US} AND epoch_us(e.ts) < epoch_us(s.ts)
        WHERE s.event_class = 'AudioSpeechStartEvent'""",
)
def j7(spark, sf):
    ev = views.events(spark, sf).select("event_id", "event_class", "source_id", "us")
    marks = ev.filter(F.col("event_class") == "AudioSpeechStartEvent")
    marks = marks.select("source_id", F.col("event_id").alias("mark_id"), F.col("us").alias("mark_us"))
    got = lookback(ev.drop("event_class"), marks, "source_id", "us", "mark_us", 6 * HOUR_US)
    return got.select("mark_id", "event_id", "source_id")


@query(
    "f11_source_uri",
    """SELECT event_id, concat('ase://10.0.0.1:8765/dictalog/audio_source/', event_class, '/', strftime(ts, '%Y-%m-%dT%H%M%S')) AS uri,
       8765 AS port, event_class AS kind, epoch_us(date_trunc('second', ts)) AS start_us FROM v_events""",
)
def f11(spark, sf):
    ev = views.events(spark, sf)
    uri = times.source_uri(F.lit("10.0.0.1"), F.lit(8765), F.col("event_class"), F.col("ts").cast("timestamp"))
    parts = ev.select("event_id", uri.alias("uri")).withColumn("p", times.parse_source_uri(F.col("uri")))
    return parts.select("event_id", "uri", "p.port", "p.kind", F.unix_micros("p.start").alias("start_us"))


@query(
    "x1_taps",
    """SELECT 'raw' AS tap, 'audio' AS event_group, count(*) AS n FROM v_events WHERE event_class LIKE 'Audio%' UNION ALL
       SELECT 'raw', 'text', count(*) FROM v_events WHERE event_class = 'TextEvent' UNION ALL
       SELECT 'raw', 'draft', count(*) FROM v_events WHERE event_class LIKE 'Draft%'""",
)
def x1(spark, sf):
    """One handler on the raw tap that stores what it gets."""
    path = shared_dir(spark, "taps")
    taps = live.Taps()
    taps.attach("raw", lambda group, rows: rows.select("event_id").write.mode("append").parquet(f"{path}/event_group={group}"))
    ev = spark.sql(views.V_EVENTS, events=read_table_stream(spark, sf, "events")).withColumn("tap", F.lit("raw"))
    run_each_batch(ev, "taps", taps.batch)
    got = spark.read.schema("event_id BIGINT, event_group STRING").parquet(path)
    return got.groupBy("event_group").agg(F.count(F.lit(1)).alias("n")).withColumn("tap", F.lit("raw"))
