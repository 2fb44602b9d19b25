"""Chunks to drafts, rescans and taps as streams: equal to the batch forms and to a walk through the events."""

import random

from pyspark.sql import functions as F
from test_flows import SCHEMA, reader, spoken
from test_streaming import in_batches

from dictalog.operators import speech as A
from dictalog.operators.slices import plan_slices
from dictalog.plans import flows
from dictalog.streaming import hearing, live, rescan
from dictalog.streaming.runner import run_available

START_US = 10_000_000  # rows at time 0 would count as late
SPEECH = dict(silence_us=40_000, batch_samples=400, prebuffer_us=20_000)


def watermarked(stream):
    return stream.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", "1 second")


def chunk_rows():
    rows = spoken("mic-1", ["hello there ", "Freddy take this down. hello wrold ", "and more. Freddy break break. "])
    rows += spoken("mic-2", ["Freddy take this down. never closed "])
    return [(s, c, ts + START_US, d, n, r, score) for s, c, ts, d, n, r, score in rows]


def with_ends(parts):
    """The parts as micro-batches, then a row that ends each source, then one that moves the watermark on."""
    rows = [r for p in parts for r in p]
    last = max(r[2] for r in rows)
    ends = [(s, None, last + 60_000_000, None, None, None, None) for s in {r[0] for r in rows}]
    return [*parts, ends, [("clock", None, last + 120_000_000, None, None, None, None)]]


def test_stream_of_chunks_equals_the_batch_flow(spark):
    rows = chunk_rows()
    r = random.Random(3)
    cuts = sorted({START_US + r.randrange(3_000_000) for _ in range(4)})
    parts = [[x for x in rows if lo <= x[2] < hi] for lo, hi in zip([0, *cuts], [*cuts, 1 << 60])]
    parts = [r.sample(p, len(p)) for p in parts if p]  # any order within a micro-batch
    stream = watermarked(in_batches(spark, with_ends(parts), SCHEMA))
    ended = run_available(hearing.stream_audio_to_drafts(stream, reader(), **SPEECH), "heard").filter("kind = 'end'")
    batch = flows.audio_to_drafts(spark.createDataFrame(rows, SCHEMA), reader(), pad_us=10_000, **SPEECH)
    fields = ("source_id", "draft_id", "start_text", "end_text", "full_text", "audio_start_time", "forced")
    key = lambda x: tuple(x[f] for f in fields)
    got, want = sorted(map(key, ended.collect())), sorted(map(key, batch.collect()))
    assert got == want and len(got) == 2


def test_quiet_chunks_lead_into_the_speech(spark):
    rows = [("a", i, START_US + i * 10_000, [float(i)], 1, 100, 0.9 if i in (10, 11, 30) else 0.1) for i in range(40)]
    stream = watermarked(in_batches(spark, with_ends([rows[:15], rows[15:]]), SCHEMA))
    tagged = run_available(hearing.tag_speech(stream, 0.5, 50_000, 30_000), "tagged").filter("source_id = 'a'")
    got = {}
    for x in tagged.collect():
        got.setdefault(x.kind, []).append((x.chunk_id, x.speech_no, x.in_speech))
    assert sorted(got["replay"]) == [(7, 1, False), (8, 1, False), (9, 1, False), (27, 2, False), (28, 2, False), (29, 2, False)]
    assert sorted(c for c, _, on in got["chunk"] if on) == [*range(10, 17), *range(30, 36)] and len(got["chunk"]) == 40
    assert len(got["start"]) == len(got["stop"]) == 2 and len(got["flush"]) == 1


def brute_rescan(chunks, starts, ends, reach):
    """Event by event: (draft, chunk, replayed)."""
    rows = [(ts, 1, 0, ("chunk", c)) for ts, c in chunks] + [(ts, 0, i, ("start", d, a)) for i, (ts, d, a) in enumerate(starts)]
    rows += [(ts, 2, 0, ("end", d)) for ts, d in ends]
    ring, open_, out = [], None, []
    for ts, _, _, e in sorted(rows):
        if e[0] == "start":
            out += [(e[1], c, True) for t, c in ring if t >= max(e[2], ts - reach)]
            ring, open_ = [], e[1]
        elif e[0] == "chunk" and open_:
            out.append((open_, e[1], False))
        elif e[0] == "chunk":
            ring.append((ts, e[1]))
        elif open_ == e[1]:
            open_ = None
    return sorted(out)


AUDIO = "source_id STRING, ts_us BIGINT, prio INT, ident BIGINT, draft_id STRING, audio_start_us BIGINT, sample_rate INT, data ARRAY<FLOAT>"


def test_rescan_audio_against_a_walk(spark):
    r = random.Random(5)
    chunks = [(START_US + i * 50_000, i) for i in range(400)]
    starts = [(START_US + t * 100_000, f"d{i}", START_US + t * 100_000 - r.randrange(3_000_000)) for i, t in enumerate(sorted(r.sample(range(10, 190), 12)))]
    ends = [(ts + r.randrange(2_500_000), d) for ts, d, _ in starts if r.random() < 0.8]
    want = brute_rescan(chunks, starts, ends, 1_500_000)
    assert any(x[2] for x in want) and any(not x[2] for x in want)
    rows = [("a", ts, rescan.CHUNK, c, None, None, 100, [1.0]) for ts, c in chunks]
    rows += [("a", ts, rescan.START, None, d, a, None, None) for ts, d, a in starts] + [("a", ts, rescan.END, None, d, None, None, None) for ts, d in ends]
    cuts = [START_US + i * 3_333_333 for i in range(8)]
    parts = [[x for x in rows if lo <= x[1] < hi] for lo, hi in zip(cuts, [*cuts[1:], 1 << 60])]
    parts = [r.sample(p, len(p)) for p in parts if p] + [[("clock", START_US + 900_000_000, rescan.END, None, "-", None, None, None)]]
    audio = run_available(rescan.rescan_audio(watermarked(in_batches(spark, parts, AUDIO)), 1_500_000), "audio").filter("kind <> 'end'")
    assert sorted((x.draft_id, x.chunk_id, x.kind == "replay") for x in audio.collect()) == want

    stored = spark.createDataFrame([("a", ts, c) for ts, c in chunks], "source_id STRING, ts_us BIGINT, chunk_id BIGINT")
    ended = dict((d, ts) for ts, d in ends)
    drafts = spark.createDataFrame([("a", d, ts, a, ended.get(d)) for ts, d, a in starts], "source_id STRING, draft_id STRING, start_us BIGINT, audio_start_us BIGINT, end_us BIGINT")
    got = A.rescan_audio_range(stored, drafts, plan_slices(drafts, "source_id", "start_us"), 1_500_000, bin_us=700_000)
    assert sorted((x.draft_id, x.chunk_id, x.replayed) for x in got.collect()) == want


def test_rescan_hears_the_draft_again(spark):
    """The remote draft's audio through a better transcriber, in the stream and in batch."""
    rows = [x for x in chunk_rows() if x[0] == "mic-1"]
    texts = [x for x in rows if x[6] > 0.5]
    first, last = texts[2][2], texts[-1][2]
    chunks = [(x[0], x[2], rescan.CHUNK, x[1], None, None, x[5], x[3]) for x in rows]
    events = [("mic-1", first + 100_000, rescan.START, None, "remote-1", first, None, None), ("mic-1", last + 10_000, rescan.END, None, "remote-1", None, None, None)]
    parts = [chunks + events, [("clock", last + 900_000_000, rescan.END, None, "-", None, None, None)]]
    got = run_available(rescan.rescan_drafts(watermarked(in_batches(spark, parts, AUDIO)), reader("better"), batch_samples=600), "again").filter("kind = 'end'").collect()
    spans = spark.createDataFrame([("mic-1", "remote-1", first, last + 10_000)], "source_id STRING, draft_id STRING, start_us BIGINT, stop_us BIGINT")
    want = flows.rescan(spans, spark.createDataFrame(rows, SCHEMA), reader("better"), batch_samples=600, bin_us=1_000_000).collect()
    assert [(x.source_id, x.full_text, x.forced) for x in got] == [(x.parent_draft_id, x.full_text, x.forced) for x in want]
    assert "hello world" in got[0].full_text


def test_taps_share_one_life(spark):
    calls, seen = [], {n: [] for n in live.Taps.NAMES}
    taps = live.Taps()
    for name in taps.NAMES:
        taps.attach(name, lambda group, rows, name=name: seen[name].extend((r.event_class, r.chunk_id, r.in_speech) for r in rows.collect()) if group == "audio" else None)
    taps.on_ready.append(lambda: calls.append("ready"))
    taps.on_shutdown.append(lambda error: calls.append(("shutdown", error)))
    rows = [("a", i, START_US + i * 10_000, [float(i)], 1, 100, 0.9 if 5 <= i < 9 else 0.1) for i in range(30)]
    live.listen(hearing.tapped(watermarked(in_batches(spark, with_ends([rows]), SCHEMA)), 0.5, 20_000), taps, "life")
    assert calls == ["ready", ("shutdown", None)]
    assert sorted(seen["raw"]) == [("AudioChunkEvent", i, None) for i in range(30)]
    assert sorted(x[0] for x in seen["vad"]) == ["AudioSpeechStartEvent", "AudioSpeechStopEvent"]
    assert sorted(c for k, c, on in seen["merged"] if k == "AudioChunkEvent" and on) == [*range(5, 11)] and len(seen["merged"]) == 32


class _Handle:
    """State and timers of one source, as a stateful processor sees them."""

    def __init__(self):
        self.value, self.timers, self.most = None, set(), 0

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)
        self.most = max(self.most, len(self.timers))

    def deleteTimer(self, at):
        self.timers.discard(at)

    def listTimers(self):
        return list(self.timers)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_rescans_of_a_source_share_one_timer():
    """A thousand drafts leave one timer, not two each: a source's timers run one after the other in one task."""
    import pandas as pd

    handle, coordinator = _Handle(), live.RescanCoordinator()
    coordinator.init(handle)
    rows = []
    for i in range(1001):
        at, ours = 10_000 * i, f"l{i}"
        rows += [(at, "remote", "start", f"r{i}", None), (at + 9_000, "remote", "end", f"r{i}", None)]
        rows += [(at + 1_000, "local", "start", ours, None)] if i % 3 != 2 else []
        rows += [(at + 12_000, "local", "end", ours, None)] if i % 3 == 0 else []
    flow = pd.DataFrame(rows, columns=["ts_ms", "origin", "kind", "draft_id", "full_text"])
    got = list(coordinator.handleInputRows(("a",), iter([flow]), None))
    assert handle.most == 1
    while handle.timers:
        at = handle.timers.pop()
        got += coordinator.handleExpiredTimer(("a",), _At(at), _At(at))
    outcomes = pd.concat(got).set_index("original_draft_id")["outcome"].to_dict()
    assert outcomes == {f"r{i}": ("paired", "forced", "failed")[i % 3] for i in range(1001)}
    assert handle.value is None
