import golden
from pyspark.sql import functions as F
from test_segmenter import as_tuples, by_hand, noisy_rows

from dictalog.functions import plugins
from dictalog.session import shared_dir
from dictalog.streaming import live
from dictalog.streaming.runner import run_available, run_each_batch, run_until_done
from dictalog.streaming.segmenter import stream_drafts


def in_batches(spark, parts, shape):
    """A file stream that delivers each part as one micro-batch, in order."""
    path = shared_dir(spark, "parts")
    for part in parts:
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)


def stops(rows):
    last = {}
    for source, seq, _, _, end in rows:
        last[source] = (source, seq + 1, None, end, end)
    return list(last.values())


def test_golden_stream_row_by_row(spark):
    """Each text its own micro-batch: the drafts are those of the batch form."""
    rows = golden.rows()
    most = max(r[1] for r in rows)
    parts = [[r for r in rows if r[1] == i] for i in range(most + 1)] + [stops(rows)]
    events = run_available(stream_drafts(in_batches(spark, parts, golden.SCHEMA)), "golden").collect()
    golden.check([r.asDict() for r in events if r["kind"] == "end"])
    assert sum(r["kind"] == "start" for r in events) == sum(r["kind"] == "end" for r in events)


def test_stream_equals_row_by_row(spark):
    rows = noisy_rows(5, 60)
    cut = lambda lo, hi: [r for r in rows if lo <= r[1] < hi]
    parts = [cut(0, 17), cut(17, 40), cut(40, 60), stops(rows)]
    events = run_available(stream_drafts(in_batches(spark, parts, golden.SCHEMA)), "noisy").filter("kind = 'end'")
    assert as_tuples(events.collect()) == by_hand(rows)


def test_long_draft_is_handed_on_in_parts(spark):
    rows = [("a", 0, "freddy take this down", 0.0, 1.0)] + [("a", i, f"word{i}", float(i), i + 1.0) for i in range(1, 60)]
    rows.append(("a", 60, "freddy break break", 60.0, 61.0))
    parts = [rows[:20], rows[20:45], rows[45:]]
    events = run_available(stream_drafts(in_batches(spark, parts, golden.SCHEMA), part_chars=100), "parts").collect()
    texts = sorted((r["part_no"], r["full_text"]) for r in events if r["kind"] in ("part", "end"))
    assert len(texts) > 2
    assert "".join(t for _, t in texts) == "".join(f" word{i}" for i in range(1, 60)) + " "


def test_silent_source_is_forced_to_end(spark):
    shape = golden.SCHEMA
    parts = [[("a", 0, "freddy take this down and so on", 1.0, 2.0)], [("b", 0, "hello", 500.0, 501.0)], [("b", 1, "more", 502.0, 503.0)]]
    stream = in_batches(spark, parts, shape).withColumn("ts", F.timestamp_seconds("audio_end_time")).withWatermark("ts", "1 second")
    events = run_available(stream_drafts(stream, idle_s=60.0), "idle").filter("kind = 'end'").collect()
    assert [(r["source_id"], r["full_text"], r["forced"]) for r in events] == [("a", " and so on", True)]


def test_taps_and_lifecycle(spark):
    seen, calls = [], []
    taps = live.Taps()
    taps.attach("vad", lambda group, rows: seen.extend((group, r["event_class"]) for r in rows.collect()))
    shape = "event_class STRING, tap STRING"
    parts = [[("AudioChunkEvent", "raw"), ("AudioChunkEvent", "vad")], [("TextEvent", "raw")]]
    listener = live.Lifecycle(lambda i: calls.append("ready"), lambda i, e: calls.append("end"))
    spark.streams.addListener(listener)
    run_each_batch(in_batches(spark, parts, shape), "taps", taps.batch)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(listener)
    assert sorted(seen) == [("audio", "AudioChunkEvent"), ("text", "TextEvent")]
    assert "ready" in calls


def test_transcriber_and_editor_plugins(spark):
    df = spark.createDataFrame([([0.1, 0.2], 16000), ([0.0] * 5, 16000)], "samples ARRAY<FLOAT>, sample_rate INT")
    heard = plugins.transcribe(df, lambda: lambda data, rate, prompt: [f"{data.size}"]).collect()
    assert sorted(r["segments"] for r in heard) == [["2"], ["5"]]
    edited = plugins.edit_drafts(spark.createDataFrame([("p",)], "prompt STRING"), lambda: str.upper).first()
    assert edited["reply"] == "P"


def test_own_speech_scorer(spark):
    df = spark.createDataFrame([([0.5, -0.5], 16000)], "data ARRAY<FLOAT>, sample_rate INT")
    assert plugins.score_speech(df).first()["speech_score"] == 0.5
    assert plugins.score_speech(df, lambda: lambda d, r: float(d.max())).first()["speech_score"] == 0.5


def test_endless_stream_ends_by_itself(spark):
    """No trigger ends it: it stops when all input is through and no draft is open, else at the limit."""
    rows = golden.rows()
    done, finished = run_until_done(stream_drafts(in_batches(spark, [rows, stops(rows)], golden.SCHEMA)), "endless", limit_s=120)
    golden.check([r.asDict() for r in done.collect() if r["kind"] == "end"])
    assert finished
    left, finished = run_until_done(stream_drafts(in_batches(spark, [[("a", 0, "freddy take this down and on", 0.0, 1.0)]], golden.SCHEMA)), "open", limit_s=15)
    assert not finished and [r["kind"] for r in left.collect()] == ["start"]


def test_workers_flip_against_a_walk(spark):
    import random

    r = random.Random(2)
    ttl = 3_000_000
    pings = {w: sorted({20_000_000 + r.randrange(60_000_000) for _ in range(12)}) for w in "abc"}
    want = []
    for w, times in pings.items():
        last = None
        for t in times:
            want += [(w, False, last + ttl)] if last is not None and t - last > ttl else []
            want += [(w, True, t)] if last is None or t - last > ttl else []
            last = t
        want.append((w, False, last + ttl))
    rows = [(w, t) for w, times in pings.items() for t in times]
    cuts = [0, 35_000_000, 36_000_000, 60_000_000, 1 << 60]
    parts = [[x for x in rows if lo <= x[1] < hi] for lo, hi in zip(cuts, cuts[1:])] + [[("clock", 900_000_000)]]
    stream = in_batches(spark, [p for p in parts if p], "worker STRING, us BIGINT").withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "1 second")
    got = run_available(live.worker_flips(stream, ttl), "flips").filter("worker <> 'clock'").collect()
    assert sorted((x.worker, x.alive, x.at_us) for x in got) == sorted(want)


def test_words_are_cleaned_once(monkeypatch):
    """A word of the text is cleaned and compared the first time only, and gives the same required words each time."""
    from dictalog.functions import fuzzy
    from dictalog.functions.phrases import default_patterns

    matcher, real, calls = fuzzy.PhraseMatcher(default_patterns()), fuzzy.clean_with_map, []
    monkeypatch.setattr(fuzzy, "clean_with_map", lambda text: calls.append(text) or real(text))
    text = "Freddy, take this down: Fredy. " * 50
    first = matcher.required_at(text)
    assert first == matcher.required_at(text) and first["freddy"] == text.rindex("Fredy")
    assert len(calls) == 5


def test_no_frame_without_rows():
    """Nothing is handed on for a key of which nothing is to be told."""
    from types import SimpleNamespace

    import pandas as pd

    from dictalog.functions.phrases import default_patterns
    from dictalog.streaming.segmenter import DraftSegmenter

    kept = {}
    value = SimpleNamespace(exists=lambda: "v" in kept, get=lambda: kept["v"], update=lambda v: kept.update(v=v), clear=kept.clear)
    body = SimpleNamespace(get=lambda: iter(()), clear=lambda: None, appendList=lambda rows: None)
    s = DraftSegmenter(default_patterns(), 20.0, None, 1000)
    s.init(SimpleNamespace(getValueState=lambda *a: value, getListState=lambda *a: body))
    rows = lambda *texts: iter([pd.DataFrame({"seq": [n], "text": [t], "audio_start_time": [float(n)], "audio_end_time": [n + 1.0]}) for n, t in texts])
    assert list(s.handleInputRows(("a",), rows((1, "nothing"), (0, "here")), None)) == []
    (got,) = s.handleInputRows(("a",), rows((3, None), (2, "Freddy take this down. words")), None)
    assert got["kind"].tolist() == ["start", "end"] and got["forced"].tolist() == [False, True] and got["full_text"][1] == " words"


def test_coordinator_knows_its_timer():
    """One timer for the first pair that is due, set and taken back without asking the state for timers."""
    from types import SimpleNamespace

    import pandas as pd

    from dictalog.streaming.live import RescanCoordinator

    kept, timers = {}, set()
    value = SimpleNamespace(exists=lambda: "v" in kept, get=lambda: kept["v"], update=lambda v: kept.update(v=v), clear=kept.clear)
    c = RescanCoordinator()
    c.init(SimpleNamespace(getValueState=lambda *a: value, registerTimer=timers.add, deleteTimer=timers.remove))  # no listTimers
    rows = lambda *events: iter([pd.DataFrame(events, columns=["ts_ms", "origin", "kind", "draft_id", "full_text"])])
    time = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)

    def fire(at):
        out = list(c.handleExpiredTimer(("a",), time, SimpleNamespace(getExpiryTimeInMs=lambda: at)))
        timers.remove(at)  # as Spark does
        return [r for f in out for r in f[["original_draft_id", "outcome"]].itertuples(index=False, name=None)]

    assert list(c.handleInputRows(("a",), rows((0, "remote", "start", "x", None), (9_000, "remote", "end", "x", None)), time)) == []
    assert timers == {14_000}
    assert list(c.handleInputRows(("a",), rows((10_000, "local", "start", "l", "text")), time)) == []
    assert timers == {24_000}
    list(c.handleInputRows(("a",), rows((11_000, "remote", "start", "y", None), (12_000, "remote", "end", "y", None)), time))
    assert timers == {17_000}
    assert fire(17_000) == [("y", "failed")] and timers == {24_000}
    assert fire(24_000) == [("x", "forced")] and not timers and not kept


def test_ordered_rows_give_no_empty_frames():
    """Pings that are only held, or change nothing, hand nothing on."""
    from types import SimpleNamespace

    import pandas as pd

    from dictalog.streaming.live import _Flips

    class Map(dict):
        def updateValue(self, k, v):
            self[k] = v

        def getValue(self, k):
            return self[k]

        def containsKey(self, k):
            return k in self

        def removeKey(self, k):
            del self[k]

    kept = {}
    memo = SimpleNamespace(exists=lambda: "v" in kept, get=lambda: kept["v"], update=lambda v: kept.update(v=v))
    s = _Flips(10_000_000)
    s.init(SimpleNamespace(getMapState=lambda *a: Map(), getValueState=lambda *a: memo, registerTimer=lambda at: None))
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    pings = lambda *us: iter([pd.DataFrame({"ts_us": us, "prio": 0, "ident": None})])
    assert list(s.handleInputRows(("w",), pings(1_000_000), at(0))) == []
    (got,) = s.handleExpiredTimer(("w",), at(2_000), None)
    assert got["alive"].tolist() == [True]
    assert list(s.handleInputRows(("w",), pings(3_000_000), at(2_000))) == []
    assert list(s.handleExpiredTimer(("w",), at(4_000), None)) == []
    (got,) = s.handleExpiredTimer(("w",), at(20_000), None)
    assert got["alive"].tolist() == [False] and got["at_us"].tolist() == [13_000_000]
