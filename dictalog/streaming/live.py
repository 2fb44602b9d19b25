"""Liveness, revisions and live delivery."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from dictalog import schema
from dictalog.operators.events import match_subscribers
from dictalog.session import ensure_runtime_conf, shared_dir
from dictalog.streaming.ordered import InOrder


def heartbeats(pings: DataFrame) -> DataFrame:
    """Last ping and url per worker, for update or complete mode. ``pings(worker, url, us)``."""
    return pings.groupBy("worker").agg(F.max("us").alias("last_us"), F.max_by("url", "us").alias("url"))


FLIP = T.StructType([T.StructField("worker", T.StringType()), T.StructField("alive", T.BooleanType()), T.StructField("at_us", T.LongType())])


class _Flips(InOrder):
    """A worker comes alive with a ping, and is dead when none has followed within the time to live."""

    fields = ()
    output, fresh = FLIP, {"last": None}

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def step(self, memory, row, ring):
        last, memory["last"] = memory["last"], row[0]
        if last is None:
            return [(True, row[0])]
        return [(False, last + self.ttl_us), (True, row[0])] if row[0] - last > self.ttl_us else []

    def due(self, memory, upto_us):
        if memory["last"] is None:
            return [], None
        end = memory["last"] + self.ttl_us
        if end >= upto_us:
            return [], end
        memory["last"] = None
        return [(False, end)], None


def worker_flips(pings: DataFrame, ttl_us: int) -> DataFrame:
    """When each worker came alive and when it went dead, as rows of a stream: a timer tells of a worker that is silent for ``ttl_us``, without
    any further ping. ``pings(worker, us, ts)``, ``ts`` with a watermark."""
    rows = pings.select("worker", "ts", F.col("us").alias("ts_us"), F.lit(0).alias("prio"), F.lit(None).cast("long").alias("ident"))
    return rows.groupBy("worker").transformWithStateInPandas(statefulProcessor=_Flips(ttl_us), outputStructType=FLIP, outputMode="Append", timeMode="EventTime")


def dedup_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First event per id; ids are remembered for the watermark delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def fan_out_batch(subscriptions: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body that writes each event once per subscriber. A retried batch overwrites itself."""

    def body(batch: DataFrame, number: int) -> None:
        matched = match_subscribers(batch, subscriptions)
        matched.write.mode("overwrite").partitionBy("subscriber").parquet(f"{path}/batch_no={number}")

    return body


class Taps:
    """Handlers per tap: ``raw``, ``vad`` or ``merged``; plus what to do when the stream is ready and when it ends."""

    NAMES = ("raw", "vad", "merged")

    def __init__(self):
        self.handlers: dict[str, list[Callable[[str, DataFrame], None]]] = {n: [] for n in self.NAMES}
        self.on_ready: list[Callable[[], None]] = []
        self.on_shutdown: list[Callable[[str | None], None]] = []

    def attach(self, tap: str, handler: Callable[[str, DataFrame], None]) -> None:
        """``handler(group, rows)`` gets audio rows of its tap, and all text and draft rows."""
        if tap not in self.NAMES:
            raise ValueError(f"tap must be one of {self.NAMES}, not {tap!r}")
        self.handlers[tap].append(handler)

    def batch(self, rows: DataFrame, number: int) -> None:
        """``foreachBatch`` body. Rows carry ``event_class`` and ``tap``."""
        kept = rows.persist()
        try:
            for tap, handlers in self.handlers.items():
                for handler in handlers:
                    for group, classes in schema.GROUPS.items():
                        part = kept.filter(F.col("event_class").isin(classes))
                        handler(group, part.filter(F.col("tap") == tap) if group == "audio" else part)
        finally:
            kept.unpersist()


class Lifecycle(StreamingQueryListener):
    """Calls back when a query starts and when it ends."""

    def __init__(self, on_ready: Callable[[str], None], on_shutdown: Callable[[str, str | None], None]):
        self.on_ready, self.on_shutdown = on_ready, on_shutdown

    def onQueryStarted(self, event) -> None:
        self.on_ready(str(event.id))

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.on_shutdown(str(event.id), event.exception)


class _TapLifecycle(StreamingQueryListener):
    """Tells a set of taps once when the query of a name is ready, and once when it ends (with its error, if any)."""

    def __init__(self, taps: Taps, name: str):
        self.taps, self.name, self.ended = taps, name, threading.Event()
        self.run: str | None = None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = str(event.runId)
            for call in self.taps.on_ready:
                call()

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            for call in self.taps.on_shutdown:
                call(event.exception)
            self.ended.set()


def listen(stream: DataFrame, taps: Taps, name: str, endless: bool = False) -> None:
    """Runs a stream of tapped rows (``hearing.tapped``) for all handlers of all taps, as one query with one life: ready, rows, shutdown.

    Returns when everything available is through, or, if ``endless``, when the query is stopped.
    """
    spark = stream.sparkSession
    ensure_runtime_conf(spark)
    full = f"{name}-{uuid.uuid4().hex}"
    life = _TapLifecycle(taps, full)
    spark.streams.addListener(life)
    try:
        writer = stream.writeStream.queryName(full).foreachBatch(taps.batch).option("checkpointLocation", shared_dir(spark, f"{name}-ckpt"))
        (writer if endless else writer.trigger(availableNow=True)).start().awaitTermination()
    finally:
        life.ended.wait(30)
        spark.streams.removeListener(life)


REVISION = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("original_draft_id", T.StringType()),
        T.StructField("revision_id", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("outcome", T.StringType()),  # paired, forced, failed
    ]
)
_TEXT = T.StructType([T.StructField("v", T.StringType())])


class RescanCoordinator(StatefulProcessor):
    """Pairs remote drafts with the local re-transcription of the same audio.

    After the remote end, a local draft has ``start_ms`` to appear and ``end_ms`` to end; one that has not ended by then is
    taken as it is (forced), and without any the rescan has failed. The next remote draft may start while pairs still wait: each has a place
    of its own in the state. A local draft belongs to the newest remote draft that has none. A remote draft that starts before the one
    before it has ended gives that one up (failed).
    Rows: source_id, ts_ms, origin (remote/local), kind (start/end), draft_id, full_text.
    """

    def __init__(self, start_ms: int = 5_000, end_ms: int = 15_000):
        self.start_ms, self.end_ms = start_ms, end_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _TEXT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        columns = ("ts_ms", "origin", "kind", "draft_id", "full_text")
        events = sorted((e for pdf in rows for e in zip(*(pdf[c] for c in columns))), key=lambda e: e[:2])
        pairs = self._load()
        stored, timer, out = bool(pairs), self._wake(pairs), []
        for ts, origin, kind, ident, text in events:
            ts = int(ts)
            out += self._due(key[0], pairs, ts)
            if origin == "remote":
                self._remote(key[0], pairs, out, ts, kind, ident)
            else:
                self._local(pairs, kind, ident, text)
            out += self._closed(key[0], pairs, "paired", lambda p: p["ended"] is not None and p["local"] and p["local"]["done"])
        yield from self._done(stored, timer, pairs, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        pairs = self._load()
        stored, timer, fired = bool(pairs), self._wake(pairs), expiredTimerInfo.getExpiryTimeInMs()
        now = max(fired, timerValues.getCurrentWatermarkInMs())  # one call for all that is due
        yield from self._done(stored, None if timer == fired else timer, pairs, self._due(key[0], pairs, now))  # Spark deletes the one that fired

    def _wake(self, pairs: list[dict]) -> int | None:
        """When the first pair that waits is due. The only timer of a source is set to it, so the state needn't be asked for timers."""
        return min((p["ended"] + (self.end_ms if p["local"] else self.start_ms) for p in pairs if p["ended"] is not None), default=None)

    def _done(self, stored: bool, timer: int | None, pairs: list[dict], out: list) -> Iterator:
        """Keep the pairs that still wait, with one timer for the first of them that is due, and hand on what is through. timer: the one set before."""
        import pandas as pd

        if pairs:
            self.state.update((json.dumps(pairs),))
        elif stored:
            self.state.clear()
        wake = self._wake(pairs)
        if timer is not None and timer != wake:
            self.handle.deleteTimer(timer)
        if wake is not None and wake != timer:
            self.handle.registerTimer(wake)
        if out:
            yield pd.DataFrame(out, columns=REVISION.names)

    def close(self) -> None:
        pass

    def _load(self) -> list[dict]:
        return json.loads(self.state.get()[0]) if self.state.exists() else []

    def _remote(self, source: str, pairs: list[dict], out: list, ts: int, kind: str, ident: str) -> None:
        if kind == "start":
            out += self._closed(source, pairs, "failed", lambda p: p["ended"] is None)
            pairs.append({"remote": ident, "ended": None, "local": None})
            return
        pair = next((p for p in pairs if p["remote"] == ident), None)
        if pair is None:
            pair = {"remote": ident, "ended": None, "local": None}
            pairs.append(pair)
        pair["ended"] = ts

    @staticmethod
    def _local(pairs: list[dict], kind: str, ident: str, text: str | None) -> None:
        pair = next((p for p in pairs if p["local"] and p["local"]["id"] == ident), None)
        pair = pair or next((p for p in reversed(pairs) if not p["local"]), None)
        if pair is not None:
            pair["local"] = {"id": ident, "text": text, "done": kind == "end"}

    def _due(self, source: str, pairs: list[dict], now: int) -> list:
        late = lambda p, ms: p["ended"] is not None and now >= p["ended"] + ms
        failed = self._closed(source, pairs, "failed", lambda p: not p["local"] and late(p, self.start_ms))
        return failed + self._closed(source, pairs, "forced", lambda p: p["local"] and late(p, self.end_ms))

    @staticmethod
    def _closed(source: str, pairs: list[dict], outcome: str, which: Callable[[dict], bool]) -> list:
        """Rows of the pairs that are through; they leave the state."""
        rows = []
        for p in [p for p in pairs if which(p)]:
            pairs.remove(p)
            local = p["local"] or {"id": None, "text": None}
            rows.append((source, p["remote"], local["id"], local["text"], outcome))
        return rows


def rescan_revisions(events: DataFrame, start_ms: int = 5_000, end_ms: int = 15_000) -> DataFrame:
    """Revisions of a stream of remote and local draft events with a watermark."""
    return events.groupBy("source_id").transformWithStateInPandas(
        statefulProcessor=RescanCoordinator(start_ms, end_ms),
        outputStructType=REVISION,
        outputMode="Append",
        timeMode="EventTime",
    )
