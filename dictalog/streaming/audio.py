"""Online forms of the speech operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def vad_sessions(chunks: DataFrame, threshold: float, silence_us: int) -> DataFrame:
    """Speech segments of a chunk stream with ``ts`` (watermarked) and ``ts_us``: a session of speech chunks whose gaps
    are at most the silence. A segment comes out once the watermark has passed its silence."""
    gap = f"{silence_us + 1} microseconds"
    # The condition names the event time, so that it is not pushed below the watermark: silent chunks advance it too.
    spoken = F.when(F.col("speech_score") >= threshold, F.col("ts")).isNotNull()
    return (
        chunks.filter(spoken)
        .groupBy("source_id", F.session_window("ts", gap))
        .agg(
            F.min("ts_us").alias("start_us"),
            F.max("ts_us").alias("last_speech_us"),
            F.count(F.lit(1)).alias("n_speech_chunks"),
        )
        .drop("session_window")
    )


class _InEventOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them, then hands them on in (time, priority) order."""

    row: T.StructType
    memory: dict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.row)
        self.memo = handle.getValueState("memo", T.StructType([T.StructField("v", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        first = None
        for pdf in rows:
            got = list(pdf[self.row.names].itertuples(index=False, name=None))
            self.held.appendList([_plain(r, self.row) for r in got])
            low = int(pdf["ts_us"].min())
            first = low if first is None else min(low, first)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter([pd.DataFrame(columns=self.names)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.held.get()), key=lambda r: (r[0], r[1]))
        ready = [r for r in rows if r[0] <= upto]
        rest = [r for r in rows if r[0] > upto]
        memory = json.loads(self.memo.get()[0]) if self.memo.exists() else dict(self.memory)
        out = []
        for r in ready:
            out += self.step(key[0], memory, r)
        self.memo.update((json.dumps(memory),))
        self.held.clear()
        if rest:
            self.held.appendList(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        return iter([pd.DataFrame(out, columns=self.names)])

    def close(self) -> None:
        pass


def _plain(row: tuple, shape: T.StructType) -> tuple:
    """Plain Python values for the state store (pandas shows a column of whole numbers with nulls as floats)."""
    out = []
    for v, field in zip(row, shape.fields):
        if v is None or v != v:
            out.append(None)
        elif isinstance(field.dataType, (T.LongType, T.IntegerType)):
            out.append(int(v))
        else:
            out.append(v.item() if hasattr(v, "item") else v)
    return tuple(out)


_EVENT = T.StructType(
    [
        T.StructField("ts_us", T.LongType()),
        T.StructField("prio", T.IntegerType()),
        T.StructField("chunk_id", T.LongType()),
        T.StructField("state", T.BooleanType()),
    ]
)


class _Merge(_InEventOrder):
    row, memory, names = _EVENT, {"on": False}, ["source_id", "chunk_id", "ts_us", "in_speech"]

    def step(self, source, memory, r):
        if r[1] == 0:
            memory["on"] = bool(r[3])
            return []
        return [(source, r[2], r[0], memory["on"])]


class _Replay(_InEventOrder):
    row, names = _EVENT, ["source_id", "chunk_id", "ts_us", "mark_us"]

    def __init__(self, reach_us: int):
        self.reach_us, self.memory = reach_us, {"quiet": []}

    def step(self, source, memory, r):
        if r[1] == 0:  # speech starts: replay what is young enough, then forget
            young = [q for q in memory["quiet"] if q[1] >= r[0] - self.reach_us]
            memory["quiet"] = []
            return [(source, c, t, r[0]) for c, t in young]
        memory["quiet"] = [q for q in memory["quiet"] if q[1] >= r[0] - self.reach_us] + [[r[2], r[0]]]
        return []


def merge_vad_stream(events: DataFrame) -> DataFrame:
    """Chunks with the speech state at their time. ``events(source_id, ts, ts_us, prio, chunk_id, state)``: speech
    events have ``prio`` 0 and a ``state``, chunks ``prio`` 1; ``ts`` carries the watermark."""
    shape = "source_id STRING, chunk_id BIGINT, ts_us BIGINT, in_speech BOOLEAN"
    return _ordered(events, _Merge(), shape)


def prebuffer_replay(events: DataFrame, reach_us: int = 1_000_000) -> DataFrame:
    """Silent chunks replayed at each speech start. Same input; only starts (``prio`` 0) and silent chunks."""
    shape = "source_id STRING, chunk_id BIGINT, ts_us BIGINT, mark_us BIGINT"
    return _ordered(events, _Replay(reach_us), shape)


def _ordered(events: DataFrame, processor: StatefulProcessor, shape: str) -> DataFrame:
    return events.groupBy("source_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=shape, outputMode="Append", timeMode="EventTime"
    )


BATCHES = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("speech_no", T.LongType()),
        T.StructField("batch_no", T.LongType()),
        T.StructField("first_us", T.LongType()),
        T.StructField("last_us", T.LongType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("last_samples", T.LongType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("samples", T.ArrayType(T.FloatType())),
    ]
)


class _Batcher(StatefulProcessor):
    """Collects the speech chunks of a source up to a number of samples, or to the end of the speech. Chunks wait as bytes in a list
    that is only appended to until the batch goes out."""

    def __init__(self, batch_samples: int):
        self.batch_samples = batch_samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memo = handle.getValueState("memo", T.StructType([T.StructField("v", T.StringType())]))
        self.parts = handle.getListState("parts", T.StructType([T.StructField("data", T.BinaryType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        pdf = pd.concat(list(rows)).sort_values("ts_us", kind="stable")  # bounded by the micro-batch size
        st = json.loads(self.memo.get()[0]) if self.memo.exists() else {"speech": None, "seen": 0, "batch": 0, "first": None, "last": None, "tail": 0, "rate": None}
        fresh: list[bytes] = []
        stored = st["first"] is not None  # some of the open batch is in the state
        out = []

        def flush():
            nonlocal stored
            if st["first"] is None:
                return
            parts = ([bytes(r[0]) for r in self.parts.get()] if stored else []) + fresh
            data = np.frombuffer(b"".join(parts), np.float32)
            out.append((key[0], st["speech"], st["batch"], st["first"], st["last"], len(data), st["tail"], st["rate"], data))
            if stored:
                self.parts.clear()
            fresh.clear()
            stored, st["first"] = False, None

        for ts, speech, rate, data in zip(pdf["ts_us"], pdf["speech_no"], pdf["sample_rate"], pdf["data"]):
            if data is None:  # end of the source, or a flush command
                flush()
                out.append((key[0], None, None, None, int(ts), 0, 0, None, None))
                continue
            if st["speech"] != int(speech):
                flush()
                st.update(speech=int(speech), seen=0, batch=0)
            batch = st["seen"] // self.batch_samples
            if batch != st["batch"]:
                flush()
                st["batch"] = batch
            fresh.append(np.asarray(data, np.float32).tobytes())
            st.update(first=int(ts) if st["first"] is None else st["first"], last=int(ts), tail=len(data), seen=st["seen"] + len(data), rate=int(rate))
        self.memo.update((json.dumps(st),))
        if fresh:
            self.parts.appendList([(p,) for p in fresh])
        frame = pd.DataFrame(out, columns=BATCHES.names)
        yield frame.astype({f.name: "Int64" for f in BATCHES.fields if isinstance(f.dataType, (T.LongType, T.IntegerType))})

    def close(self) -> None:
        pass


def stream_batches(speech: DataFrame, batch_samples: int) -> DataFrame:
    """Transcription batches of a stream of speech chunks (source_id, speech_no, ts_us, sample_rate, data). A row with null data
    flushes its source and goes on as a batch of no samples."""
    rows = speech.select("source_id", "speech_no", "ts_us", "sample_rate", "data")
    return rows.groupBy("source_id").transformWithStateInPandas(
        statefulProcessor=_Batcher(batch_samples), outputStructType=BATCHES, outputMode="Append", timeMode="None"
    )
