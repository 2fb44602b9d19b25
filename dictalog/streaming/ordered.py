"""Rows of a stream in event-time order, held in slots of time."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_SLOT = T.StructType([T.StructField("slot", T.LongType())])
_BLOB = T.StructType([T.StructField("v", T.BinaryType())])
_TEXT = T.StructType([T.StructField("v", T.StringType())])
#: (time in microseconds, order among equal times, id, fields)
Row = tuple[int, int, object, tuple]


def _place(row: Row) -> tuple:
    """Order of rows: time, priority, id (none last)."""
    return row[0], row[1], row[2] is None, row[2] if row[2] is not None else 0


class Slots:
    """Rows of one source in a map state, keyed by slot of time: adding, reading a range and forgetting touch only the slots concerned."""

    def __init__(self, state, width_us: int):
        self.state, self.width = state, width_us
        self.new: dict[int, list[Row]] = {}

    def add(self, row: Row) -> None:
        self.new.setdefault(row[0] // self.width, []).append(row)

    def between(self, low: int, high: int) -> list[Row]:
        """Rows with low <= time <= high, in order."""
        found = [r for slot in self._slots() if low // self.width <= slot <= high // self.width for r in self._rows(slot)]
        return sorted((r for r in found if low <= r[0] <= high), key=_place)

    def take(self, upto: int) -> list[Row]:
        """Rows up to a time, in order; they leave the state."""
        out: list[Row] = []
        for slot in self._slots():
            if slot <= upto // self.width:
                rows = self._rows(slot)
                self._drop(slot)
                out += [r for r in rows if r[0] <= upto]
                for r in rows:
                    if r[0] > upto:
                        self.add(r)
        return sorted(out, key=_place)

    def first(self) -> int | None:
        slots = self._slots()
        return min(r[0] for r in self._rows(slots[0])) if slots else None

    def drop_before(self, time: int) -> None:
        """Forget the slots that end before a time."""
        for slot in self._slots():
            if (slot + 1) * self.width <= time:
                self._drop(slot)

    def clear(self) -> None:
        self.new.clear()
        self.state.clear()

    def save(self) -> None:
        for slot in list(self.new):
            self.state.updateValue((slot,), (pickle.dumps(self._rows(slot)),))
        self.new.clear()

    def _slots(self) -> list[int]:
        return sorted({k[0] for k in self.state.keys()} | self.new.keys())

    def _rows(self, slot: int) -> list[Row]:
        kept = self.state.getValue((slot,)) if self.state.containsKey((slot,)) else None
        return (pickle.loads(bytes(kept[0])) if kept else []) + self.new.get(slot, [])

    def _drop(self, slot: int) -> None:
        self.new.pop(slot, None)
        if self.state.containsKey((slot,)):
            self.state.removeKey((slot,))


class InOrder(StatefulProcessor):
    """Hands rows on to ``step`` in the order (time, priority, id), once the watermark has passed them.

    ``ring`` holds what a step keeps for later, ``reach_us`` back at most. A step returns output rows without the source. The input has
    ``ts_us``, ``prio`` and ``ident``, and ``fields``; arrays of samples travel as bytes.
    """

    fields: tuple[str, ...] = ()
    output: T.StructType
    fresh: dict = {}
    reach_us = 0
    slot_us = 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting_state = handle.getMapState("waiting", _SLOT, _BLOB)
        self.ring_state = handle.getMapState("ring", _SLOT, _BLOB)
        self.memo = handle.getValueState("memo", _TEXT)

    def step(self, memory: dict, row: Row, ring: Slots) -> list[tuple]:
        raise NotImplementedError

    def due(self, memory: dict, upto_us: int) -> tuple[list[tuple], int | None]:
        """Rows that are due by a time without a row of the input, and the next time to look (microseconds)."""
        return [], None

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        waiting, first = Slots(self.waiting_state, self.slot_us), None
        for pdf in rows:
            for ts, prio, ident, *rest in zip(*(pdf[c] for c in ("ts_us", "prio", "ident", *self.fields))):
                waiting.add((int(ts), int(prio), _plain(ident), tuple(map(_plain, rest))))
                first = int(ts) if first is None else min(first, int(ts))
        waiting.save()
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()  # rows come when they are due; an empty frame a key would cost more than the key's rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        waiting, ring = Slots(self.waiting_state, self.slot_us), Slots(self.ring_state, self.slot_us)
        memory = json.loads(self.memo.get()[0]) if self.memo.exists() else dict(self.fresh)
        out: list[tuple] = []
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        ready = waiting.take(upto)
        for row in ready:
            out += self.step(memory, row, ring)
        if ready:
            ring.drop_before(ready[-1][0] - self.reach_us)
        more, wake = self.due(memory, upto)
        out += more
        waiting.save()
        ring.save()
        self.memo.update((json.dumps(memory),))
        for at in (waiting.first(), wake):
            if at is not None:
                self.handle.registerTimer(at // 1000 + 1)
        if out:
            yield self._frame(key[0], out)

    def close(self) -> None:
        pass

    def _frame(self, source: str, out: list[tuple]):
        import pandas as pd

        pdf = pd.DataFrame([(source, *r) for r in out], columns=self.output.names, dtype=object)
        for f in self.output.fields:
            if isinstance(f.dataType, (T.LongType, T.IntegerType)):
                pdf[f.name] = pdf[f.name].astype("Int64")
            elif isinstance(f.dataType, T.TimestampType):
                pdf[f.name] = pd.to_datetime(pdf[f.name], unit="us")
        return pdf


def _plain(v):
    """A plain Python value (pandas shows whole numbers with nulls as floats); samples as bytes."""
    if isinstance(v, (list, np.ndarray)):
        return np.asarray(v, np.float32).tobytes()
    if v is None or v != v:
        return None
    return v.item() if hasattr(v, "item") else v


def samples_of(data: bytes | None) -> np.ndarray | None:
    return None if data is None else np.frombuffer(data, np.float32)
