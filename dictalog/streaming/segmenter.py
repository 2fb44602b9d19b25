"""Texts to drafts, one micro-batch after the other, with the state of each source kept between batches.

Gives the same drafts as ``operators.segmenter``. State per source: the last characters of the running text, where
its required words were last heard, where the last boundary ended, the open draft, and the text of the open draft as a list of appended pieces.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dictalog.functions.fuzzy import SPACES, Pattern, PhraseMatcher
from dictalog.functions.phrases import default_patterns
from dictalog.operators.segmenter import EXPIRY_S, FORCED, PART_CHARS, context_width, walk

OUTPUT = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # start, part, end, late
        T.StructField("source_id", T.StringType()),
        T.StructField("draft_id", T.StringType()),
        T.StructField("start_text", T.StringType()),
        T.StructField("end_text", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("audio_start_time", T.DoubleType()),
        T.StructField("audio_end_time", T.DoubleType()),
        T.StructField("forced", T.BooleanType()),
        T.StructField("opened_at", T.LongType()),
        T.StructField("part_no", T.LongType()),
    ]
)
_ONE_TEXT = T.StructType([T.StructField("v", T.StringType())])
_FRESH = {"pos": 0, "tail": "", "used": 0, "spans": [], "heard": {}, "prev_end": None, "seq": None, "open": None}


class DraftSegmenter(StatefulProcessor):
    """Rows in: source_id, seq, text, audio_start_time, audio_end_time; a null text means the stream has stopped."""

    def __init__(self, patterns: list[Pattern], expiry_s: float, idle_ms: int | None, part_chars: int):
        self.patterns, self.expiry_s, self.idle_ms, self.part_chars = patterns, expiry_s, idle_ms, part_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", _ONE_TEXT)
        self.body = handle.getListState("body", _ONE_TEXT)
        self.matcher, self.width = PhraseMatcher(self.patterns), context_width(self.patterns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        columns = ("seq", "text", "audio_start_time", "audio_end_time")
        texts = sorted((r for pdf in rows for r in zip(*(pdf[c] for c in columns))), key=itemgetter(0))  # bounded by the micro-batch size
        st, pieces, out = self._load()
        for seq, text, start, end in texts:
            if st["seq"] is not None and seq <= st["seq"]:
                out.append(("late", key[0], None, None, None, text, start, end, False, None, None))
                continue
            st["seq"] = int(seq)
            if text is None:
                self._force(key[0], st, pieces, out)
            elif text:
                self._take(key[0], st, pieces, out, text, float(start), float(end))
        self._save(st, pieces)
        if self.idle_ms is not None and st["open"]:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(st["prev_end"] * 1000) + self.idle_ms)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        st, pieces, out = self._load()
        self._force(key[0], st, pieces, out)
        self._save(st, pieces)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass

    def _load(self):
        st = json.loads(self.cursor.get()[0]) if self.cursor.exists() else {**_FRESH, "spans": [], "heard": {}}
        return st, {"fresh": [], "reset": False}, []

    def _save(self, st, pieces) -> None:
        self.cursor.update((json.dumps(st),))
        if pieces["reset"]:
            self.body.clear()
        if pieces["fresh"]:
            self.body.appendList([(p,) for p in pieces["fresh"]])

    def _body_text(self, pieces) -> str:
        stored = [] if pieces["reset"] else [r[0] for r in self.body.get()]
        return "".join(stored + pieces["fresh"])

    def _take(self, source, st, pieces, out, text, start, end) -> None:
        stale = st["prev_end"] is not None and end - st["prev_end"] > self.expiry_s
        pad = " " if st["tail"] and st["tail"][-1] not in SPACES and text[0] not in SPACES else ""
        ctx = "" if stale or not st["pos"] else (st["tail"] + pad)[-self.width :]
        if stale:
            ctx = ""
        at = st["pos"] + len(pad)  # absolute start of this text
        lo = at - len(ctx)
        st["spans"] = [s for s in st["spans"] if s[0] > lo] + [[at + len(text), start]]
        cut = 0  # characters of this text (after the pad) already given to a draft or dropped
        lead = pad
        # a state saved by an earlier release has no "heard"
        st["heard"] = {q: (n, t) for q, (n, t) in st.get("heard", {}).items() if end - t <= self.expiry_s}
        heard = {q: n - lo for q, (n, t) in st["heard"].items() if n >= st["used"]}
        for m, a, b, said in walk(self.matcher, ctx + text, len(ctx), max(0, st["used"] - lo), heard):
            a, b = lo + a, lo + b
            st["used"] = b
            if st["open"]:
                body = self._body_text(pieces) + lead + text[cut : max(cut, a - at)]
                body = body[: a - st["open"]["body_start"]]
                self._emit_end(source, st, pieces, out, body, said, end, False)
            if m.kind == "start":
                first = next(s for e, s in st["spans"] if e > a)
                st["open"] = {"at": a, "body_start": b, "said": said, "first": first, "chars": 0, "part": 0}
                out.append(("start", source, _ident(source, a), said, None, None, first, None, False, a, 0))
            cut, lead = b - at, ""
        if st["open"]:
            pieces["fresh"].append(lead + text[cut:])
            st["open"]["chars"] += len(lead) + len(text) - cut
            if st["open"]["chars"] > self.part_chars:
                self._emit_part(source, st["open"], pieces, out)
        st["tail"] = (("" if stale else st["tail"]) + pad + text)[-self.width :]
        st["heard"].update({q: (at + n, end) for q, n in self.matcher.required_at(text).items()})
        st["pos"] = at + len(text)
        st["prev_end"] = end

    def _force(self, source, st, pieces, out) -> None:
        if st["open"]:
            self._emit_end(source, st, pieces, out, self._body_text(pieces), FORCED, st["prev_end"], True)

    def _emit_part(self, source, o, pieces, out) -> None:
        """Hand on the text of a very long draft but for its last characters, which a boundary may still claim."""
        text = self._body_text(pieces)
        done, kept = text[: -self.width], text[-self.width :]
        out.append(("part", source, _ident(source, o["at"]), o["said"], None, done, o["first"], None, False, o["at"], o["part"]))
        o.update(body_start=o["body_start"] + len(done), chars=len(kept), part=o["part"] + 1)
        pieces["fresh"], pieces["reset"] = [kept], True

    def _emit_end(self, source, st, pieces, out, body, said, end, forced) -> None:
        o = st["open"]
        out.append(("end", source, _ident(source, o["at"]), o["said"], said, body, o["first"], end, forced, o["at"], o["part"]))
        st["open"] = None
        pieces["fresh"], pieces["reset"] = [], True

    @staticmethod
    def _frame(out):
        import pandas as pd

        made = {}
        for f, values in zip(OUTPUT.fields, zip(*out)):
            if isinstance(f.dataType, T.LongType):
                made[f.name] = pd.array(values, "Int64")
            elif isinstance(f.dataType, T.DoubleType):
                made[f.name] = np.array(values, np.float64)
            else:
                made[f.name] = np.array(values, object)
        return pd.DataFrame(made, copy=False)


def _ident(source: str, opened_at: int) -> str:
    return hashlib.sha256(f"{source}#{opened_at}".encode()).hexdigest()


def stream_drafts(
    texts: DataFrame,
    patterns: list[Pattern] | None = None,
    expiry_s: float = EXPIRY_S,
    idle_s: float | None = None,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Draft events of a text stream. Give ``idle_s`` (and a watermark on the input) to end drafts of silent sources.

    The text of a draft beyond ``part_chars`` is handed on in ``part`` events before its end, so state stays bounded; the
    end event holds what is left.
    """
    idle_ms = None if idle_s is None else int(idle_s * 1000)
    return texts.groupBy("source_id").transformWithStateInPandas(
        statefulProcessor=DraftSegmenter(patterns or default_patterns(), expiry_s, idle_ms, part_chars),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None" if idle_s is None else "EventTime",
    )
