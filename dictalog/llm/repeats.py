"""Repeated windows of a fixed length anywhere in a corpus, found in shards that need not see each other.

Every window of ``length`` units (bytes or words) has a key: the smallest hash of the ``gram``-unit stretches in it. Equal
windows have equal keys, so only windows of one key need be compared. Consecutive windows of a document with one key
are a run; its text is a piece. A key whose smallest stretch stands in one place only cannot repeat and goes at once; equal pieces are counted, not compared.
What is left, the different pieces of one key, goes to shards by key, where the operator's index judges each window.
A key with more than ``heavy`` units is not sent to one task: its windows are counted by a 128-bit hash instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dictalog.llm import batches as B
from dictalog.llm.rows import fields_of, numbered, struct_of
from dictalog.session import materialize

RUNS = "rid long, start int, n int, places int, key long, ha long, hb long"
PIECES = "key long, ha long, hb long, c long, n int, body binary"
FOUND = "ha long, hb long, rel int, n int"


@dataclass(frozen=True)
class Repeats:
    """How to find repeats: units of a text column, window and gram length, and the index that judges a shard."""

    length: int
    gram: int
    units: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    """A text column to its units (of one numpy type) and the documents' offsets."""
    values: Callable[[np.ndarray], np.ndarray]
    """Units to 64-bit values for hashing; different units have different values."""
    judge: Callable[[list[np.ndarray], np.ndarray, int], list[np.ndarray]]
    """(pieces, how often each stands in the corpus, length): for each piece, which of its windows occur twice or more."""
    dtype: type
    block: int
    """Units that are judged together (more if one key has more)."""
    heavy: int
    """Units of a key beyond which its windows are counted one by one."""


def window_runs(values: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key: document, start in it, number of windows, places of the smallest stretch, key, two hashes of the piece."""
    n = len(values) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, B.U64),) * 3
    first, second = B.Rolling(values, 0), B.Rolling(values, 1)
    grams, width = first.grams(gram), length - gram + 1
    key = B.sliding_min(grams, width)
    doc = B.doc_of_unit(off)[:n]
    inside = off[doc + 1] - np.arange(n) >= length
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(inside & new)
    last = np.ones(n, bool)
    last[:-1] = new[1:] | ~inside[1:]
    ends = np.flatnonzero(inside & last) + 1
    to = ends + length - 1
    places = _places(grams, key, width, starts, ends)
    return doc[starts], starts - off[doc[starts]], ends - starts, places, key[starts], first.of(starts, to), second.of(starts, to)


def _places(grams: np.ndarray, key: np.ndarray, width: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many times the key of each run stands in it (more than once in periodic text only)."""
    edge = np.full(width - 1, np.iinfo(np.uint64).max, B.U64)
    lowest = np.flatnonzero(~B.sliding_min(np.concatenate((edge, ~key, edge)), width) == grams)  # of some window
    names, name = np.unique(grams[lowest], return_inverse=True)
    ranked = np.sort(name * len(grams) + lowest)
    base = np.searchsorted(names, key[starts]) * len(grams)
    return np.searchsorted(ranked, base + ends - 1 + width) - np.searchsorted(ranked, base + starts)


def _runs(r: Repeats, column: pa.Array) -> tuple[np.ndarray, ...]:
    units, off = r.units(column)
    return window_runs(r.values(units), off, r.length, r.gram)


def _runs_of(r: Repeats):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(parts):
            doc, start, n, places, key, ha, hb = _runs(r, b.column("text"))
            if len(doc):
                rid = b.column("rid").to_numpy()[doc]
                columns = [rid, *(x.astype(np.int32) for x in (start, n, places)), *(B.signed(x) for x in (key, ha, hb))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["rid", "start", "n", "places", "key", "ha", "hb"])

    return run


def _cut(r: Repeats):
    """Documents with the pieces asked of them to the pieces' bodies."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(parts):
            units, off = r.units(b.column("text"))
            asked = b.column("asked")
            flat, counts = asked.flatten(), np.diff(asked.offsets.to_numpy())
            start, n = (flat.field(f).to_numpy() for f in ("start", "n"))
            at = off[np.repeat(np.arange(b.num_rows), counts)] + start
            bodies = [units[i : i + m + r.length - 1].tobytes() for i, m in zip(at, n)]
            kept = [flat.field(f) for f in ("key", "ha", "hb", "c", "n")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bodies, pa.binary())], ["key", "ha", "hb", "c", "n", "body"])

    return run


def _found(ha: list[int], hb: list[int], marks: list[np.ndarray]) -> pa.RecordBatch:
    """Runs of marked windows of each piece as rows."""
    which, rel, n = [], [], []
    for i, m in enumerate(marks):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], m.astype(np.int8), [0]))))
        which.append(np.full(len(edge) // 2, i))
        rel.append(edge[::2])
        n.append(edge[1::2] - edge[::2])
    at = np.concatenate(which) if which else np.zeros(0, np.int64)
    cols = [np.asarray(ha, np.int64)[at], np.asarray(hb, np.int64)[at], *(np.concatenate(x or [np.zeros(0)]).astype(np.int32) for x in (rel, n))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["ha", "hb", "rel", "n"])


def _judged(r: Repeats):
    """Rows sorted by key to the repeated windows of each piece; whole keys are judged together, some at a time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        units = 0

        def flush():
            marks = r.judge([np.frombuffer(x[4], r.dtype) for x in rows], np.array([x[3] for x in rows]), r.length)
            return _found([x[1] for x in rows], [x[2] for x in rows], marks)

        for b in parts:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "ha", "hb", "c", "body", "n"))):
                if units >= r.block and row[0] != rows[-1][0]:
                    yield flush()
                    rows, units = [], 0
                rows.append(row)
                units += row[5] + r.length - 1
        if rows:
            yield flush()

    return run


def _windows(r: Repeats):
    """Every window of a piece as a row of its own (for keys too large for one task)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(b.num_rows):
                values = r.values(np.frombuffer(b.column("body")[i].as_py(), r.dtype))
                at = np.arange(b.column("n")[i].as_py())
                cols = [B.signed(B.Rolling(values, w).of(at, at + r.length)) for w in (0, 1)]
                same = [np.full(len(at), b.column(c)[i].as_py()) for c in ("ha", "hb", "c")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, *same, at.astype(np.int32))], ["wa", "wb", "ha", "hb", "c", "rel"])

    return run


def repeated_windows(docs: DataFrame, r: Repeats) -> DataFrame:
    """(rid, start, n): every run of n window starts in document ``rid`` whose windows occur twice or more.

    ``docs`` has rid (unique) and text, and is read more than once: it must be a table scan or the like.
    """
    spark = docs.sparkSession
    runs = materialize(docs.mapInArrow(_runs_of(r), RUNS), "runs")
    again = runs.groupBy("key").agg(F.sum("places").alias("times")).filter("times > 1").select("key")
    runs = materialize(runs.join(again, "key"), "repeated-runs")

    some = lambda c: F.first(c).alias(c)  # noqa: E731  equal pieces have the same text, so any of them will do
    pieces = materialize(runs.groupBy("ha", "hb").agg(F.count(F.lit(1)).alias("c"), some("key"), some("n"), some("places"), some("rid"), some("start")), "pieces")
    keys = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("d"), F.max("places").alias("places"), F.sum(F.col("n") + r.length - 1).alias("units"))
    whole = pieces.filter("c > 1").select("ha", "hb", F.lit(0).alias("rel"), "n")
    open_keys = keys.filter("d > 1 or places > 1").select("key", "units")
    asked = materialize(pieces.join(open_keys, "key"), "asked")
    total = asked.agg(F.sum(F.col("n") + r.length - 1)).first()[0] or 0

    by_doc = asked.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "key", "ha", "hb", "c", (F.col("units") > r.heavy).alias("large"))).alias("asked"))
    texts = docs.select("rid", "text").join(by_doc, "rid")
    part = lambda large: texts.withColumn("asked", F.filter("asked", lambda x: x["large"] == F.lit(large))).filter("size(asked) > 0")
    shards = max(1, -(-total // (4 * r.block)))
    light = part(False).mapInArrow(_cut(r), PIECES).repartition(shards, "key").sortWithinPartitions("key")
    found = light.mapInArrow(_judged(r), FOUND)
    if asked.filter(F.col("units") > r.heavy).limit(1).count():
        rows = part(True).mapInArrow(_cut(r), PIECES).mapInArrow(_windows(r), "wa long, wb long, ha long, hb long, c long, rel int")
        rows = materialize(rows, "windows")
        twice = rows.groupBy("wa", "wb").agg(F.sum("c").alias("times")).filter("times > 1").select("wa", "wb")
        found = found.unionByName(rows.join(twice, ["wa", "wb"]).select("ha", "hb", "rel", F.lit(1).alias("n")))
    found = materialize(found, "found").unionByName(whole.withColumn("rel", F.col("rel").cast("int")))
    return runs.select("rid", "start", "ha", "hb").join(found, ["ha", "hb"]).select("rid", (F.col("start") + F.col("rel")).alias("start"), "n")


def with_marks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with the list of their repeated window runs (null where none)."""
    by_doc = found.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    return docs.join(by_doc, "rid", "left")


def covered(b: pa.RecordBatch, off: np.ndarray, length: int) -> np.ndarray:
    """For each unit of the batch, whether a repeated window covers it."""
    marks = b.column("marks")
    edge = np.zeros(off[-1] + 1, np.int64)
    flat = marks.flatten()
    counts = np.zeros(b.num_rows, np.int64)
    if len(flat):
        import pyarrow.compute as pc

        counts = pc.fill_null(pc.list_value_length(marks), 0).to_numpy()
        at = off[np.repeat(np.arange(b.num_rows), counts)] + flat.field("start").to_numpy()
        np.add.at(edge, at, 1)
        np.subtract.at(edge, at + flat.field("n").to_numpy() + length - 1, 1)
    return np.cumsum(edge[:-1]) > 0


def without_repeats(docs: DataFrame, r: Repeats, cut: Callable[[pa.RecordBatch, Repeats], list[pa.Array]], made: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` with the columns ``made`` (name: type), computed by ``cut`` from each batch, in place of its text."""
    rest = [c for c in docs.columns if c != text and c not in made]
    rows, rid = numbered(docs)
    base = rows.select(
        F.col(rid).alias("rid"),
        F.col(f"`{text}`").cast("string").alias("text"),
        struct_of(docs, rest).alias("rest"),
    )
    found = repeated_windows(base.select("rid", "text"), r)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(parts):
            yield pa.RecordBatch.from_arrays([b.column("rest"), *cut(b, r)], ["rest", *made])

    schema = T.StructType([T.StructField("rest", base.schema["rest"].dataType), *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in made.items()))])
    out = with_marks(base, found).mapInArrow(run, schema)
    return out.select(*fields_of("rest", rest), *made)
