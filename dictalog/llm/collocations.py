"""Operator 13: phrases whose words belong together, counted exactly in the manner of Toivonen.

A sample of the documents proposes phrases. One pass over all documents counts the words, the proposed phrases and their negative border: every phrase of
k words both of whose parts of k - 1 words the sample has, proposed itself or not. A phrase on the border that turns out frequent, or a frequent word that the
sample didn't have, opens the way to longer phrases that nobody counted; a further pass counts those, length by length, until
nothing frequent is left outside what was counted.

These passes count hashes, packed by bucket, which is cheap to shuffle; phrases of one hash can only add up, so none that is frequent is lost. A last pass counts the words
of the phrases whose hashes are frequent, exactly. What tasks must know is sent to them as a bit filter of bounded size; what it lets through by mistake is counted too and does
no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dictalog.llm import batches as B
from dictalog.session import materialize

#: Bytes that end a piece of text: . , ; : ! ? and the line ends.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK = ENDS.copy()
BLANK[[0x20, 0x09]] = True
#: Exact for counts up to 10**16.
SCORE = "(1000000BD * CAST(a AS DECIMAL(16, 0)) * CAST(a AS DECIMAL(16, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"


@dataclass(frozen=True)
class Settings:
    longest: int = 3
    support: int = 10
    """Occurrences of a phrase at least."""
    within: int = 50
    """A phrase goes if a longer one around it has this percentage of its occurrences at least."""
    top: int = 2000
    """Phrases of each language."""
    sample: float = 0.1
    """Share of the documents that propose phrases (by hash of the text)."""
    slack: float = 0.8
    """The sample proposes what it has so many times as often as its share of ``support`` (once at least)."""
    filter_bits: int = 27
    """Power of two of the largest filter's bits: 16 MB."""
    buffer: int = 1_200_000
    """Phrases whose hashes are counted together in a task."""
    bucket: int = 4_000_000
    """Text bytes whose hashes are summed together, on average."""
    words: int = 3_000_000
    """Text bytes whose phrases are counted together in a task."""


class Bits:
    """A set of 64-bit hashes as bit fields; says yes for all of them and for few others."""

    def __init__(self, fields: list[np.ndarray]):
        self.fields = fields

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for words in self.fields:
            mask = B.U64(len(words) * 64 - 1)
            one = np.ones(len(h), bool)
            for at in (h & mask, (h >> B.U64(32)) & mask):
                one &= (words[(at >> B.U64(6)).astype(np.int64)] >> (at & B.U64(63))) & B.U64(1) != 0
            out |= one
        return out


def bits_of(grams: DataFrame, s: Settings) -> np.ndarray:
    """The hashes in ``grams`` as a bit field, 16 bits for each up to ``s.filter_bits``."""
    n = grams.count()
    power = min(s.filter_bits, max(10, (16 * n).bit_length()))
    mask = F.lit((1 << power) - 1).cast("long")
    places = F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask))
    at = grams.select(F.explode(places).alias("at")).select(F.shiftright("at", 6).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit"))
    rows = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


@dataclass
class _Words:
    """The words of some texts: their bytes, the number of each one's piece, and its hash (with the language's)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    own: np.ndarray

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray]]:
        """(k, hashes of the phrases at each place, those of k - 1 words, whether a phrase stands within a piece)."""
        hashes, part = self.own, None
        for k in range(1, min(longest, len(self.own)) + 1):
            n = len(self.own) - k + 1
            if k > 1:
                part, hashes = hashes, B.mix(hashes[:n] * B.U64(3) + self.own[k - 1 :])
            yield k, hashes, part, self.piece[:n] == self.piece[k - 1 :]


def _words(batch: pa.RecordBatch) -> _Words:
    data, off = B.text_bytes(batch.column("text"))
    data = B.lower_ascii(data)
    word = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    starts = np.flatnonzero(word & (~np.concatenate(([False], word[:-1])) | first[:-1]))
    ends = np.flatnonzero(word & (~np.concatenate((word[1:], [False])) | first[1:])) + 1
    cut = ENDS[data] | first[:-1]
    piece = np.cumsum(cut, dtype=np.int32)[starts] if len(data) else np.zeros(0, np.int32)
    langs = batch.column("lang").dictionary_encode()
    tags = np.array([_tag(x) for x in langs.dictionary.to_pylist()], np.uint64)
    doc = np.searchsorted(off, starts, "right") - 1
    own = B.mix(B.word_values(data, starts, ends) + tags[langs.indices.to_numpy()][doc]) if len(starts) else np.zeros(0, np.uint64)
    return _Words(data, starts, ends, piece, own)


def _tag(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() + b"\0", np.uint8)
    return B.word_values(data, np.zeros(1, np.int64), np.array([len(data)]))[0]


PACKED = "bucket int, size int, packed binary"


def _hash_counts(n_buckets: int, known: Bits | None, before: Bits | None, s: Settings):
    """Counts of hashed phrases, packed by bucket. At first words, and phrases both of whose parts are ``known`` (all without it); with ``before``
    only phrases both of whose parts are known now, not both of them before."""

    def emit(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for size, parts in held.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            bucket = (h % B.U64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            h, n, bucket = h[order], n[order].astype(np.uint32), bucket[order]
            which, first = np.unique(bucket, return_index=True)
            cuts = np.append(first, len(h)).tolist()
            for i in range(0, len(which), 64):
                packed = [h[a:e].tobytes() + n[a:e].tobytes() for a, e in zip(cuts[i : i + 64], cuts[i + 1 :])]
                yield pa.RecordBatch.from_arrays([pa.array(which[i : i + 64]), pa.array(np.full(len(packed), size, np.int32)), pa.array(packed, pa.binary())], ["bucket", "size", "packed"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for b in B.slices(parts):
            for k, hashes, part, ok in _words(b).grams(s.longest):
                if k > 1 and known is not None:
                    has = known.has(part)
                    ok &= has[:-1] & has[1:]
                    if before is not None:
                        had = before.has(part)
                        ok &= ~(had[:-1] & had[1:])
                if k > 1 or before is None:
                    held.setdefault(k, []).append(hashes[ok])
                    size += len(held[k][-1])
            if size >= s.buffer:
                yield from emit(held)
                held, size = {}, 0
        yield from emit(held)

    return run


def _sums(least: int):
    """Packed counts, sorted by bucket, to the hashes whose sum reaches ``least``."""

    def emit(size: int, found: list[bytes]) -> Iterator[pa.RecordBatch]:
        counts = [len(x) // 12 for x in found]
        h = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(found, counts)])
        c = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(found, counts)])
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        many = first[np.add.reduceat(c, first, dtype=np.int64) >= least]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(many), size, np.int32)), pa.array(B.signed(h[many]))], ["size", "hash"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for b in parts:
            for bucket, size, packed in zip(*(b.column(c).to_pylist() for c in ("bucket", "size", "packed"))):
                if now != (bucket, size) and found:
                    yield from emit(now[1], found)
                    found = []
                now = (bucket, size)
                found.append(packed)
        if found:
            yield from emit(now[1], found)

    return run


def _frequent(texts: DataFrame, n_buckets: int, least: int, known: Bits | None, before: Bits | None, s: Settings) -> DataFrame:
    """(size, hash) of what occurs ``least`` times; different phrases of one hash may come in together, none is left out."""
    packed = texts.mapInArrow(_hash_counts(n_buckets, known, before, s), PACKED).repartition("bucket").sortWithinPartitions("bucket", "size")
    return materialize(packed.mapInArrow(_sums(least), "size int, hash long"), "frequent")


COUNTED = "lang string, size int, phrase string, n long"


def _phrases(wanted: Bits, s: Settings):
    """Counts of the phrases whose hashes are ``wanted``, as words; and of all words as size 0."""

    def emit(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            words = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
            ids, words = words.indices.to_numpy().astype(np.int64), words.dictionary
            shift = np.cumsum([0] + [len(p[0]) for p in parts])
            for k in range(1, s.longest + 1):
                at = np.concatenate([p[1].get(k, np.zeros(0, np.int64)) + d for p, d in zip(parts, shift)])
                if not len(at):
                    continue
                first, counts = _distinct(ids, at, k, len(words))
                column = [words.take(pa.array(ids[first + j])) for j in range(k)]
                phrase = column[0] if k == 1 else pc.binary_join_element_wise(*column, pa.scalar(b" ", pa.large_binary()))
                yield _batch(lang, k, phrase.cast(pa.binary()).cast(pa.string(), safe=False), counts)
            yield _batch(lang, 0, pa.array([""]), np.array([len(ids)]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for b in B.slices(parts):
            for lang in pc.unique(b.column("lang")).to_pylist():
                w = _words(b.filter(pc.equal(b.column("lang"), lang)))
                places = {k: np.flatnonzero(ok & wanted.has(hashes)) for k, hashes, _, ok in w.grams(s.longest)}
                held.setdefault(lang, []).append((_column(w), places))
                size += len(w.data)
            if size >= s.words:
                yield from emit(held)
                held, size = {}, 0
        yield from emit(held)

    return run


def _column(w: _Words) -> pa.Array:
    """The words as an Arrow column: their bytes laid end to end."""
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.starts] += 1
    inside[w.ends] -= 1
    laid = w.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    off = np.concatenate(([0], np.cumsum(w.ends - w.starts)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.starts), [None, pa.py_buffer(off), pa.py_buffer(laid)])


def _distinct(ids: np.ndarray, at: np.ndarray, k: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and counts of the different phrases of k words that start at ``at``."""
    code = ids[at]
    for j in range(1, k):
        code, _ = pd.factorize(code)
        code = code * n_words + ids[at + j]
    code, _ = pd.factorize(code)
    n = np.bincount(code)
    first = np.zeros(len(n), np.int64)
    first[code[::-1]] = at[::-1]
    return first, n


def _batch(lang: str, size: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    rows = len(phrase)
    return pa.RecordBatch.from_arrays([pa.array([lang] * rows), pa.array(np.full(rows, size, np.int32)), phrase, pa.array(n.astype(np.int64))], ["lang", "size", "phrase", "n"])


def frequent_hashes(texts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(size, hash) of every phrase of up to ``s.longest`` words with ``s.support`` occurrences, and perhaps a few others. ``texts(lang, text)``."""
    n_buckets = max(1, (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // s.bucket)
    shorter = lambda grams: grams.filter(F.col("size") < s.longest).select("hash")
    chosen = texts.filter(F.pmod(F.xxhash64("text"), F.lit(10_000)) < int(10_000 * s.sample))
    proposed = _frequent(chosen, n_buckets, max(1, int(s.support * s.sample * s.slack)), None, None, replace(s, longest=s.longest - 1))
    known = Bits([bits_of(proposed, s)])
    found = _frequent(texts, n_buckets, s.support, known, None, s)
    total = found
    while True:
        missed = materialize(shorter(found).mapInArrow(_outside(known), "hash long"), "missed")
        if missed.isEmpty():  # closed: all that is frequent was counted, with its border
            return total
        now = Bits([*known.fields, bits_of(missed, s)])
        found = _frequent(texts, n_buckets, s.support, now, known, s)
        total, known = total.unionByName(found), now


def _outside(known: Bits):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            h = b.column("hash").to_numpy()
            yield b.filter(pa.array(~known.has(h.view(np.uint64))))

    return run


def phrase_counts(docs: DataFrame, s: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, size, phrase, n): all phrases of up to ``s.longest`` words with ``s.support`` occurrences in a language, and all its words as size 0."""
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    wanted = Bits([bits_of(frequent_hashes(texts, s), s)])
    sums = texts.mapInArrow(_phrases(wanted, s), COUNTED).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return materialize(sums.filter((F.col("n") >= s.support) | (F.col("size") == 0)), "counts")


def collocations(docs: DataFrame, s: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``s.top`` phrases of each language.

    Texts are split at ENDS into pieces, these at blanks into words; A-Z count as a-z. ``a`` is the number of occurrences of a phrase of two
    or more words within pieces (overlaps count), ``l`` and ``r`` of its two parts at the cut with the lowest score floor(1000000 * a * a / (l * r)) (ties: the
    first cut), ``n`` of all words of the language. A phrase goes if a longer one of ``s.support`` occurrences holds it and has ``s.within`` percent of its occurrences.
    Order: score and ``a`` descending, phrase by bytes. A null language is ``und``; null and empty texts have no words; repeated rows count each.
    """
    counts = phrase_counts(docs, s, text, lang)
    every = counts.filter("size > 0").select("lang", "phrase", "n")
    found = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    part = lambda at, n: F.array_join(F.slice(F.split("phrase", " "), at, n), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    if s.longest > 2:
        holes = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda at: part(at, k))))
        around = found.filter("size > 2").select("lang", F.explode(holes).alias("phrase"), "a")
        around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        scored = scored.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < s.within * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # first within parts of a language, so that a large one isn't one task
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("at", rank("lang", "part")).filter(F.col("at") <= s.top)
    best = few.withColumn("rank", rank("lang")).filter(F.col("rank") <= s.top)
    totals = counts.filter("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
