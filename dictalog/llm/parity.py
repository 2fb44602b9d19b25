"""Operator 7: documents linked by the Jaccard similarity of their 5-word shingles, joined by parity sketches.

A set of size s has a sparse bit sketch of about s / 3 blocks: each shingle flips one bit of one block. A shingle in only one of two sets
changes one block at most, so blocks that differ are no more than the symmetric difference, which for linked sets is at most (a + b) / 7.
A set with more filled blocks than that agrees with any linked set in a filled block. Bands of sizes fix the number of blocks: a set
is sketched for its own band and for the next, where larger partners are. Sets with too few filled blocks have their
shingles as blocks of one too.

Equal sets are one node. Blocks go to buckets packed, as (block hash, set) pairs; a bucket gives the pairs of the sets that share a block. A block
shared by many sets is *large*: its sets are linked to one of them where similar enough. The sets of large blocks that still hold more than one component get
a second sketch, whose blocks have one shingle each: a linked pair whose agreement lies in large blocks mostly shares shingles that are rare. What is
left shares large shingles only, at least three quarters of both sets; only such sets are compared with those of their large blocks in other components. So every link
that could join components is settled. A dense sketch, of two to eight parity bits for each shingle, rejects most pairs by its Hamming distance; the rest is verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictalog.llm import batches as B
from dictalog.llm.graphs import components
from dictalog.llm.rows import numbered, without
from dictalog.session import materialize

WORDS = 5
#: Bits of the smallest dense sketch.
BITS = 256
#: Linked: NUM / DEN at least.
NUM, DEN = 3, 4
#: Most ids (8 bytes each) sent to all executors.
BROADCAST_IDS = 2_000_000
#: Blocks of a set that are known wherever it is compared.
MET = 16


@dataclass(frozen=True)
class Settings:
    few: int = 8
    """A block of more sets is large."""
    bucket: int = 300_000
    """Shingles per bucket aimed at."""
    buffer: int = 2_000_000
    """Text bytes whose blocks are packed together."""


def shingles(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (lower case A-Z; a shorter text is one shingle; without words none)."""
    data, off = B.text_bytes(column)
    data = B.lower_ascii(data)
    starts, ends, at = B.word_bounds(data, off)
    roll = B.Rolling(B.word_values(data, starts, ends))
    grams = roll.grams(words)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s >= words:
            out.append(np.unique(grams[s : e - words + 1]))
        else:
            out.append(roll.of(np.array([s]), np.array([e])) if e > s else np.zeros(0, B.U64))
    return out


def _tops() -> np.ndarray:
    """The largest size of each band: sets in one band link with sets in it and in the two next to it only."""
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, tops[-1] * DEN // NUM))
    return np.array(tops)


TOPS = _tops()


def most_apart(size: int, band: int) -> int:
    """The largest symmetric difference of a set and a linked one that is not above the band."""
    partner = min(size * DEN // NUM, int(TOPS[band]))
    return (size + partner) * (DEN - NUM) // (DEN + NUM)


def blocks(tokens: np.ndarray, band: int) -> tuple[np.ndarray, int]:
    """Hashes of the filled blocks of a set's sketch for a band (with single shingles if they are too few), and the number of filled blocks."""
    n_blocks = -(-int(TOPS[band]) // 3)
    block = (B.mix(tokens ^ B.U64(0xA5A5A5A5)) % B.U64(n_blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, bits = block[order], B.mix(tokens[order])
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    content = np.bitwise_xor.reduceat(bits, first)
    seed = B.U64(2 * band + 1)
    keys = B.mix(content + B.mix(block[first].astype(B.U64) * B.U64(0x9E3779B97F4A7C15) + seed))
    filled = len(keys)
    if filled <= most_apart(len(tokens), band):
        keys = np.concatenate((keys, B.mix(tokens + B.mix(np.array([seed + B.U64(1)])))))
    return keys, filled


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity bits as longs: a power of two of them, two for each shingle at least (four up to 512 shingles)."""
    bits = max(BITS, 1 << ((4 if len(tokens) <= 512 else 2) * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & B.U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


SETS = "rid long, n long, sa long, sb long, name long, spare long, above long, sketch array<long>"


def _sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """spare: filled blocks in the own band beyond the largest difference (0 or less: too few). above: in the next band."""
    for b in B.slices(parts):
        sets = shingles(b.column("text"))
        n = np.array([len(s) for s in sets], np.int64)
        sa, sb, name, spare, above = (np.zeros(len(n), np.int64) for _ in range(5))
        sketches: list[np.ndarray | None] = [None] * len(n)
        for i, s in enumerate(sets):
            if len(s):
                band = int(np.searchsorted(TOPS, len(s)))
                sa[i], sb[i] = (B.signed(B.mix(s + B.U64(k)).sum(keepdims=True))[0] for k in (1, 2))
                name[i] = _named(s)
                spare[i], above[i] = (blocks(s, k)[1] - most_apart(len(s), k) for k in (band, band + 1))
                sketches[i] = _sketch(s)
        yield pa.RecordBatch.from_arrays([b.column("rid"), *map(pa.array, (n, sa, sb, name, spare, above)), pa.array(sketches, pa.list_(pa.int64()))], ["rid", "n", "sa", "sb", "name", "spare", "above", "sketch"])


def _named(tokens: np.ndarray) -> int:
    """A set's name in the buckets: a hash, with the logarithm of its size in the last 16 bits. Sets of one name are told apart later."""
    sa = int(B.signed(B.mix(tokens + B.U64(1)).sum(keepdims=True))[0])
    return (sa & ~0xFFFF) | int(np.log(len(tokens)) * SIZE_SCALE)


SIZE_SCALE = 2000
#: Names of linked sets differ by so much in the last 16 bits at most.
SIZE_REACH = int(np.log(DEN / NUM) * SIZE_SCALE) + 2

PACKED = "bucket int, packed binary"


def _pack(n_buckets: int, s: Settings, single: bool = False):
    """Texts to packed blocks by bucket; ``single``: blocks of one shingle. Of a block that is large within the buffer some sets go to its bucket, so that it is
    known as large there, and all go on together with the buffer's other large blocks, to a bucket of no key."""

    def emit(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([f[0] for f in found])
        sets = np.array([f[1] for f in found], np.int64)
        which = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        own = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
        order = np.argsort(keys, kind="stable")
        keys, which, own = keys[order], which[order], own[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(first, len(keys)))
        place = np.arange(len(keys)) - np.repeat(first, size)
        large = np.repeat(size > s.few, size)
        ids, packed = [], []
        if large.any():
            head = np.array([-1, large.sum()], np.int64)
            packed.append(head.tobytes() + keys[large].tobytes() + sets[which[large]].tobytes() + own[large].tobytes())
            ids.append(n_buckets + int(keys[0] % B.U64(n_buckets)))
        stay = ~large | (place <= s.few)
        keys, which, own = keys[stay], which[stay], own[stay]
        bucket = (keys % B.U64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, which, own, bucket = keys[order], which[order], own[order], bucket[order]
        bounds = np.searchsorted(bucket, np.arange(n_buckets + 1))
        for i in range(n_buckets):
            a, e = bounds[i], bounds[i + 1]
            if e > a:
                local, index = np.unique(which[a:e], return_inverse=True)
                head = np.array([len(local), e - a], np.int64)
                tag = (index.astype(np.uint32) << np.uint32(1)) | own[a:e].astype(np.uint32)
                tag = tag.astype(np.uint16) if len(local) < 1 << 15 else tag
                packed.append(head.tobytes() + sets[local].tobytes() + (keys[a:e] >> B.U64(32)).astype(np.uint32).tobytes() + tag.tobytes())
                ids.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "packed"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen, size = [], set(), 0
        for b in B.slices(parts):
            for t in shingles(b.column("text")):
                if not len(t):
                    continue
                name, other = _named(t), int(B.mix(t + B.U64(2)).sum())
                if (name, other) in seen:  # a copy within the buffer
                    continue
                seen.add((name, other))
                if single:
                    found.append((B.mix(t + B.U64(3)), name, True))
                    continue
                band = int(np.searchsorted(TOPS, len(t)))
                found += [(blocks(t, band)[0], name, True), (blocks(t, band + 1)[0], name, False)]
            size += len(B.text_bytes(b.column("text"))[0])
            if size >= s.buffer and found:
                yield from emit(found)
                found, seen, size = [], set(), 0
        if found:
            yield from emit(found)

    return run


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n_sets, n = np.frombuffer(data, np.int64, 2)
    sets = np.frombuffer(data, np.int64, n_sets, 16)
    keys = np.frombuffer(data, np.uint32, n, 16 + 8 * n_sets)
    tag = np.frombuffer(data, np.uint16 if n_sets < 1 << 15 else np.uint32, n, 16 + 8 * n_sets + 4 * n)
    return keys, sets[tag >> 1], (tag & 1).astype(bool)


SHARED = "key long, a long, b long, own boolean"


def _share(few: int, single: bool):
    """Packed blocks, sorted by bucket, to pairs (a, b) of sets that share a small block, once a bucket, and (key, a) of large ones (``single``: the number of its
    large blocks as the key, once for each set)."""

    def emit(bucket: int, found: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, sets, own = (np.concatenate(x) for x in zip(*map(_unpack, found)))
        order = np.lexsort((sets, keys))
        keys, sets, own = keys[order], sets[order], own[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
        keys, sets, own = keys[new], sets[new], own[new]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(first, len(keys)))
        pairs = []
        for n in range(2, few + 1):
            at = first[size == n]
            if len(at):
                members = sets[at[:, None] + np.arange(n)]
                i, j = np.triu_indices(n, 1)
                pairs.append(np.stack((members[:, i].ravel(), members[:, j].ravel()), 1))
        if pairs:
            p = np.concatenate(pairs)
            p = np.unique(p[np.abs((p[:, 0] & 0xFFFF) - (p[:, 1] & 0xFFFF)) <= SIZE_REACH], axis=0)
            none = pa.nulls(len(p), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), pa.nulls(len(p), pa.bool_())], ["key", "a", "b", "own"])
        large = np.repeat(size > few, size)
        if large.any() and single:
            k, n = np.unique(sets[large], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(k), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.bool_())], ["key", "a", "b", "own"])
        elif large.any():
            k = (keys[large].astype(np.int64) << 20) | (bucket & 0xFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sets[large]), pa.nulls(len(k), pa.int64()), pa.array(own[large])], ["key", "a", "b", "own"])

    return emit


def _shared(n_buckets: int, few: int, single: bool = False):
    emit = _share(few, single)

    def direct(packed: bytes) -> Iterator[pa.RecordBatch]:
        n = int(np.frombuffer(packed, np.int64, 1, 8)[0])
        full, sets = np.frombuffer(packed, np.uint64, n, 16), np.frombuffer(packed, np.int64, n, 16 + 8 * n)
        own = np.frombuffer(packed, bool, n, 16 + 16 * n)
        if single:  # those that stayed in their bucket are counted there
            place = np.arange(n) - np.repeat(*(lambda first: (first, np.diff(np.append(first, n))))(np.flatnonzero(np.concatenate(([True], full[1:] != full[:-1])))))
            k, count = np.unique(sets[place > few], return_counts=True)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(count), pa.array(k), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.bool_())], ["key", "a", "b", "own"])
            return
        k = ((full >> B.U64(32)).astype(np.int64) << 20) | ((full % B.U64(n_buckets)).astype(np.int64) & 0xFFFFF)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sets), pa.nulls(n, pa.int64()), pa.array(own)], ["key", "a", "b", "own"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = -1, []
        for b in parts:
            for bucket, packed in zip(b.column("bucket").to_pylist(), b.column("packed").to_pylist()):
                if bucket >= n_buckets:
                    yield from direct(packed)
                    continue
                if bucket != now and found:
                    yield from emit(now, found)
                    found = []
                now = bucket
                found.append(packed)
        if found:
            yield from emit(now, found)
        B.give_back()

    return run


def _verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: tuple[int | None, np.ndarray] = (None, np.zeros(0))
    for b in parts:
        at = 0
        sizes = np.cumsum(B.text_lengths(b.column("text_b")))
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + B.SLICE_BYTES, "right")))
            part = b.slice(at, to - at)
            at = to
            keep = np.zeros(part.num_rows, bool)
            for i, (a, other) in enumerate(zip(part.column("a").to_pylist(), shingles(part.column("text_b")))):
                if a != known[0]:
                    known = (a, shingles(part.column("text_a").slice(i, 1))[0])
                both = len(np.intersect1d(known[1], other, assume_unique=True))
                keep[i] = both * DEN >= (len(known[1]) + len(other) - both) * NUM
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))
        part = None
        B.give_back()


def _linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes those that are linked: by size, by parity bits, then on the texts."""
    size = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"))
    near = pairs.join(size("a"), "a").join(size("b"), "b").filter(near_sizes(F.col("n_a"), F.col("n_b"))).select("a", "b")
    near = materialize(near, "sized")  # one plan of all these joins would keep a thread and a broadcast of the driver for each at once
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    near = near.join(side("a"), "a").join(side("b"), "b").filter(may_link(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"))).select("a", "b")
    near = materialize(near, "near")
    asked = near.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    asked = materialize(texts_of(texts, asked), "asked-texts")
    side = lambda x: asked.select(F.col("rid").alias(x), F.col("text").alias(f"text_{x}"))
    full = near.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
    return materialize(full.mapInArrow(_verify, "a long, b long"), "links")


def texts_of(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The texts of some ids (rid). Ids are broadcast up to a checked number; beyond it the texts are shuffled to them."""
    asked = materialize(asked, "asked")
    return texts.join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, "rid")


def _open(large: DataFrame, group: DataFrame) -> DataFrame:
    """(key, node, component, most): the sets of large blocks that hold more than one component; most is the largest there."""
    member = large.join(group, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    sizes = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("key").agg(F.max(F.struct("size", "component"))["component"].alias("most"), F.count(F.lit(1)).alias("groups"))
    return member.join(most.filter("groups > 1"), "key").select("key", "node", "component", "most")


def _apart(member: DataFrame) -> DataFrame:
    """Pairs (a < b) of the sets of one block that are in different components and may link, each pair once or nearly so, however many blocks its sets share.

    ``member``: key, node, component, most (of the key), n, sketch, tight. Each set brings the first few of its blocks along. If two sets have some of these in
    common, they are compared in one of them only, which the pair chooses, so that no block gets all pairs; otherwise in every block that they share.
    """
    kept = member.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, MET).alias("keys"))
    member = materialize(member.join(kept, "node"), "met")
    x, y = member.filter("component != most").alias("x"), member.alias("y")
    larger = F.when(F.col("x.n") > F.col("y.n"), F.col("x.tight")).when(F.col("x.n") < F.col("y.n"), F.col("y.tight")).otherwise(F.col("x.tight") | F.col("y.tight"))
    once = (F.col("y.component") == F.col("y.most")) | (F.col("x.node") < F.col("y.node"))
    both = F.array_intersect("x.keys", "y.keys")
    chosen = F.try_element_at(both, (F.pmod(F.xxhash64(F.least("x.node", "y.node"), F.greatest("x.node", "y.node")), F.greatest(F.size(both), F.lit(1))) + 1).cast("int"))
    here = F.coalesce(chosen == F.col("x.key"), F.lit(True))
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & once & larger & near_sizes(F.col("x.n"), F.col("y.n")) & here
    pairs = x.join(y, apart & may_link(F.col("x.n"), F.col("y.n"), F.col("x.sketch"), F.col("y.sketch")))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def may_link(n_a: Column, n_b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Sizes near enough, and no more parity bits apart than the symmetric difference of linked sets can be.

    Sketches of such sizes differ by a factor of two at most; the larger is folded to the size of the smaller.
    """
    half = lambda x: F.zip_with(F.slice(x, 1, F.shiftright(F.size(x), 1)), F.slice(x, F.shiftright(F.size(x), 1) + 1, F.shiftright(F.size(x), 1)), lambda p, q: p.bitwiseXOR(q))
    a, b = sketch_a, sketch_b
    sketch_a, sketch_b = F.when(F.size(a) > F.size(b), half(a)).otherwise(a), F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    apart = F.aggregate(F.zip_with(sketch_a, sketch_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return near_sizes(n_a, n_b) & (apart * (DEN + NUM) <= (n_a + n_b) * (DEN - NUM))


def near_sizes(n_a: Column, n_b: Column) -> Column:
    return F.least(n_a, n_b) * DEN >= F.greatest(n_a, n_b) * NUM


def _shares(texts: DataFrame, total: int, s: Settings, single: bool = False) -> DataFrame:
    """What ``_share`` gives for the blocks of all texts; ``total`` shingles set the number of buckets."""
    n_buckets = max(1, -(-total // s.bucket))
    packed = texts.mapInArrow(_pack(n_buckets, s, single), PACKED).repartition(2 * n_buckets, "bucket").sortWithinPartitions("bucket")
    return materialize(packed.mapInArrow(_shared(n_buckets, s.few, single), SHARED), "shared")


def _pairs(shared: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of nodes (a < b) for pairs of names."""
    name = lambda x: names.select(F.col("sa").alias(x), F.col("node").alias(f"node_{x}"))
    pairs = shared.filter("b is not null").select("a", "b").distinct().join(name("a"), "a").join(name("b"), "b")
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings(), rid: str | None = None) -> DataFrame:
    """One row per row of ``docs``: rid, id, n_shingles, component_id (the smallest id reachable by links, the own included) and component (a rid).

    Null ids count last; a component of null ids only has a null id. Null and empty texts, and texts without words, link with nothing. Repeated rows and ids are
    documents of their own. rid is the column of that name (see ``rows.numbered``), or a new number.
    """
    docs, rid = numbered(docs, rid)
    base = docs.select(F.col(rid).alias("rid"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    texts = base.select("rid", "text")
    sets = materialize(texts.mapInArrow(_sets, SETS), "sets")
    filled = sets.filter("n > 0")
    # rows of one set differ in nothing but rid
    one = filled.groupBy("sa", "sb").agg(F.min("rid").alias("node"))
    nodes = filled.join(one.select("node"), F.col("rid") == F.col("node")).select("node", "n", "sa", "sb", "name", "spare", "above", "sketch")
    nodes = materialize(nodes, "nodes")

    shared = _shares(texts, sets.agg(F.sum("n")).first()[0] or 0, s)
    names = nodes.select(F.col("name").alias("sa"), "node")
    large = shared.filter("key is not null").select("key", F.col("a").alias("sa"), "own")
    large = materialize(large.groupBy("key", "sa").agg(F.max("own").alias("own")).join(names, "sa").select("key", "node", "own"), "large-blocks")
    stars = large.join(large.groupBy("key").agg(F.min("node").alias("a")), "key").filter("node != a").select("a", F.col("node").alias("b")).distinct()
    links = _linked(_pairs(shared, names).unionByName(stars).distinct(), nodes, texts)

    # pairs in large blocks that nothing joins yet: both sets may agree in nothing but large blocks of one band. By rare shingles, if they share some
    group = components(links)
    count = lambda own: F.sum((F.col("own") == own).cast("long"))
    of_large = large.groupBy("node").agg(count(True).alias("of_own"), count(False).alias("of_above"))
    tight = nodes.join(of_large, "node").select("node", "n", "name", "sketch", (F.col("spare") <= F.col("of_own")).alias("tight"), (F.col("above") <= F.col("of_above")).alias("partner"))
    tight = tight.filter(F.col("tight") | F.col("partner"))
    member = materialize(_open(large.join(tight.select("node"), "node"), group), "open-blocks")
    some = materialize(tight.join(member.select("node").distinct(), "node"), "tight")
    again = _shares(texts_of(texts, some.select(F.col("node").alias("rid"))), some.agg(F.sum("n")).first()[0] or 0, s, True)
    of = lambda x: group.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    pairs = _pairs(again, names).distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    pairs = pairs.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    links = _linked(pairs, nodes, texts)
    # else all that they share is frequent, three quarters of both at least, and the larger set needs its large blocks
    frequent = again.filter("key is not null").groupBy(F.col("a").alias("name")).agg(F.sum("key").alias("frequent"))
    info = some.join(frequent, "name").filter(F.col("frequent") * DEN >= F.col("n") * NUM).select("node", "n", "sketch", "tight")
    info = materialize(info, "frequent-sets")
    member = materialize(member.join(info, "node"), "frequent-only")
    links = links.unionByName(_linked(_apart(member), nodes, texts))

    # what is linked already is one link for each node
    group = components(links.unionByName(group.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    owner = sets.alias("s").join(nodes.alias("m"), (F.col("s.sa") == F.col("m.sa")) & (F.col("s.sb") == F.col("m.sb")) & (F.col("s.n") > 0), "left")
    owner = owner.select("s.rid", F.col("s.n").alias("n_shingles"), F.coalesce("m.node", "s.rid").alias("node"))
    owner = owner.join(group, "node", "left").select("rid", "n_shingles", F.coalesce("component", "node").alias("component"))
    owner = materialize(owner.join(base.select("rid", "id"), "rid"), "owners")  # its readers then have short plans: the driver holds those
    least = owner.groupBy("component").agg(F.min("id").alias("component_id"))
    return owner.join(least, "component").select("rid", "id", "n_shingles", "component_id", "component")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """``docs``, all columns, with one row of each group of linked texts: the one with the smallest id (null last), then the first row."""
    rows, rid = numbered(docs)
    groups = link_documents(rows, doc_id, text, s, rid)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first"))
    gone = materialize(groups.join(first, "component").filter("rid != first.rid").select("rid"), "gone")
    return without(rows, rid, gone)
