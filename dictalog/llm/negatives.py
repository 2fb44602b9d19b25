"""Operator 12: hard negatives by exact search in a GNAT (a multiway hyperplane tree).

A node of the tree has split points; each vector goes to the nearest, so the parts lie between hyperplanes. For every two split points the node keeps the
range of distances from the one to the vectors of the other's part. A search has a window of distances from its anchor, an annulus; a part all of
whose distances from some split point fall outside what the annulus allows there is left out. The leaves that remain are searched exactly.

Products become distances by one more component that makes all vectors one length, with which the largest product is the least distance. Split points are chosen on a
bounded sample; all vectors are in the leaves and all ranges cover them all. Leaves stand on shelves of bounded size. Each search runs twice: a first look at
some leaves tells how far the window must reach, then all the leaves in reach are read. Rows meet sorted by shelf: its vectors come first and are held, then the anchors
that ask for it stream past, so what a task holds depends neither on the number of vectors nor on that of the anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dictalog.session import materialize

#: Integer vectors of a larger squared length take no part: with them products could pass 64 bits.
MOST_SQUARED = float(1 << 62)
#: Stands for a null id in the order of ties, after all ids.
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 10
    low: int = 30
    """A negative has this percentage of the positive's score at least."""
    high: int = 90
    """And this at most."""
    degree: int = 16
    """Split points of the root; parts have as many as their share, two to four times that."""
    leaf: int = 512
    """Vectors per leaf aimed at."""
    most_leaves: int = 8192
    sample: int = 20_000
    """Vectors that split points are chosen from at most: those with the smallest hash of their id and label."""
    look: int = 4
    """Leaves that a first look reads for a window."""
    block: int = 1024
    """Vectors on a shelf."""
    seed: int = 12


@dataclass
class Node:
    points: np.ndarray
    parts: list[Node | int]
    """Below each split point a node, or a leaf's number."""
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    """[i, j]: the range of distances from split point i to the vectors of part j."""
    number: int = 0


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def _spread(x: np.ndarray, m: int, rng: np.random.Generator) -> np.ndarray:
    """m rows far from each other, out of three times as many drawn: each the farthest from those before it. Fewer if rows are equal."""
    some = x[rng.choice(len(x), min(len(x), 3 * m), replace=False)]
    chosen, near = [0], distances(some, some[:1])[:, 0]
    while len(chosen) < m and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


class Gnat:
    """The tree over a sample, with ranges that are filled in from all vectors."""

    def __init__(self, x: np.ndarray, per_leaf: int, s: Settings):
        self.nodes: list[Node] = []
        self.centres: list[np.ndarray] = []
        rng = np.random.default_rng(s.seed)
        self.root = self._grow(x, s.degree, per_leaf, s, rng, x[:1] if len(x) else np.zeros((1, x.shape[1])))

    def _grow(self, x: np.ndarray, degree: int, per_leaf: int, s: Settings, rng, centre: np.ndarray) -> Node | int:
        points = _spread(x, min(degree, len(x)), rng) if len(x) > per_leaf else centre
        if len(points) < 2:
            self.centres.append(centre[0])
            return len(self.centres) - 1
        node = Node(points, [], number=len(self.nodes))
        self.nodes.append(node)
        own = distances(x, points).argmin(1)
        for j in range(len(points)):
            share = (own == j).sum() / len(x) * degree * len(points)
            node.parts.append(self._grow(x[own == j], int(np.clip(share, 2, 4 * s.degree)), per_leaf, s, rng, points[j : j + 1]))
        m = len(points)
        node.low, node.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        return node

    def walk(self, x: np.ndarray) -> Iterator[tuple[Node, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows there, their distances from its points, the nearest point) for all nodes that rows come by."""
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int) or not len(rows):
                continue
            d = distances(x[rows], node.points)
            own = d.argmin(1)
            yield node, rows, d, own
            todo += [(part, rows[own == j]) for j, part in enumerate(node.parts)]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.root if isinstance(self.root, int) else 0, np.int32)
        for node, rows, _, own in self.walk(x):
            for j, part in enumerate(node.parts):
                if isinstance(part, int):
                    out[rows[own == j]] = part
        return out

    def reach(self, x: np.ndarray, near: np.ndarray, far: np.ndarray, slack: float) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves that may hold vectors at a distance from ``near`` to ``far``, each with the rows for which it may."""
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                yield node, rows
                continue
            d = distances(x[rows], node.points)
            # a vector at distance r from the anchor has one of |r - d| to r + d from the point
            least = np.maximum(np.maximum(d - far[rows, None], near[rows, None] - d), 0) - slack
            most = d + far[rows, None] + slack
            for j, part in enumerate(node.parts):
                ok = ((node.high[:, j] >= least) & (node.low[:, j] <= most)).all(1)
                if ok.any():
                    todo.append((part, rows[ok]))

    def within(self, x: np.ndarray, near: np.ndarray, far: np.ndarray, slack: float) -> np.ndarray:
        """Pairs (row, leaf) of ``reach``."""
        out = [np.stack((rows, np.full(len(rows), leaf)), 1) for leaf, rows in self.reach(x, near, far, slack)]
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _shelves(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """By leaf its first shelf and on how many it stands: neighbours share one while they have at most ``block`` vectors together, a larger leaf has some of its own."""
    first, width = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32)
    shelf = held = 0
    for leaf, n in enumerate(counts.tolist()):
        if held and held + n > block:
            shelf, held = shelf + 1, 0
        first[leaf], held = shelf, held + n
        if n > block:
            width[leaf] = -(-n // block)
            shelf, held = shelf + int(width[leaf]), 0
    return first, width


def integer_rows(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, q, squared): the rows that take part, components as floor(256 * x)."""
    v = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = v.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    large = F.aggregate(F.transform("x", lambda c: F.floor(256 * c).cast("double")), F.lit(0.0), lambda t, c: t + c * c)
    v = v.filter(large < MOST_SQUARED)
    relabelled = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    q = F.transform("x", lambda c: F.floor(256 * c).cast("long"))
    return v.select("vec_id", relabelled.alias("label"), q.alias("q")).withColumn("squared", F.aggregate("q", F.lit(0).cast("long"), lambda t, c: t + c * c))


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 0), kind)


def _longer(q: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack((q, np.sqrt(np.maximum(longest - (q * q).sum(1), 0))))


def _anchored(q: np.ndarray) -> np.ndarray:
    return np.column_stack((q, np.zeros(len(q))))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer rows."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


FOUND = "aid long, window int, score long, vec_id long"


def _best(found: list[np.ndarray], k: int) -> np.ndarray:
    """Of rows (aid, window, score, vec_id) the first k of each window."""
    x = np.concatenate(found)
    x = x[np.lexsort((x[:, 3], -x[:, 2], x[:, 1], x[:, 0]))]
    first = np.flatnonzero(np.concatenate(([True], (x[1:, :2] != x[:-1, :2]).any(1))))
    place = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return x[place < k]


def _padded(column: pa.Array, fill: int) -> np.ndarray:
    """Lists as rows of one length."""
    ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    out = np.full((len(column), int(np.diff(ends).max(initial=0))), fill, np.int64)
    for w in range(out.shape[1]):
        has = np.flatnonzero(np.diff(ends) > w)
        out[has, w] = column.flatten().to_numpy(zero_copy_only=False)[ends[has] + w]
    return out


#: Anchors compared with a shelf at once.
AT_ONCE = 256
#: Rows of anchors with shelves that leave Python at once.
ASKS = 4096
#: Rows that a task holds before it hands some on.
HELD_ROWS = 400_000


def _search(k: int, same: bool):
    """A shelf's vectors, then the anchors that ask for it: of the vectors of the same (or another) label within each window the first k."""

    def pick(asks: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> np.ndarray:
        aid, own, label = (asks.column(n).to_numpy(zero_copy_only=False) for n in ("aid", "vec_id", "label"))
        low, high = _padded(asks.column("low"), LAST), _padded(asks.column("high"), -LAST)
        scores = _products(_matrix(asks.column("q"), np.int64), q)
        fits = ((labels == label[:, None]) == same) & (ids != own[:, None])
        fits &= (scores >= low.min(1, initial=LAST)[:, None]) & (scores <= high.max(1, initial=-LAST)[:, None])
        i, j = np.nonzero(fits)
        s, out = scores[i, j], [np.zeros((0, 4), np.int64)]
        for w in range(low.shape[1]):
            ok = np.flatnonzero((s >= low[i, w]) & (s <= high[i, w]))
            out.append(np.stack((aid[i[ok]], np.full(len(ok), w), s[ok], ids[j[ok]]), 1))
        new = np.concatenate(out)
        return _best([new], k) if len(new) > k * len(aid) else new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, shelf, parts, stand = 0, None, [], None
        for b in batches:
            shelves, asks = b.column("shelf").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shelves[1:] != shelves[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, b.num_rows]):
                if start == end:
                    continue
                if shelves[start] != shelf:
                    shelf, parts = shelves[start], []
                if not asks[start]:
                    parts.append(b.slice(start, end - start))
                    stand = None
                    continue
                if not parts:
                    continue
                if stand is None:
                    t = pa.Table.from_batches(parts).combine_chunks()
                    column = lambda n: t.column(n).combine_chunks()
                    stand = column("vec_id").fill_null(LAST).to_numpy(), column("label").to_numpy(), _matrix(column("q"), np.int64)
                for at in range(start, end, AT_ONCE):
                    held.append(pick(b.slice(at, min(AT_ONCE, end - at)), *stand))
                    size += len(held[-1])
                    if size > HELD_ROWS:
                        held = [_best(held, k)]
                        size = len(held[0])
                        if size > HELD_ROWS // 2:
                            yield _found(held[0])
                            held, size = [], 0
        if size:
            yield _found(_best(held, k))

    return run


def _found(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1].astype(np.int32)), pa.array(x[:, 2]), pa.array(x[:, 3])], ["aid", "window", "score", "vec_id"])


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)


class _Index:
    """The rows of one vector length in the leaves of a tree, on shelves."""

    def __init__(self, rows: DataFrame, s: Settings):
        self.s = s
        largest = F.max(F.array_max(F.transform("q", lambda c: F.abs(c))))
        n, longest, most = rows.agg(F.count(F.lit(1)), F.max("squared"), largest).first()
        longest = float(longest or 0)
        self.kind = "short" if (most or 0) < 1 << 15 else "int" if most < 1 << 31 else "long"  # as they lie in rows and batches
        rows = rows.withColumn("q", F.col("q").cast(f"array<{self.kind}>"))
        sample = rows.select("q", "vec_id", "label").orderBy(F.xxhash64("vec_id", "label"), "vec_id", "label").limit(s.sample).toArrow()
        x = _longer(_matrix(sample["q"].combine_chunks()), longest)
        per_leaf = max(s.leaf, -(-n // s.most_leaves))
        tree = Gnat(x, max(1, per_leaf * len(x) // max(1, n)), s)
        fields = f"leaf int, part int, vec_id long, label long, q array<{self.kind}>"

        def put(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                leaf = tree.leaves(_longer(_matrix(b.column("q")), longest))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column("part"), b.column("vec_id"), b.column("label"), b.column("q")], ["leaf", "part", "vec_id", "label", "q"])

        salt = F.xxhash64("vec_id", "label", F.monotonically_increasing_id())
        placed = rows.withColumn("part", salt.bitwiseAND(0x7FFFFFFF).cast("int")).select("part", "vec_id", "label", "q")
        placed = materialize(placed.mapInArrow(put, fields), "placed")
        counted = placed.groupBy("leaf").count().toArrow()  # a row a leaf
        counts = np.zeros(len(tree.centres), np.int64)
        counts[counted["leaf"].to_numpy()] = counted["count"].to_numpy()
        self.first, self.width = _shelves(counts, s.block)
        plan = rows.sparkSession.createDataFrame(pa.table({"leaf": np.arange(len(counts), dtype=np.int32), "first": self.first, "width": self.width}))
        self.vectors = placed.join(F.broadcast(plan), "leaf").select((F.col("first") + F.col("part") % F.col("width")).alias("shelf"), "vec_id", "label", "q")
        self.tree, self.longest = tree, longest
        self._measure(placed)

    def _measure(self, placed: DataFrame) -> None:
        """Ranges over all vectors: at most nodes times the square of their split points come to the driver."""
        tree, longest = self.tree, self.longest

        def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [(np.full(n.low.shape, np.inf), np.full(n.low.shape, -np.inf)) for n in tree.nodes]
            for b in parts:
                for node, _, d, nearest in tree.walk(_longer(_matrix(b.column("q")), longest)):
                    low, high = own[node.number]
                    for j in np.unique(nearest):
                        low[:, j] = np.minimum(low[:, j], d[nearest == j].min(0))
                        high[:, j] = np.maximum(high[:, j], d[nearest == j].max(0))
            for number, (low, high) in enumerate(own):
                i, j = np.nonzero(np.isfinite(low))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), number, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(low[i, j]), pa.array(high[i, j])], ["node", "i", "j", "low", "high"])

        rows = placed.select("q").mapInArrow(measure, "node int, i int, j int, low double, high double")
        rows = rows.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        for node, i, j, low, high in zip(*(rows[c].to_pylist() for c in ("node", "i", "j", "low", "high"))):
            tree.nodes[node].low[i, j], tree.nodes[node].high[i, j] = low, high

    def choose(self, looking: bool):
        """Anchors with the shelves to read: for a first look those of some leaves in the windows, else of all that the ranges leave."""
        tree, longest, s, first = self.tree, self.longest, self.s, self.first
        width = np.ones(first.max(initial=0) + 1, np.int32)
        width[first] = self.width

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                for start in range(0, b.num_rows, AT_ONCE):
                    g = b.slice(start, AT_ONCE)
                    q = _matrix(g.column("q"))
                    squared, a = (q * q).sum(1), _anchored(q)
                    reach = lambda score: np.sqrt(np.maximum(longest + squared - 2 * np.clip(score, -4.6e18, 4.6e18), 0))
                    # one annulus round all of an anchor's windows; where they are all empty (low above high) nothing is read
                    highs, lows = g.column("high").to_pylist(), g.column("low").to_pylist()
                    open_ = [[(lo, hi) for lo, hi in zip(x, y) if lo <= hi] for x, y in zip(lows, highs)]
                    near = reach(np.array([max((hi for _, hi in o), default=0) for o in open_], np.float64))
                    far = reach(np.array([min((lo for lo, _ in o), default=0) for o in open_], np.float64))
                    wanted = np.zeros((len(a), len(width)), bool)
                    if looking:
                        d = distances(a, np.stack(tree.centres))
                        leaf = np.argsort(np.abs(d - near[:, None]), 1, kind="stable")[:, : s.look]
                        wanted[np.arange(len(a))[:, None], first[leaf]] = True
                    else:
                        for leaf, rows in tree.reach(a, near, far, 1e-6 * (1 + np.sqrt(longest + squared.max(initial=0)))):
                            wanted[rows, first[leaf]] = True
                    row, shelf = np.nonzero(wanted & np.array([bool(o) for o in open_])[:, None])
                    times = width[shelf]
                    ends = np.cumsum(times)
                    row, shelf = np.repeat(row, times), np.repeat(shelf, times) + np.arange(len(row) and ends[-1]) - np.repeat(ends - times, times)
                    for at in range(0, len(row), ASKS):
                        rest = g.take(pa.array(row[at : at + ASKS]))
                        yield pa.RecordBatch.from_arrays([pa.array(shelf[at : at + ASKS].astype(np.int32)), *rest.columns], ["shelf", *rest.schema.names])

        return run

    def find(self, anchors: DataFrame, k: int, same: bool, looking: bool) -> DataFrame:
        """(aid, window, score, vec_id, at): the first k of each window on the shelves that are read."""
        dealt = anchors.select("aid", "vec_id", "label", "q", "low", "high").repartition(anchors.sparkSession.sparkContext.defaultParallelism, "aid")
        asks = dealt.mapInArrow(self.choose(looking), f"shelf int, aid long, vec_id long, label long, q array<{self.kind}>, low array<long>, high array<long>")
        both = self.vectors.withColumn("asks", F.lit(False)).unionByName(asks.withColumn("asks", F.lit(True)), allowMissingColumns=True)
        met = both.repartition("shelf").sortWithinPartitions("shelf", "asks")
        return materialize(_first(met.mapInArrow(_search(k, same), FOUND), k, "aid", "window"), "found")


def hard_negatives(vectors: DataFrame, is_anchor, s: Settings = Settings(), vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``is_anchor`` (of vec_id) holds.

    A score is the integer product with the anchor of components floor(256 * x); ties go to the smaller id. An anchor's positives are its first ``s.positives`` rows of the
    same label; the negatives of each are the first ``s.negatives`` rows of other labels with a score from ``s.low`` to ``s.high`` percent of the positive's (none if that is below zero).
    Labels of ids divisible by 7 move on by one modulo 10 first. Rows with a null label or vector or a component that is null or not finite take no part, nor do vectors of
    2**62 or more in squared integer length. Vectors are compared with those of their own length. A row with a null id is never an anchor, and comes last among ties. Rows of one id
    stand for themselves, but never as each other's positive or negative. The result is exact: what the tree leaves out cannot be in it.
    """
    rows = materialize(integer_rows(vectors, vec_id, label, vector), "integers")
    lengths = sorted(r[0] for r in rows.select(F.size("q")).distinct().collect())
    out = [_of_length(rows.filter(F.size("q") == n), is_anchor, s) for n in lengths]
    if not out:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    return total


def _of_length(rows: DataFrame, is_anchor, s: Settings) -> DataFrame:
    index = _Index(rows, s)
    anchors = rows.filter(is_anchor(F.col("vec_id"))).select("vec_id", "label", F.col("q").cast(f"array<{index.kind}>").alias("q"))
    anchors = anchors.withColumn("aid", F.monotonically_increasing_id())
    anything = lambda v: F.array(F.lit(v).cast("long"))
    anchors = materialize(anchors.withColumn("low", anything(-(1 << 62))).withColumn("high", anything(1 << 62)), "asks")

    # positives: the k-th score of a first look bounds what is still to be read
    look = index.find(anchors, s.positives, True, True)
    bound = look.groupBy("aid").agg(F.when(F.count(F.lit(1)) >= s.positives, F.min("score")).alias("least"))
    asks = anchors.join(bound, "aid", "left").withColumn("low", F.array(F.coalesce("least", F.col("low")[0]))).drop("least")
    positives = index.find(asks, s.positives, True, False)

    # negatives: a window for each positive, in order
    listed = positives.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("at", "score", "vec_id"))).alias("p"))  # s.positives at most
    least = F.transform("p", lambda p: -F.floor(-s.low * p["score"].cast("decimal(38,0)") / 100).cast("long"))
    most = F.transform("p", lambda p: F.floor(s.high * p["score"].cast("decimal(38,0)") / 100).cast("long"))
    asks = materialize(anchors.drop("low", "high").join(listed.select("aid", least.alias("low"), most.alias("high")), "aid"), "asks")
    look = index.find(asks, s.negatives, False, True)
    bound = look.groupBy("aid", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= s.negatives)
    bound = bound.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("bounds"))  # s.positives at most
    raised = F.transform("low", lambda low, w: F.greatest(low, F.coalesce(F.col("bounds")[w], low)))
    negatives = index.find(asks.join(bound, "aid", "left").withColumn("low", raised).drop("bounds"), s.negatives, False, False)

    ids = lambda c: F.when(F.col(c) != LAST, F.col(c))
    p = positives.select("aid", (F.col("at") - 1).alias("window"), F.col("vec_id").alias("pid"), F.col("score").alias("positive_score"))
    n = negatives.select("aid", "window", F.col("at").cast("int").alias("rank"), F.col("vec_id").alias("nid"), F.col("score").alias("negative_score"))
    out = n.join(p, ["aid", "window"]).join(anchors.select("aid", F.col("vec_id").alias("anchor_id")), "aid")
    return out.select("anchor_id", ids("pid").alias("positive_id"), "rank", ids("nid").alias("negative_id"), "positive_score", "negative_score")
