"""Operator 8: approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample and overfull clusters are split, so lists come out of like size. Every vector is then put on the list of its nearest
centroid, and on those of a few more that are hardly farther (vectors near a border stand on both sides). A query looks up its nearest centroids in a
graph held in memory and reads the lists whose centroid is near enough compared with the first. For the largest inner product each vector
gets one more component that makes all of one length; nearest by distance is then largest by product.

Equal vectors are indexed once, with their smallest ids. Long lists and many queries on one list are cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dictalog.session import materialize


@dataclass(frozen=True)
class Settings:
    k: int = 20
    per_list: int = 200
    """Vectors per list aimed at."""
    most_lists: int = 8192
    sample: int = 20_000
    """Vectors that the centroids are fitted on at most: those with the smallest hash of their id."""
    replicas: int = 4
    border: float = 0.04
    """A list stands for a vector too if its centroid is farther by this share at most."""
    probes: int = 96
    share: float = 0.25
    """A query reads as many lists as the larger of ``probes`` and this share of all at most. Vectors without structure need the share
    (the ratio tells nothing there); where they form clusters, the ratio decides long before."""
    ratio: float = 0.6
    """A query reads a list if its centroid is farther than the nearest by this share at most."""
    degree: int = 24
    beam: int = 96
    block: int = 8192
    seed: int = 11


@dataclass(frozen=True)
class Index:
    """Centroids (with the added component) and the graph over them."""

    centroids: np.ndarray
    links: np.ndarray
    longest: float

    def nearest(self, x: np.ndarray, n: int, beam: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """The n nearest centroids of each row found along the graph, and their distances.

        Each row keeps the ``beam`` nearest seen; the neighbours of the ``step`` nearest not yet followed come in, until all are followed.
        """
        c, count = self.centroids, len(self.centroids)
        n, beam = min(n, count), min(max(n, beam), count)
        entry = np.unique(np.linspace(0, count - 1, beam).astype(np.int64))
        ids, dist, done = np.tile(entry, (len(x), 1)), _distances(x, c[entry]), np.zeros((len(x), beam), bool)
        live, squares, step = np.arange(len(x)), (c * c).sum(1), min(step, beam)
        while len(live):
            at, d, followed, v = ids[live], dist[live], done[live], x[live]
            pick = np.argpartition(np.where(followed, np.inf, d), step - 1, 1)[:, :step]
            np.put_along_axis(followed, pick, True, 1)
            new = self.links[np.take_along_axis(at, pick, 1)].reshape(len(live), -1)
            new_d = (v * v).sum(1)[:, None] + squares[new] - 2 * np.einsum("id,ijd->ij", v, c[new])
            both, d, followed = np.concatenate((at, new), 1), np.concatenate((d, new_d), 1), np.concatenate((followed, np.zeros(new.shape, bool)), 1)
            order = np.argsort(both, 1, kind="stable")  # those kept come before the same that come in
            both, d, followed = (np.take_along_axis(y, order, 1) for y in (both, d, followed))
            d[:, 1:][both[:, 1:] == both[:, :-1]] = np.inf
            keep = np.argpartition(d, beam - 1, 1)[:, :beam]
            ids[live], dist[live], done[live] = (np.take_along_axis(y, keep, 1) for y in (both, d, followed))
            live = live[~done[live].all(1)]
        order = np.argsort(dist, 1, kind="stable")[:, :n]
        return np.take_along_axis(ids, order, 1), np.sqrt(np.maximum(np.take_along_axis(dist, order, 1), 0))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 2048], c).argmin(1) for i in range(0, len(x), 2048)])


def fit(x: np.ndarray, lists: int, longest: float, s: Settings) -> Index:
    """k-means on a sample; a cluster with more than twice its share gives way to two."""
    rng = np.random.default_rng(s.seed)
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)] if len(x) else np.zeros((1, x.shape[1]))
    for step in range(12 if len(x) else 0):
        own = _closest(x, c)
        sizes = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        filled = sizes > 0
        c = sums[filled] / sizes[filled, None]
        large = np.flatnonzero(sizes[filled] > max(2, 2 * len(x) / lists))
        if step < 10 and len(large):  # two centroids a little apart, on either side
            apart = rng.normal(size=(len(large), x.shape[1])) * 1e-3 * (np.abs(c[large]).mean(1, keepdims=True) + 1e-12)
            c = np.concatenate((c, c[large] + apart))
            c[large] -= apart
    near = np.concatenate([np.argsort(_distances(c[i : i + 1024], c), 1, kind="stable")[:, 1 : s.degree + 1] for i in range(0, len(c), 1024)])
    if not near.shape[1]:
        near = np.zeros((len(c), 1), np.int64)
    return Index(c, near, longest)


def _longer(x: np.ndarray, longest: float) -> np.ndarray:
    """The component that gives all vectors one length."""
    return np.column_stack((x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the vectors that take part: with an id, not null, zero or empty, all components finite."""
    v = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def search(vectors: DataFrame, is_query, s: Settings = Settings(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` (of vec_id) holds the ``k`` others with the largest inner product found.

    Nearest first, ties to the smaller id; fewer rows where there are fewer others. Vectors are compared with those of their own length, in an index for each
    length. Ids should be unique: rows that repeat id and vector count once.
    """
    every = materialize(usable(vectors, vec_id, vector), "usable")
    asked = materialize(every.filter(is_query(F.col("vec_id"))).distinct(), "asked")
    out = None
    for n in sorted(r[0] for r in asked.select(F.size("vector")).distinct().collect()):
        found = _of_length(every.filter(F.size("vector") == n), asked.filter(F.size("vector") == n), s)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else every.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _of_length(all_rows: DataFrame, asked: DataFrame, s: Settings) -> DataFrame:
    first = Window.partitionBy("vector").orderBy("vec_id")
    # k others and the query itself are all that equal vectors can give one result
    some = all_rows.distinct().withColumn("at", F.row_number().over(first)).filter(F.col("at") <= s.k + 1)
    points = some.groupBy("vector").agg(F.min("vec_id").alias("did"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = materialize(points, "points")
    queries = materialize(asked.join(points.select("vector", "did"), "vector").select(F.col("vec_id").alias("query_id"), "did"), "queries")

    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    n, longest = points.agg(F.count(F.lit(1)), F.max(length)).first()
    sample = points.select("vector", "did").orderBy(F.xxhash64("did"), "did").limit(s.sample).toPandas()
    longest = longest or 0.0
    x = _matrix(sample["vector"])
    lists_wanted = min(s.most_lists, -(-n // s.per_list))
    probes = max(s.probes, int(s.share * lists_wanted))
    index = fit(_longer(x, longest), lists_wanted, longest, s)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 256):
                g = f.iloc[i : i + 256]
                ids, d = index.nearest(_longer(_matrix(g["vector"]), longest), s.replicas, s.beam // 4)
                near = d <= d[:, :1] * (1 + s.border) + 1e-12
                yield pd.DataFrame({"list": ids[near], "did": np.repeat(g["did"].to_numpy(), near.sum(1)), "vector": np.repeat(g["vector"].to_numpy(), near.sum(1))})

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 256):
                g = f.iloc[i : i + 256]
                q = _matrix(g["vector"])
                # a query of the vectors' greatest length has the same order of products and distances to compare
                q = np.column_stack((q * (longest / np.sqrt((q * q).sum(1)))[:, None], np.zeros(len(q))))
                ids, d = index.nearest(q, probes, max(s.beam, probes))
                near = d <= d[:, :1] * (1 + s.ratio) + 1e-12
                yield pd.DataFrame({"list": ids[near], "did": np.repeat(g["did"].to_numpy(), near.sum(1)), "vector": np.repeat(g["vector"].to_numpy(), near.sum(1))})

    lists = materialize(points.select("did", "vector").mapInPandas(assign, "list int, did long, vector array<double>"), "lists")
    asked = points.join(queries.select("did").distinct(), "did").select("did", "vector")
    asked = materialize(asked.mapInPandas(probe, "list int, did long, vector array<double>"), "probes")
    # blocks of a list's vectors meet blocks of its queries; there are most_lists counts at most
    blocks = lambda t, name: t.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / s.block).cast("int").alias(name))
    cut = F.broadcast(blocks(lists, "vs").join(blocks(asked, "qs"), "list"))
    own = lambda c: F.pmod(F.xxhash64("did"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = lists.join(cut, "list").select("list", own("vs").alias("v"), every("qs").alias("q"), "did", "vector")
    right = asked.join(cut, "list").select("list", every("vs").alias("v"), own("qs").alias("q"), "did", "vector")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"did": [], "near": [], "score": []})
        a = a.sort_values("did")
        x, ids, parts = _matrix(a["vector"]), a["did"].to_numpy(), []
        for i in range(0, len(b), 512):
            q = _matrix(b["vector"].iloc[i : i + 512])
            rough = q @ x.T
            top = np.argsort(-rough, 1, kind="stable")[:, : s.k + 1]
            score = np.cumsum(q[:, None, :] * x[top], axis=2)[:, :, -1]  # the sum in the order of the components
            parts.append(pd.DataFrame({"did": np.repeat(b["did"].to_numpy()[i : i + 512], top.shape[1]), "near": ids[top].ravel(), "score": score.ravel()}))
        return pd.concat(parts)

    found = left.groupBy("list", "v", "q").cogroup(right.groupBy("list", "v", "q")).applyInPandas(best, "did long, near long, score double").distinct()
    order = Window.partitionBy("did").orderBy(F.desc("score"), "near")
    found = found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= s.k + 1).drop("at")
    found = found.join(points.select(F.col("did").alias("near"), "ids"), "near").select("did", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("did").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= s.k + 1)
    found = found.groupBy("did").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, s.k)
    out = queries.join(found, "did").select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
