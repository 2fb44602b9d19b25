"""Operator 10: quality scores by supervised subword embeddings.

A text's features are its words, its character n-grams (3 to 5 code points, a word's borders included) and pairs of neighbouring words,
each hashed to a learned vector. The mean of the vectors goes through a softmax layer. Training is stochastic gradient descent in numpy on a bounded
sample of labelled rows; scoring is a sum of one learned number per feature and runs over all rows where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictalog.llm import batches as B

GRAMS = (3, 4, 5)
#: Distinct code points have distinct values; all white space is one border.
_BORDER = np.uint32(32)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dim: int = 8
    epochs: int = 4
    steps: int = 8000
    """With few rows there are more epochs, to come to this number of steps."""
    rate: float = 0.5
    sample: int = 4000
    """Labelled rows used for training at most: those with the smallest hash of their id."""
    seed: int = 7


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    """What each feature adds to the difference of the two classes' inputs."""
    bias: float


def features(texts: list[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (text number, bucket) for all features of the texts, one pair of arrays for each kind."""
    joined = " " + " ".join(t or "" for t in texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    codes = np.where(space, _BORDER, codes)
    off = np.concatenate(([0], np.cumsum([len(t or "") + 1 for t in texts])))  # with the border after each text
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(off))  # of each place after the first border
    doc = np.concatenate((doc[:1], doc))
    roll = B.Rolling(B.mix(codes.astype(np.uint64) + np.uint64(1)))
    edge = np.diff(space.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    place = lambda h, kind: (B.mix(h + np.uint64(kind)) % np.uint64(buckets)).astype(np.int32)
    words = roll.of(starts, ends)
    yield doc[starts], place(words, 1)
    pair = doc[starts[1:]] == doc[starts[:-1]]
    same = np.where(words[1:] == words[:-1], np.uint64(1), words[1:] * np.uint64(3) + words[:-1])  # a word said again is one feature
    yield doc[starts[1:]][pair], place(same, 2)[pair]
    borders = np.concatenate(([0], np.cumsum(space)))
    for n in GRAMS:
        at = np.arange(len(codes) - n + 1)
        at = at[borders[at + n - 1] == borders[at + 1]]  # a border may come first or last only
        yield doc[at + 1], place(roll.of(at, at + n), n)


#: Texts whose features are put into common arrays at a time.
_TOGETHER = 500


def _bags(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct buckets of each text, the share of each among its features, and where each text's begin. Few large arrays, which the process gives back to
    the system when they go; thousands of small ones would stay with it."""
    ids, shares, sizes = [], [], []
    for at in range(0, len(texts), _TOGETHER):
        some = [np.unique(np.concatenate([b for _, b in features([t], buckets)]), return_counts=True) for t in texts[at : at + _TOGETHER]]
        ids.append(np.concatenate([which for which, _ in some]))
        shares.append(np.concatenate([(n / max(1, n.sum())).astype(np.float32) for _, n in some]))
        sizes += [len(which) for which, _ in some]
    none = np.zeros(0, np.int32)
    return np.concatenate([*ids, none]), np.concatenate([*shares, none.astype(np.float32)]), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def train(texts: list[str | None], labels: list[int], s: Settings) -> Model:
    """Stochastic gradient descent, one text at a time, the rate falling to zero. No rows give a model that scores 0.5."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out = np.zeros((2, s.dim), np.float32)
    bias = np.zeros(2, np.float32)
    buckets, shares, begin = _bags(texts, s.buckets)
    steps, total = 0, max(1, len(texts), s.epochs * len(texts), s.steps)
    for _ in range(-(-total // len(texts)) if texts else 0):
        for i in rng.permutation(len(texts)):
            rate = s.rate * max(0.0, 1 - steps / total)
            steps += 1
            ids, share = buckets[begin[i] : begin[i + 1]], shares[begin[i] : begin[i + 1]]
            rows = vectors[ids]
            hidden = share @ rows
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= rate * p
            # the mean spreads the step over the text's features; each of them moves by its share of the whole
            vectors[ids] = rows - (rate * len(ids) ** 0.5) * share[:, None] * back
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learns from at most ``s.sample`` labelled rows for which ``may_learn`` holds (labels other than 0 and 1 are left out).

    Of several labels or texts of one id one is used. The sample is the only data that comes to the driver.
    """
    known = labels.filter(may_learn & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(label).alias("__label"))
    known = known.orderBy(F.xxhash64(doc_id, F.lit(s.seed)), doc_id).limit(s.sample)
    texts = docs.select(doc_id, F.col(f"`{text}`").alias("__text")).join(F.broadcast(known), doc_id)  # s.sample rows at most
    rows = texts.dropDuplicates([doc_id]).collect()
    rows.sort(key=lambda r: r[doc_id])
    return train([r["__text"] for r in rows], [r["__label"] for r in rows], s)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the model's probability of label 1; a column of that name is replaced. Null texts score as empty ones."""
    rest = [c for c in docs.columns if c != name]
    weight, bias, buckets = model.weight.astype(np.float64), model.bias, len(model.weight)

    def of(texts: list[str | None]) -> np.ndarray:
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        for doc, bucket in features(texts, buckets):
            sums += np.bincount(doc, weight[bucket], minlength=len(texts))
            counts += np.bincount(doc, minlength=len(texts))
        return 1 / (1 + np.exp(-(sums / np.maximum(counts, 1) + bias)))

    @F.pandas_udf("double")
    def scored(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            texts = column.tolist()
            cuts = np.cumsum([len(t or "") for t in texts]) // 500_000
            cuts = [0, *(np.flatnonzero(np.diff(cuts)) + 1), len(texts)]
            yield pd.Series(np.concatenate([of(texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]))
            B.give_back()

    return docs.select(*[F.col(f"`{c}`") for c in rest], scored(F.col(f"`{text}`")).alias(name))
