"""Operator 5: n-best segmentation of texts into the pieces of a given SentencePiece model, and back to text.

Forward Viterbi gives the best score from the start of the text to every place. These scores are exact estimates for an A-star
search from the end back to the start, which so takes up segmentations in order of their score. A space begins a new piece in these models, so
the lattice of a text falls into words: the search runs once per different word, and the words' alternatives are put together in order.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re
import time
from array import array
from bisect import insort
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictalog.llm import batches as B

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words remembered per worker, in each of two generations.
REMEMBERED = 200_000
#: Words of which all n best are remembered.
REMEMBERED_PATHS = 20_000

Path = tuple[float, tuple[int, ...]]
#: A word's best segmentation: score, ids, and what the second best loses.
Word = tuple[float, tuple[int, ...], float]


def _tree(nested: dict) -> tuple:
    """A node: how to get the node of one letter more, and the piece that ends here, if one does."""
    known = nested.pop("", None)
    return {letter: _tree(below) for letter, below in nested.items()}.get, known


class Pieces:
    """Pieces, scores and ids of a model file; its bytes stand in for characters without a piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        self.names = [model.id_to_piece(i) for i in size]
        normal = [i for i in size if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(SPACE in n.lstrip(SPACE) or "\n" in n for n in (self.names[i] for i in normal)):
            raise ValueError(f"pieces of {path} go across spaces or lines")
        self.ids = {self.names[i]: (model.get_score(i), (i,)) for i in normal}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.texts = [n.replace(SPACE, " ") for n in self.names]
        for b in range(128):
            self.texts[self.bytes[b]] = chr(b)
        self.letters_byte = {i: b for b, i in enumerate(self.bytes) if b > 127}
        self.letters = set(self.letters_byte)
        scores = [s for s, _ in self.ids.values() if s > -1e8]
        self.unknown = min(scores) - 10  # for each character spelt in bytes
        self.longest = max(map(len, self.ids))
        marks = [c for c in ".,;:!?" if not any(a.isalpha() and b == c for name in self.ids for a, b in zip(name, name[1:]))]
        self.ends = re.compile(f"(?<=[A-Za-z])(?=[{re.escape(''.join(marks))}])") if marks else None
        self.starts = {n[:i] for n in self.ids for i in range(1, len(n) + 1)}
        nested: dict = {}
        for name, known in self.ids.items():
            node = nested
            for letter in name:
                node = node.setdefault(letter, {})
            node[""] = known
        self.tree = _tree(nested)[0]

    def best(self, word: str, n: int) -> list[Path]:
        """The n best segmentations of a word, best first."""
        size, longest = len(word), self.longest
        arcs: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]  # by end: start, score, ids
        ahead = [0.0] + [-1e300] * size
        get, starts = self.ids.get, self.starts
        for i in range(size):
            here, single = ahead[i], False
            for j in range(i + 1, min(size, i + longest) + 1):
                name = word[i:j]
                if known := get(name):
                    single |= j == i + 1
                    score, ids = known
                    arcs[j].append((i, score, ids))
                    if here + score > ahead[j]:
                        ahead[j] = here + score
                elif name not in starts:
                    break
            if not single:
                letter = SPACE if word[i] == _LITERAL else word[i]
                arcs[i + 1].append((i, self.unknown, tuple(self.bytes[b] for b in letter.encode())))
                ahead[i + 1] = max(ahead[i + 1], here + self.unknown)
        return self._backward(arcs, ahead, size, n)

    def best_and_gap(self, word: str) -> Word:
        """A word's best segmentation, and what the second best loses: the best path through some arc that isn't on the best path. With the best scores before and
        behind each place that takes no search."""
        size, unknown, root = len(word), self.unknown, self.tree
        ahead = [-1e300] * (size + 1)
        ahead[0] = 0.0
        by: list[tuple | None] = [None] * (size + 1)  # the arc of the best path to each place
        arcs: list[tuple] = []
        add = arcs.append
        for i in range(size):
            here, longer, j = ahead[i], root, i
            single = False
            for letter in word[i:]:
                node = longer(letter)
                if node is None:
                    break
                j += 1
                longer, known = node
                if known:
                    score, ids = known
                    arc = (i, j, score, ids)
                    add(arc)
                    score += here
                    if score > ahead[j]:
                        ahead[j] = score
                        by[j] = arc
                    if j == i + 1:
                        single = True
            if not single:
                letter = SPACE if word[i] == _LITERAL else word[i]
                arc = (i, i + 1, unknown, tuple(self.bytes[b] for b in letter.encode()))
                arcs.append(arc)
                if here + unknown > ahead[i + 1]:
                    ahead[i + 1] = here + unknown
                    by[i + 1] = arc
        path, place = [], size
        while place:
            path.append(by[place])
            place = by[place][0]
        total = ahead[size]
        ids = tuple(chain.from_iterable(arc[3] for arc in reversed(path)))
        if len(arcs) == len(path):
            return total, ids, math.inf
        behind = [-1e300] * size + [0.0]
        second = -math.inf
        on_path = set(map(id, path))
        for arc in reversed(arcs):  # arcs of later starts first
            i, j, score, _ = arc
            rest = score + behind[j]
            if rest > behind[i]:
                behind[i] = rest
            rest += ahead[i]
            if rest > second and id(arc) not in on_path:
                second = rest
        return total, ids, max(0.0, total - second) if second > -1e299 else math.inf

    @staticmethod
    def _backward(arcs, ahead, size, n) -> list[Path]:
        # Every open item stands for all paths with its end part, and its total is that of the best of them. So n items,
        # those already complete included, hold the n best paths at any time, and the others can go.
        # A path is a chain (ids of its first arc, the rest); it is unrolled when it arrives.
        items, out, number = [(-ahead[size], 0, size, 0.0, None)], [], 0
        while items:
            _, _, place, score, chain = items.pop(0)
            if not place:
                path: list[int] = []
                while chain:
                    path.extend(chain[0])
                    chain = chain[1]
                out.append((score, tuple(path)))
                continue
            room = n - len(out)
            for start, s, ids in arcs[place]:
                at = -(ahead[start] + s + score)
                if len(items) < room or at < items[-1][0]:
                    number += 1
                    insort(items, (at, number, start, s + score, (ids, chain)))
                    del items[room:]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation."""
        if not self.letters.isdisjoint(ids):  # bytes of letters beyond ASCII have to meet first
            out, spelt = [], bytearray()
            for i in ids:
                if i in self.letters:
                    spelt.append(self.letters_byte[i])
                    continue
                out += (spelt.decode("utf-8", "replace"), self.texts[i])
                spelt.clear()
            return "".join((*out, spelt.decode("utf-8", "replace")))[1:]
        return "".join(map(self.texts.__getitem__, ids))[1:]


#: Stands for a literal U+2581 in a text, which would otherwise come back as a space. Not a character of any text.
_LITERAL = "\ud800"


_RUNS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")

_score, _ids, _gap = itemgetter(0), itemgetter(1), itemgetter(2)


class Encoder:
    """Splits texts into words and puts the words' segmentations together."""

    def __init__(self, pieces: Pieces, n: int):
        self.pieces, self.n = pieces, n
        self.young: dict[str, Word] = {}
        self.old: dict[str, Word] = {}
        self.paths: dict[str, list[Path]] = {}

    def word(self, w: str) -> Word:
        found = self.young.get(w) or self.old.get(w)
        if not found:
            found = self.pieces.best_and_gap(w)
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[w] = found
        return found

    def all_paths(self, w: str) -> list[Path]:
        """The n best of a word that is near its second best: much the same few words in most texts."""
        found = self.paths.get(w)
        if found is None:
            if len(self.paths) >= REMEMBERED_PATHS:
                self.paths.clear()
            found = self.paths[w] = self.pieces.best(w, self.n)
        return found

    def words(self, text: str) -> list[str]:
        """Stretches no piece goes across: each begins at a space, and line ends stand alone."""
        if SPACE in text:
            text = text.replace(SPACE, _LITERAL)
        text = " " + text  # the models put a space before a text
        if "  " in text or "\n " in text or text[-1] == " ":  # a run of spaces may be one piece
            return _RUNS.findall(text.replace(" ", SPACE))
        text = text.replace(" ", " " + SPACE)
        if self.pieces.ends:
            text = self.pieces.ends.sub(" ", text)  # between a letter and a mark that no piece has behind a letter
        out = text.replace("\n", " \n ").split(" ")
        return [w for w in out if w] if "" in out else out

    def choices(self, text: str | None) -> tuple[list[Word], list[tuple[float, dict[int, tuple[int, ...]]]]]:
        """The text's words, and for each of its n best segmentations the score and the ids of the words not at their best."""
        if not text:
            return [], [(0.0, {})]
        words = self.words(text)
        parts = list(map(self.young.get, words))
        if None in parts:
            parts = [p or self.word(w) for p, w in zip(parts, words)]
        total = sum(map(_score, parts))
        # only the n - 1 words whose second best costs least can differ from their best
        gaps, cheap = list(map(_gap, parts)), []
        for _ in range(self.n - 1):
            least = min(gaps)
            if least == math.inf:
                break
            cheap.append(gaps.index(least))
            gaps[cheap[-1]] = math.inf
        found: list[tuple[float, tuple[tuple[int, tuple[int, ...]], ...]]] = [(0.0, ())]
        for i in sorted(cheap):
            paths = self.all_paths(words[i])
            more = [(loss + paths[0][0] - s, swap + (((i, ids),) if k else ())) for loss, swap in found for k, (s, ids) in enumerate(paths)]
            found = sorted(more)[: self.n]
        return parts, [(total - loss, dict(swap)) for loss, swap in found]

    def encode(self, text: str | None) -> list[Path]:
        """The n best segmentations of a text, best first. An empty text has one, of no pieces and score 0."""
        parts, found = self.choices(text)
        return [(score, tuple(x for i, p in enumerate(parts) for x in swap.get(i, p[1]))) for score, swap in found]


@lru_cache(maxsize=4)
def encoder(path: str, n: int) -> Encoder:
    """One per worker, so that its memory of words lasts over batches, until the worker has done other steps for a while."""
    return Encoder(Pieces(path), n)


ENCODED = "array<struct<score:double,ids:array<int>>>"
DIGEST = {"n_pieces": "long", "scores": "array<double>", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, n: int = 3, model: str = MODEL, text: str = "text", name: str = "pieces") -> DataFrame:
    """``docs`` with the n best segmentations of each text (score, ids); a column of that name is replaced. Null stays null.

    Fewer come back where there are fewer. ``model`` is a path that the executors can read.
    """

    def of(texts: list[str | None]) -> pd.Series:
        e = encoder(model, n)
        return pd.Series([None if t is None else [{"score": s, "ids": list(i)} for s, i in e.encode(t)] for t in texts], dtype=object)

    return _with(docs, _column(of, ENCODED)(F.col(f"`{text}`")), name)


def decode(docs: DataFrame, ids: str = "ids", model: str = MODEL, name: str = "text") -> DataFrame:
    """``docs`` with the text of an array of piece ids; a column of that name is replaced. Null stays null."""

    def of(rows: list) -> pd.Series:
        p = encoder(model, 1).pieces
        return pd.Series([None if r is None else p.decode(list(r)) for r in rows], dtype=object)

    return _with(docs, _column(of, "string")(F.col(f"`{ids}`")), name)


def digests(docs: DataFrame, n: int = 3, model: str = MODEL, text: str = "text", name: str = "digest") -> DataFrame:
    """``docs`` with a digest of each text's n best segmentations: pieces of the best, all scores, SHA-256 of the best's ids
    (32-bit, little-endian) and of the text decoded from them. Null counts as empty."""

    def of(texts: list[str | None]) -> pd.DataFrame:
        e, rows = encoder(model, n), []
        for t in texts:
            parts, found = e.choices(t)
            ids = array("i", chain.from_iterable(map(_ids, parts)))
            back = e.pieces.decode(ids)
            rows.append((len(ids), [s for s, _ in found], hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=list(DIGEST))

    return _with(docs, _columns(of, DIGEST)(F.col(f"`{text}`")), name)


@contextmanager
def _no_cycles():
    """The search makes many small tuples and no cycles: without the cycle collector it takes half the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _column(of, kind: str):
    @F.pandas_udf(kind)
    def made(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            with _no_cycles():
                out = of(column.tolist())
            B.REMEMBERED[encoder.cache_clear] = time.monotonic()
            yield out
            del out
            B.give_back()

    return made


def _columns(of, kinds: dict[str, str]):
    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in kinds.items()))
    def made(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            with _no_cycles():
                out = of(column.tolist())
            B.REMEMBERED[encoder.cache_clear] = time.monotonic()
            yield out
            del out
            B.give_back()

    return made


def _with(docs: DataFrame, column, name: str) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], column.alias(name))
