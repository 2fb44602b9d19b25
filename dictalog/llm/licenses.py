"""Operator 11: licences stated in texts.

One Aho-Corasick automaton finds notice phrases and identifier tags in the words of a text. Behind a tag stands a licence expression;
a shunting-yard parser takes it apart, and ``and``, ``or`` and ``with`` are evaluated to how free the terms are.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictalog.llm import batches as B

#: Phrases (their words) and labels of the contract.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: More notice phrases. One inside a longer one found there doesn't count; those of BASE always do.
NOTICES = {
    "the mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "licensed under the apache license": "apache",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "version 2 of the gnu general public license": "gpl-2",
    "version 3 of the gnu general public license": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "cc0",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "licensed under cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "all rights reserved": "all-rights-reserved",
}
#: Tags before a licence expression (with a colon between them).
TAGS = ("spdx license identifier", "license expression", "licence expression")
#: How free a licence's terms are, by the first letters of its label (the longest that fits); others count as UNKNOWN.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "0bsd": 1.0, "cc-by": 0.9,
    "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "all-rights-reserved": 0.0, "none": 0.0,
}
UNKNOWN = 0.5

#: A-Z become small, all other ASCII but digits and small letters a space; bytes beyond ASCII belong to words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Found:
    """A phrase or tag: its place among the text's words, and what it says."""

    first: int
    words: int
    label: str
    base: bool
    freedom: float


def freedom(label: str) -> float:
    fits = [k for k in FREEDOM if label == k or label.startswith(k + "-")]
    return FREEDOM[max(fits, key=len)] if fits else UNKNOWN


def label_of(identifier: str) -> str:
    """The label of a licence identifier: small letters, without "-only", "-or-later", "+", a last ".0", or the version of a CC licence."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    name = re.sub(r"(\.0)+$", "", name)
    return re.sub(r"^(cc-by[a-z-]*?|cc0)-\d[\d.]*$", r"\1", name)


_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
#: with binds closest, then and, then or.
_RANK = {"or": 1, "and": 2, "with": 3}


def parse(expression: str) -> list[str]:
    """The expression in postfix order, by the shunting-yard algorithm: identifiers as written, operators in small letters.

    Read as far as it is well-formed: what follows the first token out of place counts for nothing, an operator without a right side and
    an open bracket without an end neither. A bracket without content ends the reading.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # one is due
    at = 0
    while token := _TOKEN.match(expression, at):
        word, at = token[1], token.end()
        low = word.lower()
        if word == "(":
            if not operand:
                break
            stack.append(word)
        elif word == ")":
            if operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in _RANK:
            if operand:
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            if not operand:
                break
            out.append(word)
            operand = False
    while stack and operand and out:  # operators and brackets that wait for a right side
        if stack[-1] != "(":
            operand = False
        stack.pop()
    return out + [x for x in reversed(stack) if x != "("]


def evaluate(postfix: list[str]) -> tuple[float, list[str]] | None:
    """(freedom, labels) of an expression: ``or`` leaves the choice (the freer), ``and`` binds to both (the stricter), an exception after
    ``with`` lifts half of what is missing and is no licence of its own. None for an empty expression."""
    stack: list[tuple[float, list[str]]] = []
    for x in postfix:
        if x in _RANK:
            (b, right), (a, left) = stack.pop(), stack.pop()
            stack.append({"or": (max(a, b), left + right), "and": (min(a, b), left + right), "with": ((1 + a) / 2, left)}[x])
        else:
            label = label_of(x)
            stack.append((freedom(label), [label]))
    return stack[-1] if stack else None


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrases, base in ((BASE, True), (NOTICES, False), (dict.fromkeys(TAGS, ""), False)):
        for phrase, label in phrases.items():
            out.add_word(f" {phrase} ", (len(phrase) + 2, len(phrase.split()), label, base))
    out.make_automaton()
    return out


def _within_longer(hits: list[tuple]) -> list[tuple]:
    """Hits (first, words, label, base) without those of ``base`` false that stand inside a longer one."""
    out, reach = [], (-1, 0)
    for hit in sorted(hits, key=lambda h: (h[0], -h[1])):
        end = hit[0] + hit[1]
        if hit[3] or end > reach[0]:
            out.append(hit)
        reach = max(reach, (end, hit[1]))
    return out


_REST = re.compile(rb"[ \t]*:[ \t]*([^\r\n]*)")


def scan_text(raw: bytes) -> tuple[int, list[Found]]:
    """Words of a text, and what is found there in order of place."""
    plain = raw.translate(WORDS)
    words = plain.split()
    joined = b" " + b" ".join(words) + b" "
    hits = [(end + 1 - of[0], *of[1:]) for end, of in _automaton().iter(joined.decode("latin-1"))]
    if not hits:
        return len(words), []
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    hits = _within_longer([(int(np.searchsorted(spaces, at)), n, label, base) for at, n, label, base in hits])
    found, ends = [], None
    for first, n, label, base in hits:
        if label:
            found.append(Found(first, n, label, base, freedom(label)))
            continue
        if ends is None:
            letter = np.frombuffer(plain + b" ", np.uint8) != 32
            ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        rest = _REST.match(raw, int(ends[first + n - 1]))
        value = evaluate(parse(rest[1].decode("latin-1"))) if rest else None
        if value:
            found += [Found(first, n, x, False, value[0]) for x in dict.fromkeys(value[1])]
    return len(words), found


SCANNED = "struct<n_words:long,found:array<struct<first:long,words:int,label:string,base:boolean,freedom:double>>,score:double>"
_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("found", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int32()), ("label", pa.string()), ("base", pa.bool_()), ("freedom", pa.float64())]))),
        ("score", pa.float64()),
    ]
)


def scan(docs: DataFrame, text: str = "text", name: str = "licenses") -> DataFrame:
    """``docs``, all rows and columns, with what is found in each text (a column of that name is replaced): n_words; found, by place; score.

    The score is the freedom that all findings leave together (the least of theirs), 0 where nothing is found. A finding's ``base`` tells phrases of
    BASE from those the method adds. Null counts as empty: no words, nothing found. Rows are independent: no shuffle.
    """

    @F.arrow_udf(SCANNED)
    def scanned(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = []
            data, off = B.text_bytes(column)
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                n, found = scan_text(data[a:b].tobytes())
                rows.append({"n_words": n, "found": [vars(f) for f in found], "score": min((f.freedom for f in found), default=0.0)})
            yield pa.array(rows, _TYPE)

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], scanned(F.col(f"`{text}`")).alias(name))
