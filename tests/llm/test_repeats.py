"""Operators 2 and 3 against counting every window."""

import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from compare import connect

from dictalog.llm import batches as B
from dictalog.llm import fm_index, suffixes
from llm.conftest import ROWS, table

WORD = r"[^\x20\x09-\x0D]+"


def brute(units_of, docs, length):
    """For each document: its units and which of them go."""
    units = [units_of(t or "") for t in docs]
    count = Counter(tuple(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        gone, to = np.zeros(len(u), bool), 0
        for i in range(len(u) - length + 1):
            if count[tuple(u[i : i + length])] > 1:
                gone[max(i, to) : i + length] = True
                to = i + length
        out.append((u, gone))
    return out


def same_bytes(rows, docs, length):
    want = sorted((len(u), int(g.sum()), bytes(np.array(list(u), np.uint8)[~g])) for u, g in brute(lambda t: t.encode(), docs, length))
    assert sorted((r.n_bytes, r.n_removed, bytes(r.kept)) for r in rows) == want
    for r in rows:
        assert r.n_spans == len(r.spans) and sum(s.end - s.start for s in r.spans) == r.n_removed


def same_words(rows, docs, length):
    want = sorted((len(u), int(g.sum()), " ".join(w for w, x in zip(u, g) if not x)) for u, g in brute(lambda t: re.findall(WORD, t), docs, length))
    assert sorted((r.n_words, r.n_removed, r.kept) for r in rows) == want


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Passages shared by many documents, whole copies, periodic texts."""
    r = random.Random(2)
    words = ["ab", "cd", "é", "efg", "hi", "jkl"]
    passages = [" ".join(r.choice(words) for _ in range(40)) for _ in range(5)]
    texts = []
    for i in range(60):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(30)) for _ in range(3)]
        texts.append(" ".join(parts)[r.randint(0, 9) :])
    texts += texts[:5] + ["ab " * 90, "cd" * 70, None, "", "short"]
    return table(spark, tmp_path_factory.mktemp("repeats"), list(enumerate(texts))), texts


@pytest.mark.parametrize("heavy", [10**9, 100])
def test_bytes(fixture, heavy):
    docs, texts = fixture
    how = replace(suffixes.byte_repeats(length=50, gram=12, heavy=heavy), block=3000)
    same_bytes(suffixes.remove_repeats(docs, how).collect(), texts, 50)


@pytest.mark.parametrize("heavy", [10**9, 50])
def test_words(fixture, heavy):
    docs, texts = fixture
    how = replace(fm_index.word_repeats(length=12, gram=4, heavy=heavy), block=500)
    same_words(fm_index.remove_repeats(docs, how).collect(), texts, 12)


def test_registered(spark):
    from conftest import SF
    from dictalog.llm.queries import QUERIES

    docs = connect(SF).execute("SELECT text FROM documents ORDER BY doc_id").fetchall()
    docs = [d[0] for d in docs]
    rows = QUERIES["op2_suffix_dedup"](spark, SF).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed) for r in rows] == [(len(u), int(g.sum())) for u, g in brute(lambda t: t.encode(), docs, 400)]
    rows = QUERIES["op3_fm_dedup"](spark, SF).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed) for r in rows] == [(len(u), int(g.sum())) for u, g in brute(lambda t: re.findall(WORD, t), docs, 35)]


def test_edges(edge, empty):
    texts = [r[1] for r in ROWS]
    out = suffixes.remove_repeats(edge, suffixes.byte_repeats(length=20, gram=8))
    assert set(edge.columns) - {"text", "spans"} < set(out.columns)
    same_bytes(out.collect(), texts, 20)
    same_words(fm_index.remove_repeats(edge, fm_index.word_repeats(length=6, gram=3)).collect(), texts, 6)
    assert suffixes.remove_repeats(empty).count() == fm_index.remove_repeats(empty).count() == 0


def test_suffix_array_and_prefixes():
    r = random.Random(4)
    for _ in range(50):
        text = bytes(r.choice(b"aab") for _ in range(r.randint(1, 80)))
        order = suffixes.suffix_array(text, 100)
        assert list(order) == sorted(range(len(text)), key=lambda i: text[i:])
        common = lambda a, b: next((k for k in range(40) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= len(text)), 40)
        got = suffixes.common_prefixes(text, order, 40)
        assert [int(min(g, 40)) for g in got] == [common(a, b) for a, b in zip(order[:-1], order[1:])]


def test_fm_index_counts():
    r = random.Random(6)
    t = np.array([r.randint(0, 4) for _ in range(300)] + [5])
    index = fm_index.FMIndex(t, 12)
    for _ in range(200):
        n = r.randint(1, 8)
        at = r.randint(0, 300 - n)
        pattern = t[at : at + n] if r.random() < 0.7 else np.array([r.randint(0, 4) for _ in range(n)])
        lo, hi = np.array([0]), np.array([len(t)])
        for c in pattern[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        assert hi[0] - lo[0] == sum((t[i : i + n] == pattern).all() for i in range(len(t) - n + 1))


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for w in (1, 2, 7, 64, 200):
        assert list(B.sliding_min(x, w)) == [min(x[i : i + w]) for i in range(200 - w + 1)]
