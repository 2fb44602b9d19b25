"""Operators 11 to 13: licences, hard negatives, phrases."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect
from pyspark.sql import functions as F

from conftest import SF
from dictalog.llm import collocations, licenses, negatives
from dictalog.llm.queries import QUERIES
from llm.conftest import ROWS, table

# -- operator 11

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def brute_base(text):
    """Words, and (first word, label) of each base phrase, word by word."""
    words, hits = words_of(text), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), hits


def check_base(rows, texts):
    for r in rows:
        n, hits = brute_base(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert {x for _, x in hits} <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_registered_licences(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(connect(sf).execute("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES["op11_license_scan"](spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_base for r in rows) > 0
    check_base(rows, texts)
    gpl = {d for d, t in texts.items() if "gnu general public license version 3" in " ".join(words_of(t))}
    assert gpl and {r.doc_id for r in rows if "gpl-3" in r.labels.split(",")} == gpl


def test_licences_at_the_borders(spark, tmp_path):
    texts = [
        "under the mit license", "xunder the mit license", "under the mit licenses", "UNDER--The\n(MIT) license! apache license, version 2.0", "under the mit license under the mit license",
        "cc by nc cc by nc", "cc by nc-sa", "under theé mit license", "`under the mit license`", "", None, "cc " * 9 + "by nc", "é apache license version 2 漢",
    ]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(path))
    rows = QUERIES["op11_license_scan"](spark, str(tmp_path)).collect()
    check_base(rows, dict(enumerate(texts)))
    assert {r.doc_id for r in rows if "cc-by-nc-sa" in r.labels} == {6}


@pytest.mark.parametrize(
    "expression, value",
    [
        ("MIT", (1.0, ["mit"])),
        ("GPL-3.0-only OR MIT", (1.0, ["gpl-3", "mit"])),
        ("GPL-3.0-only AND MIT", (0.4, ["gpl-3", "mit"])),
        ("MIT OR GPL-2.0 AND CC-BY-NC-4.0", (1.0, ["mit", "gpl-2", "cc-by-nc"])),  # and binds closer
        ("(MIT OR GPL-2.0) AND CC-BY-NC-4.0", (0.1, ["mit", "gpl-2", "cc-by-nc"])),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0", (0.7, ["gpl-2"])),
        ("GPL-2.0 with x and mit", (0.7, ["gpl-2", "mit"])),
        ("((Apache-2.0))", (1.0, ["apache-2"])),
        ("MIT OR", (1.0, ["mit"])),
        ("MIT AND (GPL-3.0", (0.4, ["mit", "gpl-3"])),
        ("MIT License, see file", (1.0, ["mit"])),
        ("MIT) OR GPL-3.0", (1.0, ["mit"])),
        ("()", None),
        ("OR MIT", None),
        ("", None),
    ],
)
def test_expressions(expression, value):
    got = licenses.evaluate(licenses.parse(expression))
    assert got == value or got and got[1] == value[1] and math.isclose(got[0], value[0])


def test_deep_brackets_and_labels():
    assert licenses.evaluate(licenses.parse("(" * 50_000 + "MIT" + ")" * 50_000)) == (1.0, ["mit"])
    assert [licenses.label_of(x) for x in ("Apache-2.0", "CC-BY-NC-SA-4.0", "CC0-1.0", "LGPL-2.1+", "BSD-3-Clause")] == ["apache-2", "cc-by-nc-sa", "cc0", "lgpl-2.1", "bsd-3-clause"]
    assert [licenses.freedom(x) for x in ("cc-by-nc-sa", "cc-by", "gpl-3", "lgpl-2.1", "never-heard")] == [0.1, 0.9, 0.4, 0.6, licenses.UNKNOWN]


def test_tags_take_the_rest_of_their_line():
    text = "# SPDX-License-Identifier: (MIT AND GPL-2.0)\r\nApache-2.0\nspdx license identifier MIT\nSPDX-License-Identifier:"
    n, found = licenses.scan_text(text.encode())
    assert [(f.first, f.label, f.freedom) for f in found] == [(0, "mit", 0.4), (0, "gpl-2", 0.4)] and n == len(words_of(text))


def test_longer_notices_win():
    _, found = licenses.scan_text(b"the GNU General Public License, version 3 or the GNU General Public License")
    assert [(f.first, f.words, f.label) for f in found] == [(1, 6, "gpl-3"), (9, 4, "gpl")]


def test_licences_edges(edge, empty):
    out = licenses.scan(edge)
    rows = out.select("text", "licenses.*").collect()
    assert sorted(out.columns) == sorted([*edge.columns, "licenses"]) and len(rows) == len(ROWS)
    assert all(r.n_words == len(words_of(r.text)) for r in rows)
    assert licenses.scan(empty).count() == 0 and licenses.scan(out).columns == out.columns


# -- operator 12


def brute_negatives(rows, is_anchor, s=negatives.Settings()):
    usable = []
    for i, label, x in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        usable.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * c) for c in x]))
    out = []
    order = lambda y: (-y[0], y[1] is None, y[1] or 0)
    for i, label, q in usable:
        if i is None or not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(q, r)), j, m) for j, m, r in usable if j != i and len(r) == len(q)]
        for p in sorted((y for y in scored if y[2] == label), key=order)[: s.positives]:
            fits = [y for y in scored if y[2] != label and s.low * p[0] <= 100 * y[0] <= s.high * p[0]]
            out += [(i, p[1], k + 1, y[1], p[0], y[0]) for k, y in enumerate(sorted(fits, key=order)[: s.negatives])]
    return out


def mined(spark, rows, s, is_anchor=lambda i: i % 10 == 0):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("aid", F.lit("clash")).withColumn("q", F.lit("clash"))
    out = negatives.hard_negatives(df, is_anchor, s)
    return Counter(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


SETTINGS = [negatives.Settings(leaf=8, degree=4, look=2, block=16), negatives.Settings(leaf=1, degree=3, look=1, block=1, sample=40), negatives.Settings()]


@pytest.mark.parametrize("s", SETTINGS)
def test_negatives_against_brute_force(spark, s):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 6))
    rows = [(int(i), int(r.integers(0, 4)), [float(c) for c in (centres[i % 12] + r.normal(size=6) * 0.3)]) for i in range(240)]
    rows += [(1000 + i, i % 3, [0.5, 0.25, 0.0, 0.0, 1.0, 1.0]) for i in range(60)]  # copies and ties
    rows += [(2000, 1, [0.0] * 6), (2010, 2, [0.0] * 6), (None, 1, rows[0][2]), (5, 2, rows[3][2]), (None, 2, rows[0][2])]
    rows += [(3000, None, [1.0] * 6), (3010, 1, None), (3020, 1, [float("nan")] + [0.0] * 5), (3030, 1, [None] + [1.0] * 5), (3040, 1, [float("inf")] * 6), (3050, 1, [1e200] * 6)]
    rows += [(4000 + i, i % 2, [float(i), 1.0]) for i in range(30)] + [(5000, 1, []), (5010, 1, [])]
    left_out = [x for x in rows if x[0] != 3050]  # too long for products of 64 bits
    assert mined(spark, rows, s) == Counter(brute_negatives(left_out, lambda i: i % 10 == 0, s))


def test_negatives_edges(spark):
    s = SETTINGS[0]
    assert mined(spark, [], s) == Counter()
    assert mined(spark, [(10, 1, [1.0, 2.0])], s) == Counter()
    assert mined(spark, [(1, 1, [1.0, 2.0]), (2, 2, [1.0, 1.0])], s) == Counter()  # no anchor
    big = [(i, i % 2, [float(2 ** (20 + i % 3)), float(i)]) for i in range(40)]  # products beyond 53 bits
    assert mined(spark, big, s) == Counter(brute_negatives(big, lambda i: i % 10 == 0, s))


def test_tree_leaves_parts_out():
    """Clustered vectors: a search with a narrow window reads few leaves, and misses nothing."""
    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(40, 8)) * 10, 50, 0) + r.normal(size=(2000, 8))
    tree = negatives.Gnat(x, 25, negatives.Settings())
    leaf = tree.leaves(x)
    for node, _, d, own in tree.walk(x):
        for j in np.unique(own):
            node.low[:, j], node.high[:, j] = d[own == j].min(0), d[own == j].max(0)
    q = x[:100]
    d = negatives.distances(q, x)
    near, far = np.full(100, 1.0), np.full(100, 4.0)
    pairs = set(map(tuple, tree.within(q, near, far, 1e-9).tolist()))
    needed = {(i, int(leaf[j])) for i, j in zip(*np.nonzero((d >= 1.0) & (d <= 4.0)))}
    assert needed <= pairs and len(pairs) < 0.25 * 100 * len(tree.centres)


def test_shelves_hold_neighbours_and_parts():
    first, width = negatives._shelves(np.array([3, 4, 2, 9, 0, 25, 1, 10, 1]), 10)
    assert first.tolist() == [0, 0, 0, 1, 1, 2, 5, 6, 7] and width.tolist() == [1, 1, 1, 1, 1, 3, 1, 1, 1]


def test_anchors_leave_in_bounded_batches(spark):
    """Structureless vectors, so that most anchors ask for most leaves: no batch grows with the number of leaves, and no row holds many vectors."""
    r = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, int(r.integers(0, 4)), [float(c) for c in r.normal(size=12)]) for i in range(1500)], "vec_id long, label int, embedding array<double>")
    index = negatives._Index(negatives.integer_rows(rows), negatives.Settings(leaf=8, degree=4, block=8))
    asks = index.vectors.selectExpr("vec_id AS aid", "vec_id", "label", "q", f"array({-(1 << 62)}L) AS low", f"array({1 << 62}L) AS high").limit(300).toArrow().to_batches()
    sizes = [b.num_rows for b in index.choose(False)(iter(asks))]
    assert sum(sizes) == 300 * index.vectors.select("shelf").distinct().count() > 10 * negatives.ASKS and max(sizes) <= negatives.ASKS
    assert index.vectors.groupBy("shelf").count().agg(F.max("count")).first()[0] < 40 and dict(index.vectors.dtypes)["q"] == "array<smallint>"


@pytest.mark.parametrize("rows_each", [1, 7, 1000])
def test_shelf_and_anchors_across_batches(monkeypatch, rows_each):
    """A shelf's vectors and its anchors may come in any number of batches, and what is held may leave in parts."""
    import pyarrow as pa

    monkeypatch.setattr(negatives, "HELD_ROWS", 20)
    r = np.random.default_rng(7)
    q, labels = r.integers(-9, 9, (60, 3)), r.integers(0, 3, 60)
    rows = [(int(i % 4), False, None, i, int(labels[i]), q[i].tolist(), None, None) for i in range(60) if i % 4 != 2]
    windows = {i: ([-200, 5, 3], [200, 50, 2]) if i % 2 else ([0], [90]) for i in range(0, 60, 5)}
    rows += [(s, True, 100 + i, i, int(labels[i]), q[i].tolist(), *windows[i]) for i in windows for s in range(4)]
    rows.sort(key=lambda x: x[:2])
    names = ["shelf", "asks", "aid", "vec_id", "label", "q", "low", "high"]
    kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int16()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    found = negatives._search(2, False)(batch.slice(at, rows_each) for at in range(0, len(rows), rows_each))
    got = [x for b in found for x in zip(*(c.to_pylist() for c in b.columns))]
    wanted = []
    for i, (lows, highs) in windows.items():
        for w, (low, high) in enumerate(zip(lows, highs)):
            fits = [(-int(q[i] @ q[j]), j) for j in range(60) if j % 4 != 2 and labels[j] != labels[i] and low <= q[i] @ q[j] <= high]
            wanted += [(100 + i, w, -s, j) for s, j in sorted(fits)[:2]]
    first = Counter()
    for aid, w, s, j in sorted(set(got), key=lambda x: (x[0], x[1], -x[2], x[3])):
        first[aid, w] += 1
        if first[aid, w] <= 2:
            wanted.remove((aid, w, s, j))
    assert not wanted


# -- operator 13


def brute_phrases(rows, s):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, s.longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", tuple(words[i : i + k])] += 1
    found = {g: a for g, a in counts.items() if len(g[1]) > 1 and a >= s.support}
    out = []
    for (lang, p), a in found.items():
        if any(m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= s.within * a for (m, q), b in found.items()):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(o[0], i + 1, *o[1:]) for i, o in enumerate(mine[: s.top])]
    return sorted(ranked)


def phrases(df, s):
    return sorted(map(tuple, collocations.collocations(df, s).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def make_texts(n=400, seed=3):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)] + ["New", "york", "City", "été", "a-b"]
    weights = np.append(1 / np.arange(1, 41), [0.1] * 5)
    marks = [" ", "  ", "\t", ", ", ". ", "\n", " ! "]
    out = []
    for i in range(n):
        some = r.choice(words, size=int(r.integers(0, 30)), p=weights / weights.sum()).tolist()
        text = "".join(w + marks[int(m)] for w, m in zip(some, r.choice(len(marks), size=len(some), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])))
        out.append((i, text + (" new york city" if i % 5 == 0 else ""), ["en", None, "und", "fr"][i % 4]))
    return out


@pytest.mark.parametrize("s", [collocations.Settings(sample=0.1), collocations.Settings(sample=0.0, buffer=500), collocations.Settings(sample=1.0, top=7), collocations.Settings(longest=5, support=4, sample=0.02), collocations.Settings(longest=2)])
def test_phrases_against_brute_force(spark, tmp_path, s):
    rows = make_texts()
    df = table(spark, tmp_path, rows, "doc_id long, text string, lang string")
    assert phrases(df, s) == brute_phrases([(lang, text) for _, text, lang in rows], s)


def test_missed_phrases_are_found(spark, tmp_path):
    """Frequent phrases in no sampled document, behind frequent words that the sample lacks too: two further passes find them."""
    s = collocations.Settings(sample=0.2)
    rows = [(i, f"common filler {i} and words", "en") for i in range(100)]
    df = spark.createDataFrame([(i, f"hidden rare phrase {i}", "en") for i in range(200)], "doc_id long, text string, lang string")
    outside = df.filter(F.pmod(F.xxhash64("text"), F.lit(10_000)) >= 2000).limit(30).collect()
    rows += [tuple(r) for r in outside]
    got = phrases(table(spark, tmp_path, rows, "doc_id long, text string, lang string"), s)
    assert got == brute_phrases([(lang, text) for _, text, lang in rows], s)
    assert any(r[2] == "hidden rare phrase" and r[3] == 30 for r in got)


def test_phrase_counts_pass_64_bits(spark):
    """Products are taken as decimals of 38 digits."""
    df = spark.sql("SELECT CAST(4000000000000 AS BIGINT) AS a, CAST(5000000000000 AS BIGINT) AS l, CAST(6000000000000 AS BIGINT) AS r")
    assert df.select(F.expr(collocations.SCORE)).first()[0] == 1_000_000 * 4000000000000**2 // (5000000000000 * 6000000000000)


def test_phrases_edges(edge, empty):
    s = collocations.Settings(support=2)
    rows = [(r.lang, r.text) for r in edge.select("lang", "text").collect()]
    assert phrases(edge, s) == brute_phrases(rows, s)
    assert phrases(edge.withColumn("lang", F.lit(None).cast("string")), s) == brute_phrases([(None, t) for _, t in rows], s)
    assert phrases(empty, s) == []


def test_registered_phrases(spark):
    rows = connect(SF).execute("SELECT lang, text FROM documents").fetchall()
    got = sorted(map(tuple, QUERIES["op13_toivonen_phrases"](spark, SF).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == brute_phrases(rows, collocations.Settings())
