"""Operators 4, 5, 8 and 10, and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from compare import connect
from pyspark.sql import functions as F

from conftest import SF
from dictalog.llm import disclosure, pieces, postings, subwords
from dictalog.llm.queries import QUERIES
from llm.conftest import ROWS, table

# -- operator 4

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            valid = (True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)
            if valid[kind]:
                out.append((m.start(), kind, m.end()))
    return ",".join(f"{disclosure.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def spans(df, below=None):
    return [r[0] for r in disclosure.span_lists(df).orderBy("rid").select(disclosure.written(below)).collect()]


def test_base_spans(spark, tmp_path):
    r = random.Random(9)
    bits = ["a.b@c.d", "@", "_x@y.z", "1.2.3.4", "256.1.1.1", ".5", "+1 (724) 555-7058", "4111 1111 1111 1111", "4111-1111", " ", "é漢", "\n", "+", "7", "-", "x"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(400)] + [None, "", "9" * 30000 + " " + "a" * 30000 + "@" + "1." * 8000, "1 " * 20000]
    df = table(spark, tmp_path, list(enumerate(texts)), parts=1)
    assert sorted(spans(df, 4)) == sorted(base_spans(t or "") for t in texts)


def test_registered_base_spans(spark):
    docs = dict(connect(SF).execute("SELECT doc_id, text FROM documents").fetchall())
    for r in QUERIES["op4_disclosure_pii"](spark, SF).collect():
        assert r.base_sha256 == hashlib.sha256(base_spans(docs[r.doc_id] or "").encode()).hexdigest()


def test_disclosing_terms(spark, tmp_path):
    """A word that comes only with one value goes; one that comes mostly with it is generalised; a common one stays."""
    rows = [(i, f"call {n} zork about plinth today a@b.co and then rest") for i, n in enumerate(["one", "two", "three", "four", "five"])]
    rows += [(10, "plinth today")] + [(20 + i, f"call about today and then rest {i}") for i in range(40)]
    df = table(spark, tmp_path, rows, parts=1)
    text = {r.doc_id: r.text for r in disclosure.sanitised(df).collect()}
    assert text[0] == "call one  about [word] today [email] and then rest"
    assert text[10] == "plinth today" and text[20] == "call about today and then rest 0"
    near = [t for s in spans(df) for t in s.split(",") if t.startswith(("term", "hint"))]
    assert len(near) == 10


@pytest.mark.parametrize("s", [disclosure.Settings(), disclosure.Settings(broadcast=0, hot=3)])
def test_terms_of_whole_documents(spark, tmp_path, s):
    """A name far from the value goes, at every place, also between values of one kind; copies are no evidence."""
    far = " ".join(["call about today and then rest"] * 20)
    rows = [(i, f"Zork, {n} {far} zork\t{far} 10.0.0.1 (zork) 10.0.0.{i + 2} a@b.co") for i, n in enumerate(["one", "two", "three", "four"])]
    rows += [(10 + i, f"krill {far} c@d.co") for i in range(4)] + [(20 + i, f"{far} {i}") for i in range(40)]
    text = {r.doc_id: r.text for r in disclosure.sanitised(table(spark, tmp_path, rows), s).collect()}
    assert text[0] == f" one {far} \t{far} [ip]  [ip] [email]"
    assert text[10] == f"krill {far} [email]" and text[20] == f"{far} 0"


def test_pii_edges(edge, empty):
    out = disclosure.sanitised(edge)
    assert out.columns == edge.columns and out.count() == len(ROWS)
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[10] == "mail me at [email] or [phone], [ip] é漢 [card]" and text[3] is None and len(text[9]) == 50000
    assert disclosure.span_lists(empty).count() == 0


# -- operator 5


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.MODEL)


def all_paths(p, text):
    word = pieces.SPACE + text.replace(pieces.SPACE, pieces._LITERAL).replace(" ", pieces.SPACE)

    def walk(i):
        if i == len(word):
            yield 0.0, ()
            return
        single = False
        for j in range(i + 1, len(word) + 1):
            if found := p.ids.get(word[i:j]):
                single |= j == i + 1
                for s, rest in walk(j):
                    yield found[0] + s, found[1] + rest
        if not single:
            letter = pieces.SPACE if word[i] == pieces._LITERAL else word[i]
            for s, rest in walk(i + 1):
                yield p.unknown + s, tuple(p.bytes[b] for b in letter.encode()) + rest

    return sorted(walk(0), reverse=True) if text else [(0.0, ())]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_n_best_is_the_best_of_all(vocabulary, n):
    r = random.Random(3)
    for _ in range(150):
        text = "".join(r.choice("the a\n漢é  ing▁") for _ in range(r.randint(0, 9)))
        got, want = pieces.Encoder(vocabulary, n).encode(text), all_paths(vocabulary, text)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:n]])
        assert len({i for _, i in got}) == len(got) and {i for _, i in got} <= {i for _, i in want}
        assert all(vocabulary.decode(list(i)) == text for _, i in got)


def test_round_trip(edge, empty):
    out = pieces.decode(pieces.encode(edge, n=2).withColumn("best", F.col("pieces")[0]["ids"]), "best", name="back")
    assert out.count() == len(ROWS) and all(r.back == r.text for r in out.select("text", "back").collect())
    assert pieces.encode(empty).count() == 0 and pieces.digests(empty).count() == 0


def test_registered_digests(spark):
    docs = dict(connect(SF).execute("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES["op5_nbest_pieces"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
        assert r.scores == sorted(r.scores, reverse=True) and len(r.scores) <= 3


# -- operator 8


def nearest(rows, is_query, k):
    x = {i: np.array(v) for i, v in rows}
    return {q: [i for _, i in sorted((-float(x[q] @ x[i]), i) for i in x if i != q)][:k] for q in x if is_query(q)}


def test_recall(spark):
    rows = connect(SF).execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    want = nearest([(i, np.array(v, np.float64)) for i, v in rows], lambda i: i % 20 == 0, 20)
    got = {}
    for r in QUERIES["op8_posting_ann"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values())) and set(got) == set(want)


def test_copies_ties_and_unusable_vectors(spark):
    r = np.random.default_rng(2)
    base = r.integers(1, 9, size=(40, 4)) * r.choice([-1, 1], size=(40, 4))  # sums are exact
    rows = [(i, [float(c) for c in base[i % 40 if i < 200 else 0]]) for i in range(300)]
    bad = [(1000, None), (1001, [0.0] * 4), (1002, [float("nan")] + [0.0] * 3), (1003, [1.0, None, 0.0, 0.0]), (1004, []), (1005, [1.0]), (None, [1.0] * 4), (1006, [float("inf")] * 4)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("did", F.lit("clash"))
    s = postings.Settings(per_list=10, block=32)
    got = {}
    for x in postings.search(df, lambda i: i % 7 == 0, s).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got == nearest(rows, lambda i: i % 7 == 0, 20)
    one = postings.search(df.filter("vec_id = 1005 or vec_id < 10").unionByName(spark.createDataFrame([(14, [2.0], "clash"), (21, [3.0], "clash")], df.schema)), lambda i: i % 7 == 0).collect()
    # vectors of a rarer length find each other
    assert [(x.vec_id, x.score) for x in sorted(one, key=lambda x: x.rank) if x.query_id == 14] == [(21, 6.0), (1005, 2.0)]
    few = postings.search(df.filter("vec_id in (7, 8, 14)"), lambda i: i % 7 == 0).collect()
    assert len(few) == 4
    assert postings.search(df.filter("false"), lambda i: i % 7 == 0).count() == 0


# -- operator 10


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(connect(sf).execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = QUERIES["op10_subword_quality"](spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held) and len({truth[r.doc_id] for r in held}) == 2


def test_features_are_words_pairs_and_grams():
    got = [(d.tolist(), len(set(b.tolist()))) for d, b in subwords.features(["ab cd", None, "ab"], 1 << 20)]
    assert got[0] == ([0, 0, 2], 2) and got[1][0] == [0]
    assert got[2] == ([0, 0, 0, 0, 2, 2], 4)  # " ab", "ab ", " cd", "cd "
    assert got[3] == ([0, 0, 2], 2) and got[4][0] == []


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (8, None), (9, 5)], "doc_id long, quality int")
    model = subwords.fit(edge, labels, "quality", F.lit(True), subwords.Settings(buckets=1 << 10))
    out = subwords.score(edge, model)
    assert sorted(out.columns) == sorted(edge.columns) and out.count() == len(ROWS)
    assert all(0 <= r.score <= 1 for r in out.select("score").collect())
    assert subwords.score(empty, model).count() == 0
    none = subwords.fit(empty, labels, "quality", F.lit(True), subwords.Settings(buckets=1 << 10))
    assert {r.score for r in subwords.score(edge, none).select("score").collect()} == {0.5}


# -- pipeline


def test_pipeline_against_plain_python(spark):
    import corpus_pipeline as pipeline
    from dictalog.llm import mixing
    from llm.test_tables import brute_exact, brute_links

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, out = [], docs
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.materialize(stage(spark, out, SF), name)
        assert out.columns == docs.columns
        steps.append([(r.doc_id, r.text) for r in out.collect()])
    quality, exact, near, mixed = steps
    truth = dict(connect(SF).execute("SELECT doc_id, quality FROM labels").fetchall())
    ids = {d for d, _ in quality}
    assert all(truth[d] == 1 for d in ids if d in truth) or sum(truth[d] == 0 for d in ids if d in truth) <= 0.05 * len(ids)
    assert sorted(d for d, _ in exact) == sorted(min(g)[2] for g in brute_exact(quality).values())
    groups = brute_links(exact)
    assert sorted(d for d, _ in near) == sorted({c for _, c in groups.values()})
    frame = spark.createDataFrame(near, "doc_id long, text string").join(docs.select("doc_id", "source"), "doc_id")
    copies = {r.id: r.copies for r in mixing.copies(frame, mixing.n_words(F.col("text"))).collect()}
    assert sorted(d for d, _ in mixed) == sorted(d for d, n in copies.items() for _ in range(n))
    final = pipeline.STAGES[-1][1](spark, out, SF).collect()
    assert sorted(r.decoded_sha256 for r in final) == sorted(hashlib.sha256(t.encode()).hexdigest() for _, t in mixed)


def test_pipeline_stages_take_edges(spark, edge, empty):
    import corpus_pipeline as pipeline

    out = edge
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == edge.columns
        out = pipeline.materialize(out, "edge")
    pipeline.STAGES[-1][1](spark, out, SF).collect()
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_bags_are_few_large_arrays():
    """What training holds goes back to the system afterwards; the features of each text are where ``begin`` says."""
    texts = ["a b a", None, "", "long text " * 50] * 300
    ids, shares, begin = subwords._bags(texts, 1 << 10)
    assert len(begin) == len(texts) + 1 and begin[-1] == len(ids) == len(shares)
    for i in (0, 1, 3, 499, 500, 1199):
        which, n = np.unique(np.concatenate([b for _, b in subwords.features([texts[i]], 1 << 10)]), return_counts=True)
        assert (ids[begin[i] : begin[i + 1]] == which).all() and np.allclose(shares[begin[i] : begin[i + 1]], n / max(1, n.sum()))
    assert [len(x) for x in subwords._bags([], 8)] == [0, 0, 1]


def test_words_are_forgotten_by_later_steps(spark, monkeypatch):
    """A worker's memory of words outlives its tasks, but not the steps that come long after."""
    import time

    from dictalog.llm import batches, pieces

    run = pieces._columns(lambda texts: pieces.pd.DataFrame({"n": [len(pieces.encoder(pieces.MODEL, 3).choices(t)[0]) for t in texts]}), {"n": "long"}).func
    assert len(list(run(iter([pieces.pd.Series(["some words"])])))) == 1
    assert pieces.encoder.cache_info().currsize == 1
    later = time.monotonic() + 60
    monkeypatch.setattr(batches.time, "monotonic", lambda: later)
    batches.give_back()
    assert pieces.encoder.cache_info().currsize == 0 and not batches.REMEMBERED
