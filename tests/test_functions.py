import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dictalog.functions import edits, fuzzy, samples, texts, times
from dictalog.operators import events as E
from dictalog.operators import matching as M


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize(
    "text, seconds",
    [
        ("1704067200.5", 1704067200.5),
        ("1704067200", 1704067200.0),
        ("2024", 2024.0),
        ("2024-01-01T00:00:00", 1704067200.0),
        ("2024-01-01T00:00:00Z", 1704067200.0),
        ("2024-01-01T00:00:00+00:00", 1704067200.0),
        ("2024-01-01T02:00:00+02:00", 1704067200.0),
        ("2024-01-01", 1704067200.0),
        ("not-a-timestamp", None),
        ("", None),
        ("nan", None),
        ("inf", None),
        ("1_0", None),
    ],
)
def test_parse_timestamp(spark, text, seconds):
    got, error = one(spark, times.parse_timestamp(F.lit(text)), times.parse_error(F.lit(text)))
    assert got == seconds
    assert (error is None) == (seconds is not None) and (error is None or text in error)


def test_time_ago(spark):
    ages = [0, 59.9, 60, 3599, 3600, 86399, 86400, 200000]
    got = one(spark, *[times.time_ago(F.lit(1e6 - a), F.lit(1e6)) for a in ages], times.time_ago(F.lit(None).cast("double"), F.lit(1e6)))
    assert got == ("0s ago", "59s ago", "1m ago", "59m ago", "1h ago", "23h ago", "1d ago", "2d ago", None)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_lcs_and_best_window_against_brute_force():
    rnd = random.Random(3)
    for _ in range(150):
        phrase = rnd.choice(["break break break", "freddy stop now", "freddy break break"])
        noise = lambda: "".join(rnd.choice("abe krfdyst ") for _ in range(rnd.randint(0, 12)))
        mid = list(phrase)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(mid))
            mid[k : k + rnd.randint(0, 1)] = rnd.choice(["", "x", "."])
        text = noise() + "".join(mid) + noise()
        cleaned, where = fuzzy.clean_with_map(text)
        best = None
        if len(cleaned) >= len(phrase):
            for s in range(len(cleaned)):
                for n in range(1, min(len(phrase), len(cleaned) - s) + 1):
                    lcs = brute_lcs(phrase, cleaned[s : s + n])
                    assert fuzzy.lcs_length(phrase, cleaned[s : s + n]) == lcs
                    score = 200.0 * lcs / (len(phrase) + n)
                    if score >= 85 and (best is None or (-score, s, -n) < best[0]):
                        best = ((-score, s, -n), (int(where[s]), int(where[s + n - 1]) + 1))
        got = fuzzy.PhraseMatcher([fuzzy.Pattern("end", phrase)]).best_per_pattern(text)
        assert (best[1] if best else None) == ((got[0].start, got[0].end) if got else None)


def test_near_word_closed_form(spark):
    """The SQL form equals the exact ratio for mutated default words."""
    rnd = random.Random(5)
    words = ["freddy", "rupert", "break", "great", "stop", "draft", "start", "new", "close", "end"]
    pairs = []
    for _ in range(2000):
        q = rnd.choice(words)
        w = list(q)
        for _ in range(rnd.randint(0, 2)):
            k = rnd.randrange(len(w) + 1)
            w[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "e", "d"])
        pairs.append(("".join(w) or "x", q))
    df = spark.createDataFrame(pairs, "w STRING, q STRING")
    got = df.select("w", "q", texts.near_word(F.col("w"), F.col("q")).alias("near")).collect()
    for r in got:
        assert r["near"] == (fuzzy.indel_ratio(r["w"], r["q"]) >= 90), r


def test_clean_text_and_map(spark):
    raw = "Freddy, take — THIS\tdown! İx"
    cleaned, where = one(spark, texts.clean_text(F.lit(raw)), texts.clean_map(F.lit(raw)))
    py, py_where = fuzzy.clean_with_map(raw)
    assert cleaned == py and list(where) == list(py_where)
    assert len(cleaned) == len(where)


def test_choice_among_patterns():
    pick = lambda *names: fuzzy.PhraseMatcher([fuzzy.Pattern("start", n) for n in names])
    hit = pick("freddy start draft", "freddy start draft now").match_first("well freddy start draft now please")
    assert hit.phrase == "freddy start draft now"
    hit = pick("freddy stop now", "rupert stop now").match_first("rupert stop now and freddy stop now")
    assert hit.phrase == "rupert stop now"


def test_subscriptions(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    all_, most, named, bad = one(
        spark,
        E.expand_subscription(arr("all")),
        E.expand_subscription(arr("all_but_chunks", "all")),
        E.expand_subscription(arr("TextEvent", "TextEvent")),
        E.expand_subscription(arr("TextEvent", "Nope")),
    )
    assert len(all_) == 9 and len(most) == 8 and "AudioChunkEvent" not in most
    assert named == ["TextEvent"] and bad is None


def test_suggestions(spark):
    rows = [
        (1, '{"suggestions": [{"old_text": "a", "new_text": "b", "confidence": 0.95, "reason": "r"}]}'),
        (2, '{"suggestions": []}'),
        (3, "no json"),
        (4, '{"full_text": "one two", "parts": [{"start": 4, "end": 7, "suggestions": [{"action": "remove", "confidence": 0.5, "reason": "x"}]}]}'),
    ]
    good, bad = edits.parse_suggestions(spark.createDataFrame(rows, "id INT, reply STRING"))
    assert {(r["id"], r["action"], r["old_text"]) for r in good.collect()} == {(1, "replace", "a"), (4, "remove", "two")}
    assert [r["id"] for r in bad.collect()] == [3]


def test_sample_functions(spark):
    frames = F.array(F.array(F.lit(1.0).cast("float"), F.lit(3.0).cast("float")))
    mono, three, cut, n, pcm = one(
        spark,
        samples.mix_channels(frames, 2, 1),
        samples.mix_channels(frames, 2, 3),
        F.size(samples.fit_512(F.array_repeat(F.lit(1.0).cast("float"), 600))),
        samples.frames_per_chunk(F.lit(0.5), F.lit(5)),
        samples.pcm16_encode(F.array(F.lit(-1.0).cast("float"), F.lit(0.5).cast("float"))),
    )
    assert mono == [[2.0]] and three == [[1.0, 3.0, 0.0]] and cut == 512 and n == 2 and pcm == [-32767, 16383]


def test_resample_keeps_a_tone():
    t = np.arange(4410) / 44100
    got = samples.resample_block(np.sin(2 * np.pi * 440 * t).astype(np.float32), 44100, 16000)
    assert got.size == 1600
    want = np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)
    assert np.abs(got[50:-50] - want[50:-50]).max() < 0.02


def test_partial_align_udf(spark):
    df = spark.createDataFrame([("x freddy brake break",), ("nothing here",), (None,)], "t STRING")
    got = [r[0] for r in df.select(M.partial_align(F.lit("freddy break break"), F.col("t"))).collect()]
    assert got[0]["score"] > 85 and got[1]["score"] is None and got[2]["score"] is None


def test_boundary_words_only_at_the_edges(spark):
    words = " ".join(f"w{i}" for i in range(30))
    flags = one(
        spark,
        texts.boundary_words_at_edges(F.lit("take this down. " + words), ["down", "break"]),
        texts.boundary_words_at_edges(F.lit(words[:60] + " break " + words), ["down", "break"]),
        texts.boundary_words_at_edges(F.lit(words + " break break"), ["down", "break"]),
    )
    assert flags == (True, False, True)


def test_long_words_are_scored_exactly(spark):
    import random

    from dictalog.functions import texts as X
    from dictalog.functions.fuzzy import _near, lcs_length

    r = random.Random(5)
    words = ["supervision", "supervixiox", "superevision", "supervisions", "responsibility", "resposibility", "responsibilitie"]
    words += ["".join(r.choice("abcde") for _ in range(r.randint(9, 16))) for _ in range(40)]
    words += [w[:3] + w[4:] for w in words[-40:]]
    pairs = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.near_word(F.col("a"), F.col("b")).alias("near")).collect()
    assert all(g.near == _near(g.a, g.b) for g in got)
    got = spark.createDataFrame(pairs[:300], "a string, b string").select("a", "b", X.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(g.n == lcs_length(g.a, g.b) for g in got)


def test_phrases_of_any_length():
    from dictalog.functions.fuzzy import Pattern, PhraseMatcher

    phrase = "this phrase goes on for a good deal longer than sixty three characters before it ends"
    matcher = PhraseMatcher([Pattern("start", phrase)])
    text = f"before {phrase.replace('deal', 'dael')} after"
    hit = matcher.match_first(text)
    assert text[hit.start : hit.end] == phrase.replace("deal", "dael") and 95 < hit.score < 100
    assert matcher.match_first("nothing of the kind " * 10) is None


def test_bounded_alignment_against_brute_force():
    """Every cut-off gives the exact length or rightly none, by either way through."""
    rnd = random.Random(9)
    for _ in range(300):
        a = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 60)))
        b = list(a)
        for _ in range(rnd.randint(0, 12)):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.randint(0, 2)] = rnd.choice(["", "x", "ab"])
        b = "".join(b)
        want = brute_lcs(a, b)
        for least in {0, max(0, want - 1), want, want + 1, len(a), len(b)}:
            got = fuzzy.lcs_at_least(a, b, least)
            assert got == (want if want >= least else None), (a, b, least)
        assert fuzzy._differences(a, b, len(a) + len(b)) == len(a) + len(b) - 2 * want
        assert fuzzy._lcs_bits(a, b, want) == want and fuzzy._lcs_bits(a, b, want + 1) is None
        for minimum in (60.0, 75.0, 90.0):
            full = fuzzy.indel_ratio(a, b)
            assert fuzzy.indel_ratio(a, b, minimum) == (full if full >= minimum else None)


def test_alignment_costs_the_differences():
    """Long texts that differ little, and such that differ too much, take a fraction of the bit matrix."""
    import time

    rnd = random.Random(4)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(200_000))
    b = a[:50_000] + "x" + a[50_001:120_000] + a[120_005:]

    def took(run):
        start = time.perf_counter()
        return run(), time.perf_counter() - start

    near, fast = took(lambda: fuzzy.lcs_at_least(a, b, 150_000))
    assert near == 200_000 - 6 and fast < 0.5
    other = "".join(rnd.choice("abcdefgh ") for _ in range(150_000)) + "z" * 50_000
    assert took(lambda: fuzzy.lcs_at_least(a, other, 180_000))[0] is None


def test_dense_stretch_is_necessary():
    """Whatever the matcher finds of a phrase without required words, has the stretch that the filter asks for."""
    rnd = random.Random(6)
    from dictalog.functions.phrases import BARE_CLOSE

    matcher = fuzzy.PhraseMatcher([fuzzy.Pattern("end", p) for p in BARE_CLOSE])
    hits = 0
    for _ in range(3000):
        mid = list(rnd.choice(BARE_CLOSE))
        for _ in range(rnd.randint(0, 5)):
            at = rnd.randint(0, len(mid))
            mid[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "t", " "])
        text = "and so " + "".join(mid) + " it is"
        for m in matcher.best_per_pattern(text):
            d = fuzzy.Dense.of(fuzzy.normal(m.phrase), fuzzy.RATIO_MIN)
            runs = [len(x) for x in __import__("re").split(d.others, text)]
            assert any(sum(runs[i : i + d.foreign + 1]) >= d.least for i in range(len(runs)))
            assert __import__("re").search(d.run, text)
            hits += 1
    assert hits > 500


def test_near_pattern_is_near_word():
    """The pattern finds a text just if one of its words is near: all words one or two edits away from the required ones."""
    import re

    from dictalog.functions.phrases import CLOSE_VERBS, NAMES, OBJECT, OPEN_VERBS

    rnd = random.Random(8)
    required = [*NAMES, OBJECT, *OPEN_VERBS, *CLOSE_VERBS, "break", "great"]
    for q in required:
        pattern = re.compile(texts.near_pattern([q]))
        near = 0
        for _ in range(2000):
            word = list(rnd.choice([q, q, rnd.choice(required)]))
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randint(0, len(word))
                word[at : at + rnd.randint(0, 1)] = rnd.choice(["", q[0], "x", "1"])
            word = "".join(word)
            text = rnd.choice(["", "and ", "x\n"]) + word + rnd.choice(["", " more", "\t"])
            want = any(w and fuzzy._near(w, q) for w in re.split(r"[ \t\n]", text))
            assert (pattern.search(text) is not None) == want, (q, text)
            near += want
        assert near > 100
    assert texts.near_pattern(["tenletters"]) is None


def test_edit_drafts_few_prompts_at_a_time(spark):
    """Every draft gets its reply, with the other columns as they were, and only a few prompts become Python objects at a time."""
    from dictalog.functions import plugins

    rows = spark.range(1000).selectExpr("id", "repeat('x', CAST(id % 7 AS INT)) AS prompt", "array(id) AS other")
    got = plugins.edit_drafts(rows, lambda: lambda p: f"{len(p)}")
    assert got.columns == ["id", "prompt", "other", "reply"]
    assert {(r["id"], r["other"][0], r["reply"]) for r in got.collect()} == {(i, i, str(i % 7)) for i in range(1000)}
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_common_parts_and_foreign_letters_are_not_searched(monkeypatch):
    """A text put before, behind or in place of a part of another, or cut out of it, takes no search however long it is."""

    def searched(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(fuzzy, "_differences", searched)
    monkeypatch.setattr(fuzzy, "_lcs_bits", searched)
    text = "some words of a text " * 500
    n, k = len(text), 3000
    for other, common in ((text + "¤" * k, n), ("¤" * k + text, n), (text[k:], n - k), (text[: n - k] + "¤" * k, n - k), (text[:k] + "¤" + text[k + 1 :], n - 1)):
        assert fuzzy.lcs_at_least(text, other, common) == common and fuzzy.lcs_at_least(text, other, common + 1) is None
