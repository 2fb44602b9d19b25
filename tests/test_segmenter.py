import random

import golden
from dictalog.functions.fuzzy import PhraseMatcher
from dictalog.functions.phrases import default_patterns
from dictalog.operators.segmenter import build_drafts
from dictalog.operators.slices import KeySlices, plan_slices
from dictalog.plans import views
from conftest import SF


def _frame(spark, rows):
    return spark.createDataFrame(rows, golden.SCHEMA)


def test_default_pattern_counts():
    kinds = [p.kind for p in default_patterns()]
    assert (kinds.count("start"), kinds.count("end")) == (98, 47)


def test_golden_batch(spark):
    df = _frame(spark, golden.rows())
    golden.check([r.asDict() for r in build_drafts(df, KeySlices("source_id", "seq")).collect()])


def test_golden_batch_sliced(spark):
    df = _frame(spark, golden.rows())
    slices = plan_slices(df, "source_id", "seq", max_rows=2)
    assert not slices.trivial
    golden.check([r.asDict() for r in build_drafts(df, slices).collect()])


def noisy_rows(seed: int, n: int):
    """Texts that break boundary phrases over rows, misspell them and repeat their words."""
    rnd = random.Random(seed)
    bits = ["freddy", "Freddy,", "take this", "down", "break", "break break.", "stop now", "fredy", "hello there",
            "Freddy take", "this down", "freddy break", "freddy take this down", "the brakes", "new draft", "draft", "now", "rupert", "great great", " ", "and so on we went", "break break break"]
    rows = []
    for source in ("a", "b"):
        t = 0.0
        for i in range(n):
            text = " ".join(rnd.choice(bits) for _ in range(rnd.randint(1, 4)))
            t += rnd.choice([1.0, 2.0, 2.0, 3.0, 3.0, 30.0])
            rows.append((source, i, text, t, t + 1.0))
    return rows


def by_hand(rows):
    """The same semantics, one row after the other with the whole running text in memory."""
    from dictalog.operators.segmenter import CONTEXT, EXPIRY_S, FORCED, walk
    from dictalog.functions.fuzzy import SPACES

    matcher = PhraseMatcher(default_patterns())
    out = []
    for source in sorted({r[0] for r in rows}):
        text, opened, prev_end, floor, used = "", None, None, 0, 0
        spans = []
        for _, _, piece, start, end in sorted(r for r in rows if r[0] == source):
            if prev_end is not None and end - prev_end > EXPIRY_S:
                floor = len(text)
            pad = " " if text and text[-1] not in SPACES and piece[0] not in SPACES else ""
            if floor == len(text):
                floor += len(pad)
            text += pad
            lo = max(floor, len(text) - CONTEXT)
            ctx, at = text[lo:], len(text)
            text += piece
            spans.append((at, len(text), start, end))
            for m, a, b, said in walk(matcher, ctx + piece, len(ctx), max(0, used - lo)):
                used = lo + b
                if opened:
                    out.append((source, opened[0], said, text[opened[1] : lo + a], opened[2], end, False))
                    opened = None
                if m.kind == "start":
                    first = next(s for x, y, s, _ in spans if y > lo + a)
                    opened = (lo + a, lo + b, first)
            prev_end = end
        if opened:
            out.append((source, opened[0], FORCED, text[opened[1] :], opened[2], prev_end, True))
    return sorted(out)


def as_tuples(rows):
    return sorted(
        (r["source_id"], r["opened_at"], r["end_text"], r["full_text"], r["audio_start_time"], r["audio_end_time"], r["forced"])
        for r in rows
    )


def test_batch_equals_row_by_row(spark):
    for seed in (1, 2):
        rows = noisy_rows(seed, 150)
        expected = by_hand(rows)
        df = _frame(spark, rows)
        assert len(expected) > 10
        assert as_tuples(build_drafts(df, KeySlices("source_id", "seq")).collect()) == expected
    sliced = plan_slices(df, "source_id", "seq", max_rows=25)
    assert as_tuples(build_drafts(df, sliced).collect()) == expected


def test_long_drafts_come_in_parts(spark):
    rows = [("a", 0, "freddy take this down", 0.0, 1.0)] + [("a", i, f"word{i}", float(i), i + 1.0) for i in range(1, 40)]
    got = build_drafts(_frame(spark, rows), KeySlices("source_id", "seq"), part_chars=50).collect()
    assert len(got) > 4 and len({d["draft_id"] for d in got}) == 1
    text = "".join(d["full_text"] for d in sorted(got, key=lambda d: d["part_no"]))
    assert text == "".join(f" word{i}" for i in range(1, 40))


def test_markers_of_conversations(spark):
    """Every injected start phrase opens exactly one draft, and drafts of a source never overlap."""
    texts = views.texts(spark, SF)
    drafts = build_drafts(texts, KeySlices("source_id", "seq")).collect()
    assert len(drafts) == texts.filter("marker = 'start'").count()
    assert len({d["draft_id"] for d in drafts}) == len(drafts)


def test_required_words_and_long_phrases_far_back(spark):
    """A required word counts for 20 seconds however far back it stands, unless a boundary has used it up; phrases of any length
    are found when split over texts. Batch, sliced and stream alike."""
    from dictalog.functions.fuzzy import Pattern
    from dictalog.streaming.runner import run_available, stream_of
    from dictalog.streaming.segmenter import stream_drafts

    filler = "and so on we went along the river " * 8
    long = "please open the big brown book of the harbour office and turn to the page with the tide tables for the month"
    patterns = default_patterns() + [Pattern("start", long, ("tide",))]
    rows = []
    for source, wait, first in (("near", 10.0, "new shoes"), ("old", 21.0, "new shoes"), ("used", 10.0, "new shoes freddy break break")):
        rows += [(source, 0, first, 0.0, 1.0), (source, 1, filler, 1.0, 2.0), (source, 2, "freddy draft now", 2.0, 1.0 + wait), (source, 3, "oars", 22.0, 23.0)]
    rows += [("long", i, part, float(i), i + 1.0) for i, part in enumerate([long[:50], long[50:101].strip(), long[101:].strip() + " oars"])]
    df = _frame(spark, rows)
    got = {}
    for name, slices in (("whole", KeySlices("source_id", "seq")), ("sliced", plan_slices(df, "source_id", "seq", max_rows=2))):
        got[name] = sorted((r.source_id, r.opened_at, r.full_text.strip()) for r in build_drafts(df, slices, patterns=patterns).collect())
    stops = _frame(spark, [(s, 9, None, 30.0, 30.0) for s in ("near", "old", "used", "long")])
    events = run_available(stream_drafts(stream_of(df.unionByName(stops), "far"), patterns), "far").filter("kind = 'end'").collect()
    got["stream"] = sorted((r.source_id, r.opened_at, r.full_text.strip()) for r in events)
    opened = len("new shoes ") + len(filler)
    for name, found in got.items():
        assert found == [("long", 0, "oars"), ("near", opened, "oars")], name


def test_late_texts_are_written_in_many_tasks(spark, tmp_path, monkeypatch):
    """The table behind the stream of late texts comes in as many files as it has parts, not in one."""
    from conftest import SF
    from dictalog.plans import text_queries, views

    real = views.texts
    monkeypatch.setattr(views, "texts", lambda s, sf: real(s, sf).repartition(3))
    monkeypatch.setattr(text_queries, "shared_dir", lambda s, name: str(tmp_path / name))
    marked = real(spark, SF).filter("marker IS NOT NULL").count()
    assert text_queries.t12(spark, SF).count() == marked
    assert len(list((tmp_path / "late").glob("*.parquet"))) == 6
