"""The ten-row draft table."""

import pytest
from pyspark.sql import functions as F

from dictalog.operators import drafts as D
from dictalog.session import shared_dir
from dictalog.sources import sinks

T0 = 1704067200.0


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (f"Draft {i}", T0 + 100 * i, f"draft-uuid-{i}", "draft-uuid-2" if i == 5 else None) for i in range(10)
    ]
    return spark.createDataFrame(rows, "full_text STRING, timestamp DOUBLE, draft_id STRING, parent_draft_id STRING").cache()


def names(df):
    return [r["full_text"] for r in df.collect()]


@pytest.mark.parametrize("deep", [10_000, 1])
def test_pages(table, deep):
    page = lambda *a, **k: names(D.page_drafts(table, *a, **k, deep_page=deep))
    assert page(5, 0, "asc") == [f"Draft {i}" for i in range(5)]
    assert page(5, 5, "asc") == [f"Draft {i}" for i in range(5, 10)]
    assert page(3, 0, "desc") == ["Draft 9", "Draft 8", "Draft 7"]
    assert page(10, 20, "desc") == []
    assert page(100, 0, "asc", since=T0 + 500) == [f"Draft {i}" for i in range(5, 10)]
    assert page(3, 2, "asc", since=T0 + 200) == ["Draft 4", "Draft 5", "Draft 6"]
    assert page(10, 0, "asc", since=T0 + 1e6) == []


def test_page_arguments(table):
    for bad in ({"limit": 0}, {"limit": 1001}, {"offset": -1}, {"order": "up"}):
        with pytest.raises(ValueError):
            D.page_drafts(table, **bad)


def test_keyset_pages_cover_everything(table):
    seen, last = [], None
    while rows := D.page_after(table, last, 4, "desc").collect():
        seen += [r["full_text"] for r in rows]
        last = (rows[-1]["timestamp"], rows[-1]["draft_id"])
    assert seen == [f"Draft {i}" for i in range(9, -1, -1)]


def test_envelope(table):
    page = D.page_drafts(table, 4, 8, "asc")
    assert tuple(D.page_envelope(D.draft_count(table), page, 4, 8).first()) == (10, 4, 8, 2, False)


def family(table, ident, **k):
    return sorted((r["role"], r["member_id"]) for r in D.draft_family(table, ident, **k).collect())


def test_family(table):
    assert family(table, "draft-uuid-5") == [("draft", "draft-uuid-5"), ("parent", "draft-uuid-2")]
    assert family(table, "draft-uuid-2") == [("child", "draft-uuid-5"), ("draft", "draft-uuid-2")]
    assert family(table, "draft-uuid-0") == [("draft", "draft-uuid-0")]
    assert family(table, "nobody") == []
    assert family(table, "draft-uuid-5", include_parent=False) == [("draft", "draft-uuid-5")]


def test_append_validates_and_repeats_harmlessly(spark, table):
    path = shared_dir(spark, "t-drafts")
    assert sinks.append_drafts(table.filter("parent_draft_id IS NULL"), path, ["timestamp"]).count() == 0
    assert {(r["draft_id"], r["reason"]) for r in sinks.append_drafts(table, path, ["timestamp"]).collect()} == {
        (f"draft-uuid-{i}", "duplicate") for i in range(10) if i != 5
    }
    sinks.append_drafts(table, path, ["timestamp"])
    assert sinks.read_drafts(spark, path).count() == 10
    odd = spark.createDataFrame(
        [("x", 1.0, "new", "missing"), ("y", 2.0, "twice", None), ("z", 3.0, "twice", None)], table.schema
    )
    rejected = {(r["full_text"], r["reason"]) for r in sinks.append_drafts(odd, path, ["timestamp"]).collect()}
    assert rejected == {("x", "unknown_parent"), ("z", "duplicate")}
    assert sinks.read_drafts(spark, path).filter("draft_id = 'twice'").first()["full_text"] == "y"


def test_since_prunes_partitions(spark, table):
    path = shared_dir(spark, "t-days")
    sinks.append_drafts(table, path, ["timestamp"])
    stored = sinks.read_drafts(spark, path)
    plan = D.drafts_since(stored, T0 + 500)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan
    assert D.drafts_since(stored, T0 + 500).count() == 5


def test_every_revision_has_a_parent(spark, table):
    path = shared_dir(spark, "t-parents")
    assert sinks.append_drafts(table, path, ["timestamp"]).count() == 0  # the revision comes after its parent
    late = table.withColumn("timestamp", -F.col("timestamp")).withColumns(
        {c: F.concat(c, F.lit("-b")) for c in ("draft_id", "parent_draft_id")}
    )
    assert [r["reason"] for r in sinks.append_drafts(late, path, ["timestamp"]).collect()] == ["unknown_parent"]
    stored = sinks.read_drafts(spark, path)
    orphans = stored.filter(F.col("parent_draft_id").isNotNull()).join(
        stored.select(F.col("draft_id").alias("parent_draft_id")), "parent_draft_id", "left_anti"
    )
    assert orphans.count() == 0


def test_resolve_revision_priority(spark):
    rows = [("a", "p", 3.0, "LLM"), ("b", "p", 1.0, "HUMAN"), ("c", "p", 9.0, "WHISPER_REPROCESS"), ("d", "q", 1.0, "odd"), ("e", "q", 2.0, "odd")]
    df = spark.createDataFrame(rows, "draft_id STRING, parent_draft_id STRING, timestamp DOUBLE, kind STRING")
    got = {(r["original_draft_id"], r["revision_id"]) for r in D.resolve_revision(df, F.col("kind")).collect()}
    assert got == {("p", "b"), ("q", "e")}


def test_equal_ids_are_taken_once(spark):
    rows = [("x", 1.0, "a", None), ("x", 1.0, "a", None), ("x", 1.0, "b", None), ("y", 2.0, "c", "x"), ("z", 3.0, "d", "w")]
    df = spark.createDataFrame(rows, "draft_id string, timestamp double, full_text string, parent_draft_id string")
    got = D.validate_ids(df, df.select("draft_id").limit(0), ["timestamp"]).collect()
    assert sorted((r.draft_id, r.reason or "") for r in got) == [("x", ""), ("x", "duplicate"), ("x", "duplicate"), ("y", "unknown_parent"), ("z", "unknown_parent")]


def test_parts_of_a_draft_are_stored_and_read_whole(spark):
    from dictalog.session import shared_dir
    from dictalog.sources import sinks

    path = shared_dir(spark, "parts")
    schema = "kind string, draft_id string, timestamp double, full_text string, part_no long, parent_draft_id string"
    for batch in (
        [("part", "x", 1.0, "one ", 0, None), ("end", "y", 2.0, "short", 0, None), ("part", "z", 3.0, "open", 0, None)],
        [("part", "x", 1.0, "two ", 1, None), ("end", "x", 1.0, "three", 2, None)],
        [("end", "x", 1.0, "again", 2, None)],
    ):
        sinks.persist_ended_drafts(spark.createDataFrame(batch, schema), path, ["timestamp", "part_no"])
    stored = sinks.read_drafts(spark, path)
    assert stored.count() == 5
    assert sorted((r.draft_id, r.full_text) for r in sinks.whole_drafts(stored).collect()) == [("x", "one two three"), ("y", "short")]


def test_deep_and_shallow_pages_agree_with_unknown_times(spark):
    rows = [(f"d{i:03}", None if i % 11 == 0 else float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "draft_id string, timestamp double")
    for order in ("asc", "desc"):
        for offset in (0, 5, 40, 88, 99, 120):
            deep = D.page_drafts(df, 7, offset, order, deep_page=1).collect()
            assert deep == D.page_drafts(df, 7, offset, order).collect()


def test_append_judges_without_texts(spark, tmp_path):
    """What decides about a draft is told apart from its text, and a revision of a parent in two parts is stored once."""
    from dictalog.sources import sinks

    rows = [("p", 1.0, "one", None, 0), ("p", 1.0, "two", None, 1), ("c", 2.0, "child", "p", 0), ("x", 3.0, "lost", "nobody", 0)]
    df = spark.createDataFrame(rows, "draft_id STRING, timestamp DOUBLE, full_text STRING, parent_draft_id STRING, part_no LONG")
    refused = sinks.append_drafts(df, str(tmp_path / "drafts"), ["timestamp"]).collect()
    kept = sinks.read_drafts(spark, str(tmp_path / "drafts")).select("draft_id", "full_text").collect()
    assert sorted(map(tuple, kept)) == [("c", "child"), ("p", "one"), ("p", "two")]
    assert [(r["draft_id"], r["full_text"], r["reason"]) for r in refused] == [("x", "lost", "unknown_parent")]
    _, reasons = D.judge_ids(df, df.select("draft_id", "part_no").limit(0), ["timestamp"])
    assert "full_text" not in reasons.columns
