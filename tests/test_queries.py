"""Every registered query runs; those with an oracle equal it."""

import pytest

import compare
from conftest import SF
from dictalog.plans import QUERIES


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    df = q.run(spark, SF)
    if q.oracle:
        assert compare.compare(df, con, q.oracle) == ""
    else:
        assert df.count() > 0


# Queries that work through ordered windows, with every source cut into slices.
SLICED = [
    "w2_event_sequence",
    "w1_ring_buffer",
    "p3_pause_gate",
    "j6_merge_vad",
    "w4_speech_segments",
    "w5_sample_batches",
    "w6_fixed_segments",
    "w7_text_offset_map",
    "w8_draft_spans",
]


@pytest.mark.parametrize("name", SLICED)
def test_query_with_hot_sources(spark, con, small_slices, name):
    q = QUERIES[name]
    assert compare.compare(q.run(spark, SF), con, q.oracle) == ""


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_misspelt_candidates(spark, tmp_path):
    """Misspelt and misheard boundaries are candidates of J9 with their own scores, and A8 and A9 rank by them."""
    from pyspark.sql import functions as F

    from dictalog.plans import views

    rows = [(1, "Fredy take this down please"), (2, "so, freddy brake break freddy break break"), (3, "nothing here")]
    real = views.texts
    views.texts = lambda s, sf: spark.createDataFrame(rows, "event_id LONG, text STRING").withColumn("source_id", F.lit("a"))
    try:
        got = {n: QUERIES[n].run(spark, SF).filter("phrase in ('freddy take this down', 'freddy break break')").collect() for n in ("j9_pattern_candidates", "a8_best_match_per_pattern", "a9_best_match_overall")}
    finally:
        views.texts = real
    for name, found in got.items():
        at = {r.event_id: (r.phrase, r.m_start, r.m_end, round(r.score, 6)) for r in found}
        assert at == {1: ("freddy take this down", 0, 20, round(200 * 20 / 41, 6)), 2: ("freddy break break", 22, 40, 100.0)}, name


def test_all_texts_tied_with_hot_sources(spark, con, small_slices):
    """Whole sources of one sequence number, more rows than a slice may hold."""
    q = QUERIES["t1_tied_whole"]
    assert compare.compare(q.run(spark, SF), con, q.oracle) == ""


def test_revisions_of_texts_with_the_mark_equal_sql(spark, tmp_path):
    """Texts that hold the mark of the revisions themselves, also private ones, and empty texts."""
    from dictalog.plans.draft_queries import PRIVATE_MARKS

    texts = ["\u00a4" * 40, "some words, then \u00a4\u00a4\u00a4\u00a4\u00a4\u00a4", "a\u00a4b" * 30, "\u00a4 in front " * 5, "\u00a4" + PRIVATE_MARKS[:-1], "no mark at all", "", None]
    rows = [(28 * i + j, t) for i, t in enumerate(texts) for j in range(28)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    own = compare.duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    q = QUERIES["j12_revision_similarity"]
    assert compare.compare(q.run(spark, str(tmp_path)), own, q.oracle) == ""


def test_every_text_comes_late(spark):
    """Also those without a boundary in them: as many late rows as there are texts of each kind."""
    from collections import Counter

    from dictalog.plans import views

    texts = views.texts(spark, SF).select("source_id", "text", "marker").collect()
    assert any(r.marker is None for r in texts)
    late = QUERIES["t12_late_text"].run(spark, SF).collect()
    assert Counter((r.source_id, r.full_text) for r in late) == Counter((r.source_id, r.text) for r in texts)
