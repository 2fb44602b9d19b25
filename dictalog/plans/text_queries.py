"""Registered queries on text events: boundary phrases, segmenting, assembling."""

from __future__ import annotations

from pyspark.sql import functions as F

from dictalog.functions import texts as X
from dictalog.functions.phrases import default_patterns, patterns_frame
from dictalog.functions.table_functions import register_phrase_table
from dictalog.operators import matching as M
from dictalog.operators import segmenter as S
from dictalog.operators.drafts import page_drafts
from dictalog.operators.ranges import overlap_join
from dictalog.plans import views
from dictalog.plans.registry import query
from dictalog.session import shared_dir
from dictalog.sources import sinks
from dictalog.streaming.runner import completion_report, run_available, run_each_batch, run_until_done, stream_of
from dictalog.streaming.segmenter import stream_drafts

PUNCT_SQL = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
CLEAN_SQL = f"translate(lower(text), {PUNCT_SQL}, '')"
SPACE = r"[ \t\n\x0b\f\r]"

PATTERNS_SQL = """(
SELECT 'start' AS kind, concat(n, ' take this down') AS phrase FROM (SELECT unnest(['freddy', 'rupert']) AS n) a
UNION ALL SELECT 'end', concat(n, ' ', p) FROM (SELECT unnest(['freddy', 'rupert']) AS n) a,
 (SELECT unnest(['break break', 'great great', 'stop stop', 'stop now']) AS p) b
UNION ALL SELECT 'start', concat(r, n, ' ', v, ' ', g, 'draft', t) FROM (SELECT unnest(['freddy', 'rupert']) AS n) a,
 (SELECT unnest(['', 'hey ', 'wake up ']) AS r) b, (SELECT unnest(['', 'a ', 'the ', 'uh ']) AS g) c,
 (SELECT unnest(['start', 'new']) AS v) d, (SELECT unnest(['', ' now']) AS t) e
UNION ALL SELECT 'end', concat(r, n, ' ', v, ' draft', t) FROM (SELECT unnest(['freddy', 'rupert']) AS n) a,
 (SELECT unnest(['', 'hey ', 'wake up ']) AS r) b, (SELECT unnest(['stop', 'close', 'end']) AS v) d, (SELECT unnest(['', ' now']) AS t) e
UNION ALL SELECT 'end', unnest(['break break break', 'great great great', 'stop stop stop']))"""

CANDIDATES_SQL = f"""SELECT event_id, kind, phrase, strpos(clean, phrase) - 1 AS m_start,
strpos(clean, phrase) - 1 + length(phrase) AS m_end, CAST(100.0 AS DOUBLE) AS score
FROM (SELECT event_id, {CLEAN_SQL} AS clean FROM v_texts) t, {PATTERNS_SQL} p WHERE strpos(clean, phrase) > 0"""


def _scored(spark, sf):
    rows = views.texts(spark, sf).select("event_id", "text")
    return M.scored_candidates(rows).drop("text")


def _candidates(spark, sf):
    """Phrases that stand in a text word for word."""
    rows = views.texts(spark, sf).select("event_id", "text")
    return M.exact_candidates(rows, patterns_frame(spark)).select("event_id", "kind", "phrase", "m_start", "m_end", "score")


@query("j9_pattern_candidates", CANDIDATES_SQL)
def j9(spark, sf):
    return _scored(spark, sf)


@query(
    "x4_default_patterns",
    f"""SELECT p.kind, p.phrase, count(t.event_id) AS n_texts FROM {PATTERNS_SQL} p LEFT JOIN
        (SELECT event_id, {CLEAN_SQL} AS clean FROM v_texts) t ON strpos(t.clean, p.phrase) > 0 GROUP BY 1, 2""",
)
def x4(spark, sf):
    """Every default phrase and the number of texts that hold it word for word."""
    used = _candidates(spark, sf).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    every = patterns_frame(spark).select("kind", F.trim("phrase").alias("phrase"))
    return every.join(used, "phrase", "left").select("kind", "phrase", F.coalesce("n", F.lit(0)).alias("n_texts"))


@query(
    "a8_best_match_per_pattern",
    f"""SELECT event_id, phrase, kind, m_start, m_end, score FROM (SELECT c.*, row_number() OVER (PARTITION BY event_id, phrase
        ORDER BY score DESC, m_start, m_end DESC) AS rn FROM ({CANDIDATES_SQL}) c) x WHERE rn = 1""",
)
def a8(spark, sf):
    return M.best_match_per_pattern(_scored(spark, sf), "event_id")


@query(
    "a9_best_match_overall",
    f"""SELECT event_id, phrase, kind, m_start, m_end, score FROM (SELECT c.*, row_number() OVER (PARTITION BY c.event_id
        ORDER BY c.m_end DESC, c.score DESC, c.kind, c.phrase) AS rn FROM ({CANDIDATES_SQL}) c JOIN (SELECT event_id, m_start, score FROM
        (SELECT c.*, row_number() OVER (PARTITION BY event_id ORDER BY m_end, score DESC, m_start, kind, phrase) AS rn FROM ({CANDIDATES_SQL}) c) y
        WHERE rn = 1) l ON c.event_id = l.event_id AND c.m_start = l.m_start AND c.score >= l.score) x WHERE rn = 1""",
)
def a9(spark, sf):
    return M.best_match_overall(M.best_match_per_pattern(_scored(spark, sf), "event_id"), "event_id")


# In the fixture every text holds at most one injected phrase, word for word.
@query(
    "f8_match_first",
    """SELECT event_id, marker AS kind, strpos(lower(text), CASE marker WHEN 'start' THEN 'freddy take this down' ELSE 'freddy break break'
       END) - 1 AS m_start, CASE marker WHEN 'start' THEN 21 ELSE strpos(lower(text), 'freddy break break') + 17 END AS m_end,
       CAST(100.0 AS DOUBLE) AS score FROM v_texts WHERE marker IS NOT NULL""",
)
def f8(spark, sf):
    rows = views.texts(spark, sf).select("event_id", "text")
    return M.match_first(rows).drop("text")


@query(
    "x6_all_matches",
    """SELECT event_id, 0 AS match_no, marker AS kind, CASE marker WHEN 'start' THEN 0 ELSE length(text) - 19 END AS m_start,
       CASE marker WHEN 'start' THEN 22 ELSE length(text) END AS m_end FROM v_texts WHERE marker IS NOT NULL""",
)
def x6(spark, sf):
    rows = views.texts(spark, sf).select("event_id", "text")
    return M.all_matches(rows).drop("text", "score")


@query(
    "x6_lateral_matches",
    """SELECT event_id, 0 AS match_no, marker AS kind, CASE marker WHEN 'start' THEN 0 ELSE length(text) - 19 END AS m_start,
       CASE marker WHEN 'start' THEN 22 ELSE length(text) END AS m_end FROM v_texts WHERE marker IS NOT NULL""",
)
def x6_lateral(spark, sf):
    """The matcher as a table function in SQL, with the phrases of a table."""
    patterns_frame(spark).createOrReplaceTempView("dictalog_phrases")
    register_phrase_table(spark, "dictalog_phrases")
    rows = M.dealt(views.texts(spark, sf).select("event_id", "text"))
    return spark.sql("SELECT event_id, m.match_no, m.kind, m.m_start, m.m_end FROM {texts} t, LATERAL all_matches(t.text) m", texts=rows)


# Texts that begin with a misheard phrase: letters of it are left out, so its score is 200 n / (21 + n) for the n that are there. Every second text ends with the
# phrase word for word, which then is the phrase's best place.
MISHEARD = {0: "freddy take this down", 1: "fredy take this down", 2: "fredy take ths down", 3: "fredy tke ths dwn", 4: "fredy tke ths dn", 5: "fredy tk ths dn"}
MISHEARD_SQL = f"""SELECT concat('m-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS event_id, said, turn % 2 = 1 AS again,
 concat(said, '. ', text, CASE WHEN turn % 2 = 1 THEN ' Freddy, take this down!' ELSE '' END) AS text
 FROM (SELECT *, CASE conv_id % 6 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in MISHEARD.items())} END AS said FROM {{conversations}}) c"""
MISHEARD_BEST_SQL = f"""SELECT event_id, CASE WHEN again THEN 100.0e0 ELSE round(200.0e0 * length(said) / (21 + length(said)), 6) END AS score,
 CASE WHEN again AND said <> 'freddy take this down' THEN length(text) - 23 ELSE 0 END AS m_start, CASE WHEN again AND said <> 'freddy take this down' THEN length(text) - 1
 ELSE length(said) END AS m_end, said, again, text FROM ({MISHEARD_SQL.format(conversations='conversations')}) m WHERE again OR length(said) > 15"""


def misheard(spark, sf):
    return spark.sql(MISHEARD_SQL, conversations=views.table(spark, sf, "conversations")).select("event_id", "text")


@query(
    "a8_misheard_phrases",
    f"""SELECT event_id, 'freddy take this down' AS phrase, 'start' AS kind, score, CASE WHEN m_start = 0 THEN 0 ELSE length({CLEAN_SQL}) - 21 END AS m_start,
        CASE WHEN m_start = 0 THEN m_end ELSE length({CLEAN_SQL}) END AS m_end FROM ({MISHEARD_BEST_SQL}) b""",
)
def a8_misheard(spark, sf):
    """Phrases with letters left out, ranked by score: the best place of each phrase in the cleaned text."""
    best = M.best_match_per_pattern(M.scored_candidates(misheard(spark, sf)), "event_id")
    return best.withColumn("score", F.round("score", 6))


@query(
    "a9_misheard_best",
    f"""SELECT event_id, 'freddy take this down' AS phrase, 'start' AS kind, score, CASE WHEN m_start = 0 THEN 0 ELSE length({CLEAN_SQL}) - 21 END AS m_start,
        CASE WHEN m_start = 0 THEN m_end ELSE length({CLEAN_SQL}) END AS m_end FROM ({MISHEARD_BEST_SQL}) b""",
)
def a9_misheard(spark, sf):
    best = M.best_match_overall(M.best_match_per_pattern(M.scored_candidates(misheard(spark, sf)), "event_id"), "event_id")
    return best.withColumn("score", F.round("score", 6))


@query("f8_misheard_first", f"SELECT event_id, 'start' AS kind, m_start, m_end, score FROM ({MISHEARD_BEST_SQL}) b")
def f8_misheard(spark, sf):
    found = M.match_first(misheard(spark, sf)).drop("text")
    return found.withColumn("score", F.round("score", 6))


@query(
    "f4_clean_text",
    f"SELECT event_id, {CLEAN_SQL} AS cleaned, length({CLEAN_SQL}) AS n_kept FROM v_texts",
)
def f4(spark, sf):
    rows = views.texts(spark, sf)
    kept = F.size(X.clean_map(F.col("text"))).cast("long")
    return rows.select("event_id", X.clean_text(F.col("text")).alias("cleaned"), kept.alias("n_kept"))


@query(
    "f5_indel_ratio",
    """SELECT event_id, round(CASE WHEN n = 0 THEN 100 ELSE 200.0e0 * m / (n + m) END, 6) AS ratio FROM (SELECT event_id, length(text) AS n,
       length(replace(replace(text, ' ', ''), 'e', '')) AS m FROM v_texts) t""",
)
def f5(spark, sf):
    """Each text against itself without blanks and the letter e: what is left is the longest common subsequence."""
    rows = M.dealt(views.texts(spark, sf).select("event_id", "text"))
    score = M.indel_ratio(F.col("text"), F.translate("text", " e", ""))
    return rows.select("event_id", F.round(score, 6).alias("ratio"))


@query(
    "f6_partial_align",
    """SELECT event_id, CAST(100.0 AS DOUBLE) AS score, strpos(lower(text), 'freddy break break') - 1 AS m_start,
       strpos(lower(text), 'freddy break break') + 17 AS m_end FROM v_texts WHERE marker = 'end'""",
)
def f6(spark, sf):
    rows = M.dealt(views.texts(spark, sf).select("event_id", "text"))
    hit = M.partial_align(F.lit("freddy break break"), F.col("text"))
    found = rows.withColumn("m", hit).filter(F.col("m.score").isNotNull())
    return found.select(
        "event_id", "m.score", F.col("m.start").cast("long").alias("m_start"), F.col("m.end").cast("long").alias("m_end")
    )


WORDS_SQL = f"list_filter(regexp_split_to_array({CLEAN_SQL}, '{SPACE}+'), lambda w: w <> '')"


@query(
    "f7_has_required_words",
    f"""SELECT event_id, len(list_filter(words, lambda w: w = 'freddy' OR (abs(length(w) - 6) = 1 AND levenshtein(w, 'freddy') = 1
        AND length(w) + 6 >= 11))) > 0 AND len(list_filter(words, lambda w: w = 'break' OR (abs(length(w) - 5) = 1 AND
        levenshtein(w, 'break') = 1 AND length(w) + 5 >= 11))) > 0 AS ok FROM (SELECT event_id, {WORDS_SQL} AS words FROM v_texts) t""",
)
def f7(spark, sf):
    required = F.array(F.lit("freddy"), F.lit("break"))
    rows = views.texts(spark, sf)
    return rows.select("event_id", X.has_required_words(X.tokens(F.col("text")), required).alias("ok"))


@query(
    "f9_snap_range",
    f"""SELECT event_id, pos AS m_start, pos + 18 + length(regexp_extract(substring(text, CAST(pos + 19 AS BIGINT)), '^[^ \\t\\n\\x0b\\f\\r]*')) AS snapped_end
        FROM (SELECT event_id, text, strpos(lower(text), 'freddy break break') - 1 AS pos FROM v_texts) t WHERE pos >= 0""",
)
def f9(spark, sf):
    rows = views.texts(spark, sf).withColumn("m_start", F.locate("freddy break break", F.lower("text")).cast("long") - 1)
    found = rows.filter(F.col("m_start") >= 0)
    end = X.snap_end(F.col("text"), F.col("m_start").cast("int"), (F.col("m_start") + 18).cast("int"))
    return found.select("event_id", "m_start", end.cast("long").alias("snapped_end"))


@query("f10_collapse_ws", f"SELECT event_id, trim(regexp_replace(text, '{SPACE}+', ' ', 'g')) AS collapsed FROM v_texts")
def f10(spark, sf):
    return views.texts(spark, sf).select("event_id", X.collapse_ws(F.col("text")).alias("collapsed"))


COMMANDS = ["freddy", "break", "down"]


@query(
    "f23_boundary_artifact_flag",
    f"""SELECT event_id, len(list_intersect(list_concat(list_slice(words, 1, 10), list_slice(words, greatest(len(words) - 9, 1), len(words))),
        ['freddy', 'break', 'down'])) > 0 AS artifact FROM (SELECT event_id, {WORDS_SQL} AS words FROM v_texts) t""",
)
def f23(spark, sf):
    return views.texts(spark, sf).select("event_id", X.boundary_words_at_edges(F.col("text"), COMMANDS).alias("artifact"))


SEAM_SQL = f"""(SELECT *, CASE WHEN prev IS NULL OR regexp_matches(prev, '{SPACE}$') OR regexp_matches(text, '^{SPACE}') THEN 0 ELSE 1 END AS seam
FROM (SELECT *, lag(text) OVER (PARTITION BY source_id ORDER BY seq) AS prev FROM v_texts) a)"""

OFFSETS_SQL = f"""SELECT *, CAST(end_pos - length(text) AS BIGINT) AS start_pos FROM (SELECT *, CAST(sum(length(text) + seam) OVER
(PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_pos FROM {SEAM_SQL} s) o"""


@query("w7_text_offset_map", f"SELECT event_id, source_id, seam, start_pos, end_pos FROM ({OFFSETS_SQL}) x")
def w7(spark, sf):
    rows = views.texts(spark, sf).select("event_id", "source_id", "seq", "text")
    got = M.text_offset_map(rows, views.text_slices(rows))
    return got.select("event_id", "source_id", "seam", "start_pos", "end_pos")


@query(
    "j5_text_events_of_match",
    f"""WITH o AS ({OFFSETS_SQL}), m AS (SELECT event_id AS match_id, source_id, start_pos + strpos(text, CASE marker WHEN 'start' THEN
        'Freddy take this down' ELSE 'Freddy break break' END) - 1 AS m_start, CASE marker WHEN 'start' THEN 21 ELSE 18 END AS len FROM o
        WHERE marker IS NOT NULL)
        SELECT m.match_id, count(*) AS n_texts, min(e.audio_start_time) AS audio_start_time, max(e.audio_end_time) AS audio_end_time
        FROM m JOIN o e ON e.source_id = m.source_id AND e.end_pos >= m.m_start AND e.start_pos < m.m_start + m.len GROUP BY 1""",
)
def j5(spark, sf):
    rows = views.texts(spark, sf)
    placed = M.text_offset_map(rows, views.text_slices(rows))
    phrase = F.when(F.col("marker") == "start", "Freddy take this down").otherwise("Freddy break break")
    spans = placed.filter(F.col("marker").isNotNull()).withColumn("_p", phrase)
    spans = spans.select(
        F.col("event_id").alias("match_id"),
        "source_id",
        (F.col("start_pos") + F.expr("locate(_p, text)") - 1).alias("m_start"),
        F.length("_p").alias("_len"),
    ).withColumn("m_end", F.col("m_start") + F.col("_len"))
    items = placed.select("source_id", "start_pos", "end_pos", "audio_start_time", "audio_end_time")
    pairs = overlap_join(items, spans.drop("_len"), "source_id", ("start_pos", "end_pos"), ("m_start", "m_end"), 4096)
    return pairs.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.min_by("audio_start_time", "start_pos").alias("audio_start_time"),
        F.max_by("audio_end_time", "start_pos").alias("audio_end_time"),
    )


@query(
    "a2_assemble_text",
    f"""SELECT source_id, job_no, trim(regexp_replace(string_agg(text, ' ' ORDER BY seq), '{SPACE}+', ' ', 'g')) AS text
        FROM (SELECT *, seq // 2 AS job_no FROM v_texts) x GROUP BY 1, 2""",
)
def a2(spark, sf):
    """Jobs of two texts each."""
    rows = views.texts(spark, sf).withColumn("job_no", F.expr("seq div 2"))
    return M.assemble_text(rows, ["source_id", "job_no"])


@query(
    "a3_concat_search_text",
    f"""SELECT source_id, job_no, CASE WHEN max(n) = 1 THEN max(text) FILTER (k = 0) ELSE concat(max(text) FILTER (k = 0),
        CASE WHEN regexp_matches(max(text) FILTER (k = 0), '{SPACE}$') OR regexp_matches(max(text) FILTER (k = 1), '^{SPACE}') THEN '' ELSE ' ' END,
        max(text) FILTER (k = 1)) END AS search_text
        FROM (SELECT *, seq // 2 AS job_no, seq % 2 AS k, count(*) OVER (PARTITION BY source_id, seq // 2) AS n FROM v_texts) x GROUP BY 1, 2""",
)
def a3(spark, sf):
    rows = views.texts(spark, sf).withColumn("job_no", F.expr("seq div 2"))
    return M.concat_search_text(rows, ["source_id", "job_no"])


@query("p10_drop_blank_audio", "SELECT event_id, text FROM v_texts WHERE marker IS NOT NULL")
def p10(spark, sf):
    """Texts without a marker stand for jobs that heard nothing."""
    heard = F.when(F.col("marker").isNull(), F.array(F.lit("[BLANK_AUDIO]"))).otherwise(F.array("text"))
    jobs = views.texts(spark, sf).select("event_id", "text", heard.alias("segments"))
    return M.drop_blank_audio(jobs).drop("segments")


@query(
    "p11_classify_draft_event",
    """SELECT event_id, CASE marker WHEN 'end' THEN 'DraftEndEvent' ELSE 'DraftStartEvent' END AS event_class FROM v_texts
       WHERE marker IS NOT NULL""",
)
def p11(spark, sf):
    rows = views.texts(spark, sf).filter(F.col("marker").isNotNull())
    ended = rows.withColumn("end_text", F.when(F.col("marker") == "end", F.lit("Freddy break break.")))
    return M.classify_draft_event(ended).select("event_id", "event_class")


SPANS_SQL = """SELECT source_id, seq, event_id, end_seq, end_marker, end_marker IS NULL AS forced FROM (SELECT *,
lead(seq) OVER (PARTITION BY source_id ORDER BY seq) AS end_seq, lead(marker) OVER (PARTITION BY source_id ORDER BY seq) AS end_marker
FROM v_texts WHERE marker IS NOT NULL) m WHERE marker = 'start'"""


@query("w8_draft_spans", SPANS_SQL)
def w8(spark, sf):
    rows = views.texts(spark, sf).select("source_id", "seq", "event_id", "marker")
    got = M.draft_spans(rows, views.text_slices(rows), ["seq"])
    return got.select("source_id", "seq", "event_id", "end_seq", "end_marker", "forced")


# The drafts the injected phrases must give, built from the markers alone.
DRAFTS_SQL = f"""WITH o AS ({OFFSETS_SQL}),
 k AS (SELECT *, lead(start_pos) OVER w AS n_start, lead(marker) OVER w AS n_marker, lead(audio_end_time) OVER w AS n_time,
       lead(length(text)) OVER w AS n_len FROM o WHERE marker IS NOT NULL WINDOW w AS (PARTITION BY source_id ORDER BY seq)),
 z AS (SELECT source_id, max(end_pos) AS z_end, max(audio_end_time) AS z_time FROM o GROUP BY 1),
 d AS (SELECT k.source_id, k.start_pos AS opened_at, k.start_pos + 22 AS body_start, k.audio_start_time,
       CASE n_marker WHEN 'end' THEN n_start + n_len - 19 WHEN 'start' THEN n_start ELSE z_end END AS body_end,
       coalesce(n_time, z_time) AS audio_end_time, n_marker IS NULL AS forced,
       CASE n_marker WHEN 'end' THEN 'Freddy break break' WHEN 'start' THEN 'Freddy take this down' ELSE 'forced end' END AS end_text
       FROM k JOIN z ON k.source_id = z.source_id WHERE marker = 'start'),
 r AS (SELECT source_id, string_agg(concat(repeat(' ', seam), text), '' ORDER BY seq) AS running FROM o GROUP BY 1)
SELECT d.source_id, opened_at, end_text, trim(substring(running, CAST(body_start + 1 AS BIGINT), CAST(body_end - body_start AS BIGINT)), ' ') AS full_text,
 d.audio_start_time, d.audio_end_time, forced FROM d JOIN r ON d.source_id = r.source_id"""

DRAFT_COLUMNS = ["source_id", "opened_at", "end_text", "full_text", "audio_start_time", "audio_end_time", "forced"]


def built(spark, sf):
    rows = views.texts(spark, sf)
    return S.build_drafts(rows, views.text_slices(rows))


@query("t1_draft_builder_batch", DRAFTS_SQL)
def t1_batch(spark, sf):
    return built(spark, sf).withColumn("full_text", F.trim("full_text")).select(*DRAFT_COLUMNS)


def text_stream(spark, sf):
    """The texts as a stream, each source followed by a row that stops it."""
    rows = views.texts(spark, sf).select("source_id", "seq", "text", "audio_start_time", "audio_end_time")
    stops = rows.groupBy("source_id").agg(
        (F.max("seq") + 1).alias("seq"),
        F.lit(None).cast("string").alias("text"),
        F.max("audio_end_time").alias("audio_start_time"),
        F.max("audio_end_time").alias("audio_end_time"),
    )
    return stream_of(rows.unionByName(stops), "texts")


@query("t1_draft_builder_stream", DRAFTS_SQL)
def t1_stream(spark, sf):
    events = run_available(stream_drafts(text_stream(spark, sf)), "drafts")
    return events.filter(F.col("kind") == "end").withColumn("full_text", F.trim("full_text")).select(*DRAFT_COLUMNS)


@query("t1_long_draft_parts", DRAFTS_SQL)
def t1_parts(spark, sf):
    """The drafts of the batch form put together from parts of 40 characters."""
    rows = views.texts(spark, sf)
    parts = S.build_drafts(rows, views.text_slices(rows), part_chars=40)
    return sinks.whole_drafts(parts, ["draft_id"]).withColumn("full_text", F.trim("full_text")).select(*DRAFT_COLUMNS)


def _tied(spark, sf, seq):
    """Drafts of the texts with another sequence number, under which several tie."""
    rows = views.texts(spark, sf).withColumn("seq", seq)
    return S.build_drafts(rows, views.text_slices(rows)).withColumn("full_text", F.trim("full_text")).select(*DRAFT_COLUMNS)


@query("t1_tied_order", DRAFTS_SQL)
def t1_tied(spark, sf):
    """Texts tie in pairs: they stand in order of time, so the drafts are those of the untied texts."""
    return _tied(spark, sf, F.floor(F.col("seq") / 2).cast("long"))


@query("t1_tied_whole", DRAFTS_SQL)
def t1_tied_whole(spark, sf):
    """All texts of a source tie."""
    return _tied(spark, sf, F.lit(0).cast("long"))


@query("t3_forced_end", f"SELECT source_id, opened_at, audio_end_time FROM ({DRAFTS_SQL}) x WHERE forced")
def t3(spark, sf):
    events = run_available(stream_drafts(text_stream(spark, sf)), "forced")
    return events.filter((F.col("kind") == "end") & F.col("forced")).select("source_id", "opened_at", "audio_end_time")


@query(
    "t2_orphan_expiry",
    f"""SELECT source_id, seq, marker, start_pos + CASE marker WHEN 'start' THEN 0 ELSE length(text) - 19 END AS m_start,
        start_pos + CASE marker WHEN 'start' THEN 22 ELSE length(text) END AS m_end FROM ({OFFSETS_SQL}) o WHERE marker IS NOT NULL""",
)
def t2(spark, sf):
    """Boundaries that still match when texts older than five seconds are not carried into the next one."""
    rows = views.texts(spark, sf)
    placed = M.text_offset_map(rows, views.text_slices(rows))
    found = S.find_boundaries(placed, views.text_slices(rows), "seq", default_patterns(), expiry_s=5.0)
    return found.select("source_id", "seq", "marker", "m_start", "m_end")


# A phrase split over two texts, the second coming 5, 19, 21 or 40 seconds after the first; one in three is misspelt.
SPLIT_SQL = """
SELECT concat('conv-', CAST(conv_id AS STRING)) AS source_id, CAST(part AS BIGINT) AS seq,
       CASE part WHEN 0 THEN CASE conv_id % 3 WHEN 0 THEN 'note Fredy take' ELSE 'note Freddy take' END ELSE 'this down please' END AS text,
       CAST(part * 1000 AS DOUBLE) AS audio_start_time,
       CAST(10 + part * CASE conv_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 19 WHEN 2 THEN 21 ELSE 40 END AS DOUBLE) AS audio_end_time, conv_id
FROM (SELECT DISTINCT conv_id FROM {conversations}) c, {parts}
"""


@query(
    "t2_split_phrases",
    f"""SELECT source_id, 'start' AS marker, 5 AS m_start, length(text) + 10 AS m_end, round(CASE conv_id % 3 WHEN 0 THEN 200.0e0 * 20 / 41 ELSE 100.0e0 END, 6) AS score
        FROM ({SPLIT_SQL.format(conversations="conversations", parts="(SELECT 0 AS part) p")}) x WHERE conv_id % 4 < 2""",
)
def t2_split(spark, sf):
    """Found with its score if the first half is not older than twenty seconds, else not at all."""
    rows = spark.sql(SPLIT_SQL.format(conversations="{conversations}", parts="(VALUES (0), (1)) AS p(part)"), conversations=views.table(spark, sf, "conversations"))
    placed = M.text_offset_map(rows.drop("conv_id"), views.text_slices(rows))
    found = S.find_boundaries(placed, views.text_slices(rows), "seq", default_patterns())
    return found.select("source_id", "marker", F.col("m_start").cast("int").alias("m_start"), F.col("m_end").cast("int").alias("m_end"), F.round("score", 6).alias("score"))


@query("t12_late_text", "SELECT source_id, text AS full_text FROM v_texts")
def t12(spark, sf):
    """Every text comes a second time in a later batch: all of those are late and change no draft."""
    rows = views.texts(spark, sf).select("source_id", "seq", "text", "audio_start_time", "audio_end_time")
    path = shared_dir(spark, "late")
    shape = "source_id STRING, seq BIGINT, text STRING, audio_start_time DOUBLE, audio_end_time DOUBLE"
    rows.write.mode("append").parquet(path)
    first = len(spark.read.schema(shape).parquet(path).inputFiles())  # older than those that follow, so they are the first batch
    rows.write.mode("append").parquet(path)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", first).parquet(path)
    return run_available(stream_drafts(stream), "late").filter(F.col("kind") == "late").select("source_id", "full_text")


@query("s10_persist_ended_drafts", f"SELECT source_id, opened_at, full_text, forced FROM ({DRAFTS_SQL}) x")
def s10(spark, sf):
    """The segmenter's end events stored through the validated append, micro-batch by micro-batch."""
    return persisted(spark, stream_drafts(text_stream(spark, sf)))


@query("s10_long_draft", f"SELECT source_id, opened_at, full_text, forced FROM ({DRAFTS_SQL}) x")
def s10_long(spark, sf):
    """Drafts that come in parts of little more than 40 characters, stored part by part and read whole."""
    return persisted(spark, stream_drafts(text_stream(spark, sf), part_chars=40))


def persisted(spark, events):
    """Draft events through the validated append, micro-batch by micro-batch, and the stored drafts read whole."""
    path = shared_dir(spark, "ended")

    def body(batch, number):
        shaped = batch.withColumn("timestamp", F.col("audio_start_time")).withColumn("parent_draft_id", F.lit(None).cast("string"))
        tagged = shaped.withColumn("directory_path", F.concat_ws("|", "source_id", "opened_at", "forced"))
        sinks.persist_ended_drafts(tagged, path, ["timestamp"])

    run_each_batch(events, "ended", body)
    parts = F.split("directory_path", r"\|")
    return sinks.whole_drafts(sinks.read_drafts(spark, path)).select(
        parts[0].alias("source_id"),
        parts[1].cast("long").alias("opened_at"),
        F.trim("full_text").alias("full_text"),
        (parts[2] == "true").alias("forced"),
    )


COMPLETION_SQL = f"""SELECT t.source_id, t.last_speech, t.last_text, t.last_speech - t.last_text AS gap, t.last_speech - t.last_text > 0.5 AS pending,
        NOT (t.last_speech - t.last_text > 0.5) AND NOT coalesce(d.any_forced, false) AS all_done
        FROM (SELECT source_id, max(audio_end_time) + CAST(0.25 AS DOUBLE) AS last_speech, max(audio_end_time) AS last_text FROM v_texts GROUP BY 1) t
        LEFT JOIN (SELECT source_id, max(CAST(forced AS INT)) = 1 AS any_forced FROM ({DRAFTS_SQL}) x GROUP BY 1) d ON d.source_id = t.source_id"""


@query("t10_stream_completion", COMPLETION_SQL)
def t10(spark, sf):
    rows = views.texts(spark, sf)
    return _completion(rows, run_available(stream_drafts(text_stream(spark, sf)), "completion"))


@query("t10_endless_completion", COMPLETION_SQL)
def t10_endless(spark, sf):
    """The report of an endless stream that has noticed by itself that nothing more is open or waiting."""
    rows = views.texts(spark, sf)
    events, done = run_until_done(stream_drafts(text_stream(spark, sf)), "endless", limit_s=600)
    return _completion(rows, events).withColumn("all_done", F.col("all_done") & F.lit(done))


def _completion(rows, events):
    ended = events.filter(F.col("kind") == "end").select("source_id", "forced")
    speech = rows.select("source_id", (F.col("audio_end_time") + 0.25).alias("speech_end"))
    texts = rows.select("source_id", F.col("audio_end_time").alias("text_end"))
    return completion_report(speech, texts, ended)


def flagship(spark, sf):
    """Conversations to drafts, and the first page of the newest ones."""
    drafts = sinks.whole_drafts(built(spark, sf), ["draft_id"]).select(
        "draft_id",
        F.col("audio_start_time").alias("timestamp"),
        "source_id",
        "start_text",
        "end_text",
        "full_text",
        "forced",
        F.lit(None).cast("string").alias("parent_draft_id"),
    )
    return page_drafts(drafts, 100, 0, "desc")
