"""Input views over the given tables. The SQL text runs unchanged in Spark and in the SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictalog.operators.slices import KeySlices, plan_slices, row_numbers
from dictalog.session import ensure_runtime_conf

V_EVENTS = """
SELECT event_id, ts, concat('user-', CAST(user_id AS STRING)) AS source_id,
       CASE event_type WHEN 'signup' THEN 'DraftStartEvent' WHEN 'purchase' THEN 'DraftEndEvent'
                       WHEN 'view' THEN 'TextEvent' WHEN 'click' THEN 'AudioSpeechStartEvent'
                       ELSE 'AudioSpeechStopEvent' END AS event_class,
       value, props
FROM {events}
"""

V_DRAFTS = """
SELECT concat('draft-', CAST(doc_id AS STRING)) AS draft_id,
       CAST(1704067200 + doc_id * 100 AS DOUBLE) AS timestamp,
       text AS full_text, source AS author_uri,
       CASE WHEN doc_id > 0 AND doc_id % 5 = 0
            THEN concat('draft-', CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING)) END AS parent_draft_id
FROM {documents}
"""

V_TEXTS = """
SELECT concat('conv-', CAST(conv_id AS STRING)) AS source_id, turn AS seq,
       concat('t-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS event_id,
       CASE role WHEN 'user' THEN concat('Freddy take this down. ', text)
                 WHEN 'assistant' THEN concat(text, ' Freddy break break.')
                 ELSE text END AS text,
       CASE role WHEN 'user' THEN 'start' WHEN 'assistant' THEN 'end' END AS marker,
       CAST(conv_id * 1000 + turn * 10 AS DOUBLE) AS audio_start_time,
       CAST(conv_id * 1000 + turn * 10 + 8 AS DOUBLE) AS audio_end_time
FROM {conversations}
"""

V_CHUNKS = """
SELECT concat('src-', CAST(label AS STRING)) AS source_id, vec_id AS chunk_id,
       CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) * 32000 AS ts_us,
       embedding AS data, 64 AS n_samples, 2000 AS sample_rate,
       CASE WHEN vec_id % 7 < 4 THEN 0.9e0 ELSE 0.1e0 END AS speech_score
FROM {embeddings}
"""

V_SEGMENTS = """
SELECT conv_id AS spec_id, turn AS seg_no, text,
       CASE WHEN turn = 4 THEN -1 ELSE turn % 3 END AS silence_after,
       length(text) AS duration_units
FROM {conversations}
"""

VIEW_SQL = {
    "v_events": V_EVENTS.format(events="events"),
    "v_drafts": V_DRAFTS.format(documents="documents"),
    "v_texts": V_TEXTS.format(conversations="conversations"),
    "v_chunks": V_CHUNKS.format(embeddings="embeddings"),
    "v_segments": V_SEGMENTS.format(conversations="conversations"),
}


def with_views(sql: str) -> str:
    """Prefix an oracle with the views it names."""
    used = [f"{name} AS ({text.strip()})" for name, text in VIEW_SQL.items() if name in sql]
    sql = sql.strip()
    if sql.startswith("WITH "):
        return f"WITH {', '.join(used)}, {sql[5:]}"
    return f"WITH {', '.join(used)} {sql}" if used else sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_runtime_conf(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log, with the epoch microseconds of ``ts`` as ``us``."""
    df = spark.sql(V_EVENTS, events=table(spark, sf_dir, "events"))
    return df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(V_DRAFTS, documents=table(spark, sf_dir, "documents"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(V_TEXTS, conversations=table(spark, sf_dir, "conversations"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(V_SEGMENTS, conversations=table(spark, sf_dir, "conversations"))


def chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, KeySlices]:
    """Sample chunks and the slices of their sources (in ``chunk_id`` order, which is also time order)."""
    raw = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("src-"), F.col("label").cast("string")).alias("source_id"),
        F.col("vec_id").alias("chunk_id"),
        F.col("embedding").alias("data"),
        F.lit(64).alias("n_samples"),
        F.lit(2000).alias("sample_rate"),
        F.when(F.col("vec_id") % 7 < 4, F.lit(0.9)).otherwise(F.lit(0.1)).alias("speech_score"),
    )
    slices = plan_slices(raw, "source_id", "chunk_id")
    numbered = row_numbers(raw, slices, ["chunk_id"], "_n")
    return numbered.withColumn("ts_us", (F.col("_n") - 1) * 32000).drop("_n"), slices


def event_slices(df: DataFrame) -> KeySlices:
    return plan_slices(df, "source_id", "us")


def text_slices(df: DataFrame) -> KeySlices:
    return plan_slices(df, "source_id", "seq")
