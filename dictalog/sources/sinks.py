"""Writers for drafts, fan-out and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictalog.operators.drafts import judge_ids
from dictalog.session import materialize

STORED = [
    "draft_id STRING",
    "timestamp DOUBLE",
    "full_text STRING",
    "classname STRING",
    "directory_path STRING",
    "parent_draft_id STRING",
    "created_at TIMESTAMP",
    "part_no BIGINT",
    "complete BOOLEAN",
]


def with_day(drafts: DataFrame) -> DataFrame:
    """Partition column ``dt``: the UTC day of the draft."""
    return drafts.withColumn("dt", F.to_date(F.timestamp_seconds("timestamp")))


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows (none if the table was never written). A very long draft has a row for each part; see ``whole_drafts``."""
    schema = ", ".join([*STORED, "dt DATE"])
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # a missing folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append_drafts(incoming: DataFrame, path: str, order_by: list[str]) -> DataFrame:
    """Append the valid drafts to the table and return the rejected ones with their reason.

    A draft may revise one that comes earlier in the same batch. Running the same batch again appends nothing, so a
    retried micro-batch is harmless.
    """
    spark = incoming.sparkSession
    stored = read_drafts(spark, path).select("draft_id", "part_no")
    numbered, reasons = judge_ids(incoming, stored, order_by)
    judged = materialize(reasons, "judged")
    accepted = _accept_in_order(judged, order_by)
    day = with_day(_stored_shape(numbered.join(accepted, "_row", "left_semi")))
    # rebalanced by day: few files for a quiet day, as many tasks as its bytes need for a busy one
    day.hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(path)
    refused = judged.filter(F.col("reason").isNotNull()).select("_row", "reason").join(accepted, "_row", "left_anti")
    return numbered.join(refused, "_row").select(*incoming.columns, "reason")


def _accept_in_order(judged: DataFrame, order_by: list[str]) -> DataFrame:
    """Numbers of the accepted rows: the valid ones, and the unknown parents' children that turn out valid. One round per generation of
    revisions within the batch, each over the newly accepted ids only."""
    pos = F.struct(*order_by)
    newest = judged.filter(F.col("reason").isNull())
    waiting = judged.filter(F.col("reason") == "unknown_parent")
    accepted = newest.select("_row")
    while not waiting.isEmpty():
        parents = newest.select(F.col("draft_id").alias("parent_draft_id"), pos.alias("_at"))
        parents = parents.groupBy("parent_draft_id").agg(F.min("_at").alias("_at"))  # a parent in parts has several rows
        joined = waiting.join(parents, "parent_draft_id").filter(F.col("_at") < pos).select(*waiting.columns)
        newest = materialize(joined, "revisions")
        if newest.isEmpty():
            break
        accepted = accepted.unionByName(newest.select("_row"))
        waiting = waiting.join(newest.select("_row"), "_row", "left_anti")
    return accepted


def _stored_shape(drafts: DataFrame) -> DataFrame:
    fill = {
        "classname": F.lit("Draft"),
        "directory_path": F.lit(""),
        "parent_draft_id": F.lit(None).cast("string"),
        "created_at": F.current_timestamp(),
        "part_no": F.lit(0).cast("long"),
        "complete": F.lit(True),
    }
    cols = [c.split(" ")[0] for c in STORED]
    return drafts.select(*[F.col(c) if c in drafts.columns else fill[c].alias(c) for c in cols])


def persist_ended_drafts(draft_events: DataFrame, path: str, order_by: list[str]) -> DataFrame:
    """Store drafts that ended, revisions, and parts of long drafts. Use as ``foreachBatch`` body; returns the rejected rows.

    A part is stored as it comes; ``whole_drafts`` gives the draft when its last row is there.
    """
    kept = draft_events.filter(F.col("kind").isin("end", "rescan", "part"))
    return append_drafts(kept.withColumn("complete", F.col("kind") != "part"), path, order_by)


def whole_drafts(stored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per finished draft: the text of its parts in order, all else from its last row.

    Drafts of one row, which are nearly all, go through as they are; ``by`` tells drafts apart.
    """
    by = by or ["draft_id"]
    done = F.coalesce("complete", F.lit(True)) if "complete" in stored.columns else F.lit(True)
    part = F.coalesce("part_no", F.lit(0))
    single = stored.filter(done & (part == 0))
    rest = [c for c in stored.columns if c not in (*by, "full_text", "part_no", "complete")]
    long = stored.filter(~done | (part > 0)).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(part.alias("part_no"), "full_text"))).alias("_parts"),
        F.max(F.struct(part.alias("part_no"), done.alias("done"), *rest)).alias("_last"),
    )
    # a draft whose parts are all marked complete has its first row among the single ones
    if "complete" not in stored.columns:
        more = single.select(*by, F.col("full_text").alias("_head"))
        long = long.join(more, by).withColumn("_parts", F.concat(F.array(F.struct(F.lit(0).cast("long").alias("part_no"), F.col("_head").alias("full_text"))), "_parts")).drop("_head")
        single = single.join(long.select(*by), by, "left_anti")
    text = F.array_join(F.transform("_parts", lambda x: x["full_text"]), "")
    joined = long.filter("_last.done").select(*by, text.alias("full_text"), *[F.col(f"_last.{c}").alias(c) for c in rest])
    return single.select(*by, "full_text", *rest).unionByName(joined)


def export_lines(drafts: DataFrame) -> DataFrame:
    """Per draft one text and one JSON line (class name and properties)."""
    body = F.to_json(
        F.struct(F.lit("Draft").alias("classname"), F.struct(*drafts.columns).alias("properties")),
        {"ignoreNullFields": "false"},
    )
    return drafts.select("draft_id", "timestamp", F.col("full_text").alias("text_line"), body.alias("json_line"))


def export_draft_text(drafts: DataFrame, path: str) -> None:
    """Many drafts per file, by day: ``<path>/text`` and ``<path>/json``, both JSON lines keyed by draft id."""
    lines = with_day(export_lines(drafts))
    lines.select("dt", "draft_id", "text_line").write.mode("append").partitionBy("dt").json(f"{path}/text")
    lines.select("dt", F.col("json_line").alias("value")).write.mode("append").partitionBy("dt").text(f"{path}/json")


def write_fan_out(matched: DataFrame, path: str) -> None:
    """Events per subscriber. ``matched`` comes from ``match_subscribers``."""
    matched.write.mode("append").partitionBy("subscriber").parquet(path)
