"""Running a stream over what is there now, and the completion check."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from dictalog.operators.events import untranscribed_tail
from dictalog.session import ensure_runtime_conf, shared_dir


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available, write it to the shared folder, and return the written rows."""
    spark = stream.sparkSession
    ensure_runtime_conf(spark)
    out, ckpt = shared_dir(spark, f"{name}-out"), shared_dir(spark, f"{name}-ckpt")
    if mode == "append":
        query = (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", ckpt)
            .trigger(availableNow=True)
            .start()
        )
    else:  # latest state per batch: a full rewrite per batch id, of which the last one counts
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", ckpt)
            .foreachBatch(lambda df, no: df.write.mode("overwrite").parquet(f"{out}/batch_no={no:09d}"))
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return spark.read.schema(_written(stream, mode)).parquet(out)


def _written(stream: DataFrame, mode: str):
    from pyspark.sql import types as T

    extra = [] if mode == "append" else [T.StructField("batch_no", T.IntegerType())]
    return T.StructType(stream.schema.fields + extra)


def run_each_batch(stream: DataFrame, name: str, body: Callable[[DataFrame, int], None]) -> None:
    """Process everything available with a function per micro-batch."""
    ensure_runtime_conf(stream.sparkSession)
    ckpt = shared_dir(stream.sparkSession, f"{name}-ckpt")
    stream.writeStream.foreachBatch(body).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()


def stream_of(df: DataFrame, name: str, max_files: int = 10_000) -> DataFrame:
    """A table as a stream: written once to the shared folder and read back as a file stream."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max_files).parquet(path)


class _Watch(StreamingQueryListener):
    """Counts the drafts that a query opened and closed, and notes when it has nothing more to read."""

    def __init__(self, name: str):
        self.name, self.run, self.open = name, None, 0
        self.seen = False
        self.done = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.runId != self.run:
            return
        counts = p.observedMetrics.get("drafts")
        if counts is not None:
            self.open += (counts["opened"] or 0) - (counts["closed"] or 0)
        self.seen = self.seen or p.numInputRows > 0
        if not p.numInputRows:
            self._still()

    def onQueryIdle(self, event) -> None:
        if event.runId == self.run:
            self._still()

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.done.set()

    def _still(self) -> None:
        if self.seen and self.open <= 0:
            self.done.set()


def run_until_done(events: DataFrame, name: str, every: str = "1 second", limit_s: float = 60.0) -> tuple[DataFrame, bool]:
    """Runs an endless query of draft events (kind start, end, ...) and stops it once no input waits and no draft is open; ``limit_s`` bounds how long to
    wait. Returns the written rows and whether everything was done.

    Starts and ends are counted within the query (``observe``); a listener adds them up batch by batch.
    """
    spark = events.sparkSession
    ensure_runtime_conf(spark)
    full = f"{name}-{uuid.uuid4().hex}"
    watch = _Watch(full)
    kind = F.col("kind")
    counted = events.observe("drafts", F.sum((kind == "start").cast("long")).alias("opened"), F.sum((kind == "end").cast("long")).alias("closed"))
    out = shared_dir(spark, f"{name}-out")
    spark.streams.addListener(watch)
    try:
        query = (
            counted.writeStream.queryName(full)
            .format("parquet")
            .option("path", out)
            .option("checkpointLocation", shared_dir(spark, f"{name}-ckpt"))
            .trigger(processingTime=every)
            .start()
        )
        finished = watch.done.wait(limit_s)
        failed = query.exception()
        query.stop()
        if failed:
            raise failed
    finally:
        spark.streams.removeListener(watch)
    return spark.read.schema(events.schema).parquet(out), finished


def completion_report(speech: DataFrame, texts: DataFrame, drafts: DataFrame) -> DataFrame:
    """Per source: is everything done? No audio waits for text, and no draft was left open."""
    tail = untranscribed_tail(speech, texts)
    open_ = drafts.groupBy("source_id").agg(F.max(F.col("forced").cast("int")).alias("_open"))
    done = ~F.col("pending") & (F.coalesce("_open", F.lit(0)) == 0)
    return tail.join(open_, "source_id", "left").withColumn("all_done", done).drop("_open")


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
