"""Documents through five operators in order: quality, exact copies, near copies, mix of sources, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictalog.llm import exact_dedup, mixing, parity, pieces, subwords
from dictalog.llm.queries import quality_model
from dictalog.llm.rows import unused
from dictalog.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled documents of the training folds."""
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = unused(docs, "score")
    return subwords.score(docs, model, name=name).filter(F.col(name) >= 0.5).drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts."""
    return parity.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mix(docs, mixing.n_words(F.col("text")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of each document's n best segmentations and of the text they give back."""
    name = unused(docs, "digest")
    return pieces.digests(docs, name=name).select("doc_id", "lang", "source", f"{name}.*")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]
#: A trained model and a join on similarity are not for SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
