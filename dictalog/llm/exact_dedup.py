"""Operator 6: exact duplicates by a 128-bit content hash, with the bytes compared inside each group.

Texts are grouped by hash and bytes together, so copies fold before the shuffle and a hash shared by different texts shows
as two groups. Everything after that is narrow: ids, lengths and hashes. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictalog.llm.rows import numbered, without
from dictalog.session import materialize

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=content_hash, rid: str | None = None) -> DataFrame:
    """One row per row of ``docs``: rid, its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are without white space. The row with the most code points in its original text stays, then
    the smallest id (null last), then the first row; of rows repeated in all columns one stays. ``digest`` makes the hash (tests pass one that
    collides). rid is the column of that name (see ``rows.numbered``), or a new number.
    """
    docs, rid = numbered(docs, rid)
    base = docs.select(
        F.col(rid).alias("rid"),
        F.col(f"`{doc_id}`").alias("id"),
        F.char_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long").alias("points"),
        normalised(F.col(f"`{text}`")).alias("norm"),
    )
    rows = materialize(base.select("rid", "id", "points", digest(F.col("norm")).alias("hash")), "hashes")
    texts = base.select(digest(F.col("norm")).alias("hash"), "norm").groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("n"))
    classes = materialize(texts.select("hash", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.lit(None).cast("string").alias("norm")), "classes")
    shared = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("hash")
    if shared.limit(1).count():  # different texts under one hash: for these the text itself is the key
        clash = base.withColumn("hash", digest(F.col("norm"))).join(shared, "hash").select("rid", "norm")
        rows = rows.join(materialize(clash, "clashes"), "rid", "left")
        own = base.select(digest(F.col("norm")).alias("hash"), "norm").join(shared, "hash").distinct()
        split = own.select("hash", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "norm")
        classes = materialize(classes.join(shared, "hash", "left_anti").unionByName(split), "classes")
    else:
        rows = rows.withColumn("norm", F.lit(None).cast("string"))
    order = F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), "id", "rid")
    groups = rows.groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first"))
    null_safe = lambda a, b: (a["hash"] == b["hash"]) & a["norm"].eqNullSafe(b["norm"])
    groups = groups.join(classes, null_safe(groups, classes)).select(groups["hash"], groups["norm"], "group_size", "first", "sha")
    return rows.join(groups, null_safe(rows, groups)).select(
        "rid",
        "id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts."""
    rows, rid = numbered(docs)
    return without(rows, rid, exact_groups(rows, doc_id, text, rid=rid).filter(~F.col("kept")))
