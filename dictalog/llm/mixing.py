"""Operator 9: sources mixed to target weights by systematic sampling.

Within a source every document is expected e = target / size of the source times. The expected copies are summed up in a
fixed order of the documents, one random offset is added, and a document is taken once for each whole number its stretch passes.
Documents stand in order of size classes, so that the words taken come near the target too. Places in the order are counted
per cell (source, size class, hash digit) and then within the cell, so a large source is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dictalog.llm.rows import fields_of, numbered, struct_of
from dictalog.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often.
MOST = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size, target): the total shared by weight, no source above ``most`` times its size.

    ``sizes`` has source and size. Sources by code point, null last, weigh ``weights``, repeating. The excess of a source goes to the others by
    weight: sources fill up in order of size by weight until the level of the rest is below theirs.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_source = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = lambda c: F.coalesce(F.sum(c).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - most * earlier("source_size")
    level = left / (F.sum("weight").over(everything) - earlier("weight"))
    filled = by_source.withColumn("level", level).withColumn("full", most * F.col("source_size") < F.col("level") * F.col("weight"))
    # the level of the first source that isn't full holds for all after it; it is the highest of theirs
    share = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(share * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, size: Column, seed: str = "mix", source: str = "source", doc_id: str = "doc_id", most: int = MOST, rid: str | None = None) -> DataFrame:
    """(rid, id, source, size, source_size, target, copies) for every row of ``docs``.

    A null size counts as 0. A document of size 0 may be taken but adds no words. Repeated rows and ids are documents of their own. rid is the column
    of that name (see ``rows.numbered``), or a new number.
    """
    docs, rid = numbered(docs, rid)
    rows = docs.select(F.col(rid).alias("rid"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    rows = materialize(rows, "sizes")
    targets = source_targets(rows, most=most)
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("none"))))
    rows = rows.withColumn("digest", digest).withColumn("class", F.length(F.bin("size"))).withColumn("part", F.substring("digest", 1, 1))
    cells = rows.groupBy("source", "class", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1))
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("none")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    cells = cells.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("offset", offset)
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    cells = cells.join(targets, same(cells, targets, "source")).select(cells["source"], "class", "part", "before", "offset", "source_size", "target")
    number = F.row_number().over(Window.partitionBy("source", "class", "part").orderBy("size", "digest", "rid"))
    rows = rows.withColumn("number", number)
    rows = rows.join(cells, same(rows, cells, "source", "class", "part")).drop(cells["source"]).drop(cells["class"]).drop(cells["part"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("before") + F.col("number")
    passed = lambda n: F.floor(n * each + F.col("offset"))
    return rows.select("rid", "id", "source", "size", "source_size", "target", (passed(rank) - passed(rank - 1)).alias("copies"))


def mix(docs: DataFrame, size: Column, seed: str = "mix", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it."""
    placed, rid = numbered(docs)
    taken = copies(placed, size, seed, source, doc_id, rid=rid).filter("copies > 0").select("rid", "copies")
    rows = placed.select(F.col(rid).alias("rid"), struct_of(docs, docs.columns).alias("row"))
    out = rows.join(taken, "rid").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*fields_of("row", docs.columns))
