"""Operator 1: shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has many points on the ring. A row belongs to the arc before the next point clockwise; a row that finds the shard
of that point full goes on to the next point. Loads are bounded by each shard's capacity, so a new shard moves few rows beside its own.
Only counts per arc come to the driver, as many as there are points; all rows are placed by DataFrame functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dictalog.llm.rows import fields_of, struct_of

#: Rows of one arc are numbered in this many parts.
PARTS = 16
#: The ring is cut into this many cells, to find a row's arc by an equi join.
CELL_BITS = 12


def points(spark: SparkSession, n_shards: int, virtual: int) -> DataFrame:
    """(at, arc, shard): the points of the ring in order; ``virtual`` points for each shard."""
    at = spark.range(n_shards * virtual, numPartitions=1).select(
        (F.col("id") % n_shards).cast("int").alias("shard"), F.xxhash64(F.lit("point"), F.col("id") % n_shards, F.floor(F.col("id") / n_shards)).alias("at")
    )
    return at.withColumn("arc", (F.row_number().over(Window.orderBy("at", "shard")) - 1).cast("int"))


def place(counts: list[int], shards: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, slot of the first): which rows of each arc go to which shard.

    In rounds: in round h the rows left of each arc ask the shard of the h-th point after their own, arcs in ring order.
    """
    room, used, out = list(capacity), [0] * len(capacity), []
    left = [(arc, 0) for arc, n in enumerate(counts) if n]
    for hop in range(len(counts)):
        rest = []
        for arc, begin in left:
            shard = shards[(arc + hop) % len(shards)]
            take = min(room[shard], counts[arc] - begin)
            if take:
                out.append((arc, begin, begin + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if begin + take < counts[arc]:
                rest.append((arc, begin + take))
        left = rest
        if not left:
            break
    return out


def even(n_rows: int, n_shards: int) -> list[int]:
    """Capacities that differ by one at most and hold all rows exactly."""
    return [n_rows // n_shards + (i < n_rows % n_shards) for i in range(n_shards)]


def slack(factor: float):
    """Capacities of ``factor`` times the mean (more slack, fewer rows moved by a new shard)."""
    return lambda n_rows, n_shards: [-int(-n_rows * factor // n_shards)] * n_shards


def ring_shards(rows: DataFrame, keys: list[Column], n_shards: int, virtual: int = 128, capacity=even) -> DataFrame:
    """``rows`` with shard and slot (gapless from 0 in each shard); columns of these names are replaced.

    ``keys`` give the place on the ring (the first) and the order among rows of one place (all). Null keys have a place as
    well. Rows equal in all keys are interchangeable. No rows give no rows. ``capacity(n_rows, n_shards)`` bounds the loads.
    """
    spark = rows.sparkSession
    ring = points(spark, n_shards, virtual)
    shift = 64 - CELL_BITS
    # segments: from each point or cell border to the next, with the arc they belong to
    cells = spark.range(1 << CELL_BITS, numPartitions=1).select(F.shiftleft(F.col("id") - (1 << (CELL_BITS - 1)), shift).alias("at"))
    marks = ring.select("at", "arc").unionByName(cells.withColumn("arc", F.lit(None).cast("int")))
    order = Window.orderBy("at", F.col("arc").isNotNull())
    n_arcs = n_shards * virtual
    segments = marks.select(
        F.shiftright("at", shift).alias("__cell"),
        F.col("at").alias("__from"),
        F.coalesce(F.lead("at").over(order), F.lit((1 << 63) - 1)).alias("__to"),
        # the arc ends at the next point; beyond the last point the ring starts anew
        F.coalesce(F.first("arc", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("__arc"),
    ).filter("__from < __to or __to = 9223372036854775807")
    names = [f"__k{i}" for i in range(len(keys))]
    rest = [c for c in rows.columns if c not in ("shard", "slot")]
    placed = rows.select(struct_of(rows, rest).alias("__row"), *[k.alias(n) for k, n in zip(keys, names)])
    placed = placed.withColumn("__at", F.xxhash64(F.lit("row"), names[0])).withColumn("__cell", F.shiftright("__at", shift))
    placed = placed.withColumn("__part", F.pmod(F.xxhash64(*names), F.lit(PARTS)).cast("int"))
    # as many segments as cells and points: a bound given by the parameters
    inside = (F.col("__at") >= F.col("__from")) & ((F.col("__at") < F.col("__to")) | (F.col("__to") == (1 << 63) - 1))
    placed = placed.join(F.broadcast(segments), "__cell").filter(inside).drop("__cell", "__from", "__to")

    counts = placed.groupBy("__arc", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("__arc").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    found = counts.select("__arc", "__part", "n", F.coalesce(before, F.lit(0)).alias("before")).collect()  # PARTS rows a point at most
    per_arc = [0] * n_arcs
    for r in found:
        per_arc[r["__arc"]] += r["n"]
    owner = [r["shard"] for r in ring.orderBy("arc").collect()]
    pieces = place(per_arc, owner, capacity(sum(per_arc), n_shards))

    offsets = _table(spark, [(r["__arc"], r["__part"], r["before"]) for r in found], "__arc int, __part int, __before long")
    spans = _table(spark, pieces, "__arc int, __begin long, __end long, shard int, __slot long")
    number = F.row_number().over(Window.partitionBy("__arc", "__part").orderBy("__at", *names)) - 1
    ranked = placed.withColumn("__number", number).join(F.broadcast(offsets), ["__arc", "__part"]).withColumn("__rank", F.col("__number") + F.col("__before"))
    ranked = ranked.join(F.broadcast(spans), "__arc").filter("__rank >= __begin and __rank < __end")
    return ranked.select(*fields_of("__row", rest), "shard", (F.col("__slot") + F.col("__rank") - F.col("__begin")).alias("slot"))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of bounded size from driver values."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    one = spark.range(1, numPartitions=1)
    return one.select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>")))
