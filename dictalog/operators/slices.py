"""Ordered per-source computations that survive one source holding a third of all rows.

A window over ``PARTITION BY source`` puts a whole source into one task. Here a *hot* source (more rows than
``dictalog.slice.maxRows``) is cut along its order column into slices of about that many rows. Windows then run
per (source, slice), and what a slice needs from the slices before or after it (a sum, the last non-null value, the
neighbouring row) comes from a carry table with one row per slice of a hot source, which is small enough to broadcast:
its size is rows / maxRows and never more than ``MAX_SLICES`` per hot source. When no source is hot, which one
map-side-combined count finds out, the plan is the plain window. With hot sources, the sliced rows are written once to
the shared folder, since both the rows and the carry table are made from them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dictalog.session import materialize

MAX_ROWS_CONF = "dictalog.slice.maxRows"
DEFAULT_MAX_ROWS = 1_000_000
MAX_SLICES = 4096
_STEP = 64  # two-level lookup: one coarse cut per 64 fine cuts


@dataclass(frozen=True)
class KeySlices:
    """Cut points of the hot keys; ``cuts`` is None when no key is hot."""

    key: str
    order: str
    cuts: DataFrame | None = None

    @property
    def trivial(self) -> bool:
        return self.cuts is None

    def rekey(self, key: str, order: str) -> "KeySlices":
        """The same cuts under other column names (the order must be the same scale)."""
        if self.trivial:
            return KeySlices(key, order)
        return KeySlices(key, order, self.cuts.withColumnRenamed(self.key, key))

    def tag(self, df: DataFrame, out: str = "_slice") -> DataFrame:
        """Add the slice number of every row (0 for ordinary keys)."""
        if self.trivial:
            return df.withColumn(out, F.lit(0))
        return self._joined(df).withColumn(out, self._number(F.col(self.order))).drop("_cuts", "_coarse")

    def tag_span(self, df: DataFrame, upto: Column, lo: str = "_slice", hi: str = "_slice_hi") -> DataFrame:
        """Slice number of the row itself and of the order value ``upto``."""
        if self.trivial:
            return df.withColumns({lo: F.lit(0), hi: F.lit(0)})
        return (
            self._joined(df)
            .withColumns({lo: self._number(F.col(self.order)), hi: self._number(upto)})
            .drop("_cuts", "_coarse")
        )

    def _joined(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.cuts), self.key, "left")

    @staticmethod
    def _number(value: Column) -> Column:
        coarse = F.size(F.filter("_coarse", lambda c: c <= value))
        fine = F.slice(F.col("_cuts"), coarse * _STEP + 1, F.lit(_STEP))
        number = coarse * _STEP + F.size(F.filter(fine, lambda c: c <= value))
        return F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(number).cast("int")


def plan_slices(df: DataFrame, key: str, order: str, max_rows: int | None = None) -> KeySlices:
    """Find the hot keys of ``df`` and cut them along the numeric column ``order``.

    Runs one small counting job; only when it finds hot keys a second, sketch-based one for the cut points.
    Both return at most rows / max_rows entries to the driver.
    """
    spark = df.sparkSession
    budget = max_rows or int(spark.conf.get(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS)))
    sized = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = {r[0]: r[1] for r in sized.filter((F.col("n") > budget) & F.col(key).isNotNull()).collect()}
    if not hot:
        return KeySlices(key, order)
    parts = {k: min(MAX_SLICES, -(-n // budget)) for k, n in hot.items()}
    finest = max(parts.values())
    marks = [i / finest for i in range(1, finest)] or [0.5]
    hot_keys = spark.createDataFrame([(k,) for k in parts], T.StructType([T.StructField(key, df.schema[key].dataType)]))
    sketched = (
        df.select(key, F.col(order).cast("double").alias("_v"))
        .join(F.broadcast(hot_keys), key)
        .groupBy(key)
        .agg(F.percentile_approx("_v", marks, min(10 * len(marks) + 100, 1_000_000)).alias("_p"))
        .collect()
    )
    rows = []
    for r in sketched:
        want = parts[r[0]]
        step = max(1, len(marks) // max(1, want - 1))
        cuts = sorted(set(r[1][step - 1 :: step]))
        coarse = cuts[_STEP - 1 :: _STEP]
        rows.append((r[0], [float(c) for c in cuts], [float(c) for c in coarse]))
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("_cuts", T.ArrayType(T.DoubleType())),
            T.StructField("_coarse", T.ArrayType(T.DoubleType())),
        ]
    )
    return KeySlices(key, order, spark.createDataFrame(rows, schema))


def _order(order_by: list[str], descending: bool = False) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order_by]


def running(
    df: DataFrame,
    slices: KeySlices,
    order_by: list[str],
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums and running last non-null values per key, in ``order_by`` order.

    ``inclusive=False`` leaves the row itself out. Sums start at 0, lasts at null.
    """
    sums, lasts = sums or {}, lasts or {}
    end = 0 if inclusive else -1
    if slices.trivial:
        w = Window.partitionBy(slices.key).orderBy(*_order(order_by)).rowsBetween(Window.unboundedPreceding, end)
        cols = {n: F.coalesce(F.sum(v).over(w), F.lit(0)) for n, v in sums.items()}
        cols |= {n: F.last(v, ignorenulls=True).over(w) for n, v in lasts.items()}
        return df.withColumns(cols)

    tagged = materialize(slices.tag(df), "sliced")
    by = [slices.key, "_slice"]
    w = Window.partitionBy(*by).orderBy(*_order(order_by)).rowsBetween(Window.unboundedPreceding, end)
    local = {f"_l_{n}": F.coalesce(F.sum(v).over(w), F.lit(0)) for n, v in sums.items()}
    local |= {f"_l_{n}": F.last(v, ignorenulls=True).over(w) for n, v in lasts.items()}

    hot_only = tagged.join(F.broadcast(slices.cuts.select(slices.key)), slices.key, "left_semi")
    totals = [F.sum(v).alias(f"_c_{n}") for n, v in sums.items()]
    totals += [
        F.max(F.when(v.isNotNull(), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)], v.alias("v"))))
        .getField("v")
        .alias(f"_c_{n}")
        for n, v in lasts.items()
    ]
    before = Window.partitionBy(slices.key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_c_{n}": F.sum(f"_c_{n}").over(before) for n in sums}
    carried |= {f"_c_{n}": F.last(f"_c_{n}", ignorenulls=True).over(before) for n in lasts}
    carry = hot_only.groupBy(*by).agg(*totals).withColumns(carried)

    out = tagged.withColumns(local).join(F.broadcast(carry), by, "left")
    final = {n: F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
    final |= {n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in lasts}
    return out.withColumns(final).select(*df.columns, *final)


def row_numbers(df: DataFrame, slices: KeySlices, order_by: list[str], out: str) -> DataFrame:
    """1, 2, 3, ... per key."""
    return running(df, slices, order_by, sums={out: F.lit(1).cast("long")})


def neighbour(
    df: DataFrame, slices: KeySlices, order_by: list[str], fields: dict[str, Column], forward: bool = True
) -> DataFrame:
    """Values of the next (or previous) row of the same key, across slice borders."""
    packed = F.struct(*[v.alias(n) for n, v in fields.items()])
    shift = F.lead if forward else F.lag
    if slices.trivial:
        w = Window.partitionBy(slices.key).orderBy(*_order(order_by))
        got = df.withColumn("_nb", shift(packed, 1).over(w))
        return got.withColumns({n: F.col(f"_nb.{n}") for n in fields}).drop("_nb")

    tagged = materialize(slices.tag(df), "sliced")
    by = [slices.key, "_slice"]
    w = Window.partitionBy(*by).orderBy(*_order(order_by))
    edge = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)])
    pick = F.min_by if forward else F.max_by
    hot_only = tagged.join(F.broadcast(slices.cuts.select(slices.key)), slices.key, "left_semi")
    over = Window.partitionBy(slices.key).orderBy("_slice")
    carry = hot_only.groupBy(*by).agg(pick(packed, edge).alias("_e")).withColumn("_e", shift("_e", 1).over(over))
    got = tagged.withColumn("_nb", shift(packed, 1).over(w)).join(F.broadcast(carry), by, "left")
    return got.withColumns({n: F.coalesce(F.col("_nb"), F.col("_e")).getField(n) for n in fields}).select(
        *df.columns, *fields
    )


def trailing_range(
    df: DataFrame, slices: KeySlices, reach: int, aggs: dict[str, Column]
) -> DataFrame:
    """Aggregates over the rows of the same key whose order value lies in [own - reach, own].

    A row is copied into every later slice whose rows can still see it, so each slice is self-contained.
    """
    span = lambda *by: Window.partitionBy(*by).orderBy(F.col(slices.order)).rangeBetween(-reach, 0)
    if slices.trivial:
        w = span(slices.key)
        return df.withColumns({n: a.over(w) for n, a in aggs.items()})
    tagged = slices.tag_span(df, F.col(slices.order) + F.lit(reach))
    copies = tagged.withColumn("_at", F.explode(F.sequence("_slice", "_slice_hi")))
    w = span(slices.key, "_at")
    done = copies.withColumns({n: a.over(w) for n, a in aggs.items()})
    return done.filter(F.col("_at") == F.col("_slice")).select(*df.columns, *aggs)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
