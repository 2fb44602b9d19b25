"""Range joins as equi joins on (key, bin), so the planner hashes or sorts instead of pairing everything."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictalog.session import materialize

#: Hot bins are at most so many: their table is sent to all executors.
MOST_HOT = 100_000


@dataclass(frozen=True)
class Bins:
    """How a range join is cut: the width of a bin, and for bins with very many points (key, _bin) into how many parts they are salted (_parts)."""

    width: int
    hot: DataFrame | None


def plan_bins(points: DataFrame, ranges: DataFrame, key: str, at: str, low: Column, high: Column, rows: int = 100_000) -> Bins:
    """Bins from the data: as wide as most ranges are long, narrower where that would put more than ``rows`` points of a source into each.

    Two cheap passes over the points' keys and times, one over the ranges. A bin with more than ``rows`` points all the same is salted; with very
    many points ``rows`` is raised so that no more than MOST_HOT bins can be.
    """
    length = ranges.agg(F.percentile_approx(F.greatest(high - low, F.lit(0)).cast("long"), 0.75).alias("p")).first()["p"]
    per = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.max(at) - F.min(at)).cast("long").alias("span"))
    dense, total = per.agg(F.max(F.col("n") / F.greatest("span", F.lit(1))), F.sum("n")).first()
    rows = max(rows, (total or 0) // MOST_HOT)
    width = max(1, int(length or 1))
    if dense:
        width = max(1, min(width, int(rows / dense)))
    counts = points.groupBy(key, F.floor(F.col(at) / width).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(counts.filter(F.col("_n") > rows).select(key, "_bin", F.ceil(F.col("_n") / rows).cast("int").alias("_parts")), "hot-bins")
    return Bins(width, None if hot.isEmpty() else hot)


def planned_range_join(points: DataFrame, ranges: DataFrame, key: str, at: str, low: Column, high: Column, bins: Bins, closed_high: bool = True) -> DataFrame:
    """``range_join`` (inner) with planned bins: only the points of hot bins are dealt out over parts, and only ranges that touch such a bin are repeated there."""
    tagged = points.withColumn("_bin", F.floor(F.col(at) / bins.width))
    spans = ranges.withColumns({"_low": low, "_high": high}).filter(F.col("_high") >= F.col("_low"))
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_low") / bins.width), F.floor(F.col("_high") / bins.width))))
    if bins.hot is None:
        tagged, spans = tagged.withColumn("_salt", F.lit(0)), spans.withColumn("_salt", F.lit(0))
    else:
        parts = F.coalesce("_parts", F.lit(1))
        hot = F.broadcast(bins.hot)  # MOST_HOT rows at most
        tagged = tagged.join(hot, [key, "_bin"], "left").withColumn("_salt", F.pmod(F.xxhash64(*points.columns), parts).cast("int")).drop("_parts")
        spans = spans.join(hot, [key, "_bin"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    upper = F.col(at) <= F.col("_high") if closed_high else F.col(at) < F.col("_high")
    pairs = tagged.join(spans, [key, "_bin", "_salt"]).filter((F.col(at) >= F.col("_low")) & upper)
    return pairs.drop("_bin", "_salt", "_low", "_high")


def range_join(
    points: DataFrame,
    ranges: DataFrame,
    key: str,
    at: str,
    low: Column,
    high: Column,
    bin_width: int,
    closed_high: bool = True,
    how: str = "inner",
    spread: int = 1,
) -> DataFrame:
    """Pairs with equal ``key`` and ``low <= at <= high`` (``< high`` if not ``closed_high``).

    A point has one bin, a range is repeated in each bin it touches, so no pair comes twice. One source with very many
    points is spread by its bins; if a single bin is still too big, ``spread`` > 1 salts the points of each bin and
    repeats the ranges, and AQE splits what is left. ``how`` may be 'inner' or 'right' (keep ranges without points).
    Columns other than ``key`` must have different names on both sides.
    """
    tagged = points.withColumns(
        {
            "_bin": F.floor(F.col(at) / bin_width),
            "_salt": F.pmod(F.xxhash64(at), F.lit(spread)).cast("int") if spread > 1 else F.lit(0),
        }
    )
    spans = ranges.withColumns({"_low": low, "_high": high})
    spread_out = spans.filter(F.col("_high") >= F.col("_low")).withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("_low") / bin_width), F.floor(F.col("_high") / bin_width)))
    )
    if spread > 1:
        spread_out = spread_out.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    else:
        spread_out = spread_out.withColumn("_salt", F.lit(0))
    upper = F.col(at) <= F.col("_high") if closed_high else F.col(at) < F.col("_high")
    pairs = tagged.join(spread_out, [key, "_bin", "_salt"]).filter((F.col(at) >= F.col("_low")) & upper)
    pairs = pairs.drop("_bin", "_salt", "_low", "_high")
    if how == "inner":
        return pairs
    ident = [c for c in ranges.columns]
    bare = ranges.join(pairs.select(*ident).distinct(), ident, "left_anti")
    return pairs.unionByName(bare, allowMissingColumns=True)


def lookback(
    points: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, reach: int, spread: int = 1
) -> DataFrame:
    """Points in [mark - reach, mark) of every mark of the same key."""
    low, high = F.col(mark_at) - F.lit(reach), F.col(mark_at)
    return range_join(points, marks, key, at, low, high, reach, closed_high=False, spread=spread)


def overlap_join(
    items: DataFrame,
    spans: DataFrame,
    key: str,
    item: tuple[str, str],
    span: tuple[str, str],
    bin_width: int,
) -> DataFrame:
    """Pairs where ``item_end >= span_start`` and ``item_start < span_end``.

    Both sides may cover several bins; a pair is kept in the first bin they share.
    """
    def binned(df: DataFrame, lo: str, hi: str, tag: str) -> DataFrame:
        first, last = F.floor(F.col(lo) / bin_width), F.floor(F.col(hi) / bin_width)
        return df.withColumn(f"_{tag}", first).withColumn("_bin", F.explode(F.sequence(first, last)))

    a = binned(items, *item, "a")
    b = binned(spans, *span, "b")
    pairs = a.join(b, [key, "_bin"]).filter(
        (F.col(item[1]) >= F.col(span[0]))
        & (F.col(item[0]) < F.col(span[1]))
        & (F.col("_bin") == F.greatest("_a", "_b"))
    )
    return pairs.drop("_bin", "_a", "_b")
