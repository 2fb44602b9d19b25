import random

import pytest
from pyspark.sql import functions as F

from dictalog.operators.ranges import lookback, overlap_join, plan_bins, planned_range_join, range_join


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(11)
    points = [(rnd.choice("ab"), i, rnd.randint(-50, 500)) for i in range(120)]
    ranges = []
    for i in range(40):
        lo = rnd.randint(-60, 500)
        ranges.append((rnd.choice("abc"), i, lo, lo + rnd.choice([-1, 0, 5, 80, 300])))
    return (
        points,
        ranges,
        spark.createDataFrame(points, "k STRING, pid INT, at BIGINT").cache(),
        spark.createDataFrame(ranges, "k STRING, rid INT, lo BIGINT, hi BIGINT").cache(),
    )


def ids(df):
    return sorted((r["pid"], r["rid"]) for r in df.collect())


@pytest.mark.parametrize("width, spread", [(7, 1), (50, 3), (1000, 1)])
@pytest.mark.parametrize("closed", [True, False])
def test_range_join(data, width, spread, closed):
    points, ranges, p, r = data
    want = sorted(
        (i, j) for k, i, at in points for q, j, lo, hi in ranges if k == q and lo <= at and (at <= hi if closed else at < hi)
    )
    assert ids(range_join(p, r, "k", "at", F.col("lo"), F.col("hi"), width, closed, spread=spread)) == want


def test_right_keeps_ranges_without_points(data):
    points, ranges, p, r = data
    got = range_join(p, r, "k", "at", F.col("lo"), F.col("hi"), 40, how="right")
    assert {x["rid"] for x in got.collect()} == {j for _, j, _, _ in ranges}


def test_lookback(data):
    points, ranges, p, r = data
    marks = r.select("k", "rid", F.col("lo").alias("mark"))
    want = sorted((i, j) for k, i, at in points for q, j, lo, _ in ranges if k == q and lo - 30 <= at < lo)
    assert ids(lookback(p, marks, "k", "at", "mark", 30)) == want


@pytest.mark.parametrize("width", [5, 64, 4096])
def test_overlap_join(spark, data, width):
    _, ranges, _, r = data
    spans = [x for x in ranges if x[3] >= x[2]]
    left = r.filter("hi >= lo").select("k", F.col("rid").alias("pid"), F.col("lo").alias("s"), F.col("hi").alias("e"))
    got = overlap_join(left, r.filter("hi >= lo"), "k", ("s", "e"), ("lo", "hi"), width)
    want = sorted(
        (i, j) for k, i, s, e in spans for q, j, lo, hi in spans if k == q and e >= lo and s < hi
    )
    assert ids(got) == want


@pytest.mark.parametrize("rows", [5, 1000])
@pytest.mark.parametrize("closed", [True, False])
def test_planned_bins(data, rows, closed):
    points, ranges, p, r = data
    want = sorted(
        (i, j) for k, i, at in points for q, j, lo, hi in ranges if k == q and lo <= at and (at <= hi if closed else at < hi)
    )
    bins = plan_bins(p, r, "k", "at", F.col("lo"), F.col("hi"), rows)
    assert ids(planned_range_join(p, r, "k", "at", F.col("lo"), F.col("hi"), bins, closed)) == want


def test_hot_bin_and_long_range_are_spread(spark):
    """A third of the points at one time, and a range over the whole source: no part of the join has more than three times the median's rows."""
    rows = [("a", i, i * 10 if i % 3 else 15_000) for i in range(30_000)]
    points = spark.createDataFrame(rows, "k STRING, pid INT, at BIGINT")
    spans = [("a", j, j * 100, j * 100 + 2_000) for j in range(0, 3000, 10)] + [("a", -1, 0, 300_000)]
    ranges = spark.createDataFrame(spans, "k STRING, rid INT, lo BIGINT, hi BIGINT")
    bins = plan_bins(points, ranges, "k", "at", F.col("lo"), F.col("hi"), 200)
    assert bins.hot.count() == 1 and bins.hot.first()["_parts"] >= 40
    joined = planned_range_join(points, ranges, "k", "at", F.col("lo"), F.col("hi"), bins)
    assert joined.filter("rid = -1").count() == 30_000
    hot = bins.hot.first()["_bin"]
    tagged = points.withColumn("_bin", F.floor(F.col("at") / bins.width)).join(bins.hot, ["k", "_bin"], "left")
    salted = tagged.groupBy("_bin", F.pmod(F.xxhash64("k", "pid", "at"), F.coalesce("_parts", F.lit(1)))).count().collect()
    sizes = sorted(x["count"] for x in salted)
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2] and sum(x["_bin"] == hot for x in salted) >= 40


def test_planned_bins_of_empty_tables(data):
    _, _, p, r = data
    for x, y in ((p.filter("false"), r), (p, r.filter("false"))):
        bins = plan_bins(x, y, "k", "at", F.col("lo"), F.col("hi"))
        assert planned_range_join(x, y, "k", "at", F.col("lo"), F.col("hi"), bins).count() == 0
