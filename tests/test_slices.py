import random

import pytest
from pyspark.sql import functions as F

from dictalog.operators.slices import KeySlices, neighbour, plan_slices, row_numbers, running, trailing_range


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = []
    for key, n in (("hot", 400), ("warm", 40), ("cold", 3)):
        t = 0
        for i in range(n):
            t += rnd.randint(1, 9)
            data.append((key, t, i, rnd.choice([None, 1, 2, 3]), rnd.randint(0, 9)))
    rnd.shuffle(data)
    return spark.createDataFrame(data, "k STRING, t BIGINT, i BIGINT, mark INT, v INT").cache()


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def sliced(rows):
    s = plan_slices(rows, "k", "t", max_rows=30)
    assert not s.trivial
    return s


def test_only_hot_keys_are_cut(rows):
    s = sliced(rows)
    cut = {r["k"]: len(r["_cuts"]) for r in s.cuts.collect()}
    assert set(cut) == {"hot", "warm"} and cut["hot"] > 8
    sizes = s.tag(rows).groupBy("k", "_slice").count().collect()
    assert max(r["count"] for r in sizes) < 90
    assert plan_slices(rows, "k", "t", max_rows=1000).trivial


@pytest.mark.parametrize("inclusive", [True, False])
def test_running(rows, inclusive):
    def go(s):
        return running(rows, s, ["t", "i"], sums={"total": F.col("v")}, lasts={"seen": F.col("mark")}, inclusive=inclusive)

    assert plain(go(sliced(rows))) == plain(go(KeySlices("k", "t")))


@pytest.mark.parametrize("forward", [True, False])
def test_neighbour(rows, forward):
    def go(s):
        return neighbour(rows, s, ["t", "i"], {"nt": F.col("t"), "nv": F.col("v")}, forward=forward)

    assert plain(go(sliced(rows))) == plain(go(KeySlices("k", "t")))


@pytest.mark.parametrize("reach", [5, 60, 700])
def test_trailing_range(rows, reach):
    def go(s):
        return trailing_range(rows, s, reach, {"n": F.count(F.lit(1)), "sv": F.sum("v")})

    assert plain(go(sliced(rows))) == plain(go(KeySlices("k", "t")))


def test_row_numbers(rows):
    got = row_numbers(rows, sliced(rows), ["t", "i"], "n").groupBy("k").agg(F.max("n"), F.count_distinct("n")).collect()
    assert {tuple(r) for r in got} == {("hot", 400, 400), ("warm", 40, 40), ("cold", 3, 3)}


def test_all_rows_at_one_time(spark):
    """No cut can split equal times; the results stay right."""
    df = spark.createDataFrame([("a", 5, i) for i in range(100)], "k STRING, t BIGINT, i BIGINT")
    s = plan_slices(df, "k", "t", max_rows=10)
    assert sorted(r["n"] for r in row_numbers(df, s, ["t", "i"], "n").collect()) == list(range(1, 101))
