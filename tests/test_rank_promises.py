"""Rank summaries keep their promise, histogram refinement is exact."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import rank_summary as R
from cohortlens.operators import selection as S


def random_rows(seed, n=6000):
    rnd = random.Random(seed)
    def value(g):
        if rnd.random() < 0.05 or g == "none":
            return None
        return rnd.choice([float(rnd.randint(0, 9)), rnd.gauss(0, 1), rnd.expovariate(1) * 10 ** rnd.randint(-8, 8), 5.0, -0.0])
    groups = ["hot"] * 5 + ["a", "b", None, "none"]
    rows = [(g, rnd.choice([1, 2, 3, None]), value(g)) for g in (rnd.choice(groups) for _ in range(n))]
    return rows + [("one", 1, 7.5), ("two", 1, -1.0), ("two", 2, 3.0)]


def truth(values, rank):
    """Ranks, from 1, that ``rank``'s value covers is what a boundary is held against."""
    return sorted(values)[rank - 1]


@pytest.mark.parametrize("epsilon", [0.0, 0.01, 0.1])
@pytest.mark.parametrize("part,pieces", [(None, None), ("day", None), ("day", 5)])
def test_rank_error_within_the_promise(spark, epsilon, part, pieces):
    rows = random_rows(11)
    df = spark.createDataFrame(rows, "g string, day int, x double").repartition(7)
    state = R.summarise(df, ["g"], "x", epsilon, part, pieces)
    compacted = R.compact(state, ["g"], epsilon, F.col("part") % 3)
    for of, promise in ((state, epsilon), (compacted, 2 * epsilon)):
        got = {r.g: r for r in R.boundaries(of, ["g"], 4).collect()}
        assert set(got) == {g for g, _, _ in rows}
        for g, r in got.items():
            values = sorted(x for h, _, x in rows if h == g and x is not None)
            assert r.n_rows == sum(h == g for h, _, _ in rows) and r.n == len(values)
            if not values:
                assert r.boundary == [None] * 5 and r.rank_error == [None] * 5
                continue
            for j, (b, lo, hi, e) in enumerate(zip(r.boundary, r.rank_low, r.rank_high, r.rank_error)):
                want = max(1, math.ceil(len(values) * j / 4))
                below, upto = sum(v < b for v in values), sum(v <= b for v in values)
                assert upto > below and lo <= below + 1 and upto <= hi
                real = max(below + 1 - want, want - upto, 0)
                assert real <= e <= promise * len(values) + 1e-9, (g, j, real, e)
            assert (r.boundary[0], r.boundary[4]) == (values[0], values[-1])


def test_bounds_hold_at_every_point(spark):
    rows = random_rows(5, 2000)
    df = spark.createDataFrame(rows, "g string, day int, x double")
    state = R.compact(R.summarise(df, ["g"], "x", 0.05, "day"), ["g"], 0.05, F.lit(0))
    for r in R.merged_bounds(state, ["g"]).collect():
        values = [x for h, _, x in rows if h == r.g and x is not None]
        assert r["_bel_lo"] <= sum(v < r["_v"] for v in values) <= r["_bel_hi"]
        assert r["_up_lo"] <= sum(v <= r["_v"] for v in values) <= r["_up_hi"]
        assert r["_n"] == len(values)


def test_reruns_are_identical_and_states_merge(spark, tmp_path):
    df = spark.createDataFrame(random_rows(2), "g string, day int, x double")
    a = R.summarise(df.repartition(3), ["g"], "x", 0.02, "day")
    b = R.summarise(df.repartition(11, "x"), ["g"], "x", 0.02, "day")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    # a state per day, each stored on its own, answers as the whole does
    for day in ("day = 1", "day = 2", "day = 3", "day IS NULL"):
        R.summarise(df.filter(day), ["g"], "x", 0.02, "day").write.mode("append").parquet(str(tmp_path / "state"))
    whole, merged = R.boundaries(a, ["g"]), R.boundaries(spark.read.parquet(str(tmp_path / "state")), ["g"])
    assert sorted(whole.collect(), key=str) == sorted(merged.collect(), key=str)


def test_points_stay_few(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 199_999).cast("double").alias("x"))
    state = R.summarise(df, ["g"], "x", 0.01).filter(F.col("_v").isNotNull())
    assert state.count() <= R.VALUE_PIECES * (2 * 110 + 2)
    assert R.compact(state, ["g"], 0.01).count() < 230


PROBS = {"p0": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}


def percentile(spark, df):
    return df.groupBy("g").agg(*[F.percentile("x", p).alias(n) for n, p in PROBS.items()]).filter("p0 IS NOT NULL")


@pytest.mark.parametrize("seed", [1, 2])
def test_refinement_equals_percentile(spark, seed):
    df = spark.createDataFrame(random_rows(seed), "g string, day int, x double").repartition(5)
    got = {r.g: r for r in S.refined_quantiles(df, ["g"], "x", PROBS).collect()}
    want = {r.g: r for r in percentile(spark, df).collect()}
    assert got == want and "none" not in got


def test_refinement_of_hard_ranges(spark):
    tiny, big = 5e-324, 1.7976931348623157e308
    rows = [("far", x) for x in [-big, big, 0.0, tiny, -tiny, 1.0, 1.0 + 2 ** -52, 1e-300, 1e300] * 3]
    rows += [("peak", 1e6 + i * 2 ** -33) for i in range(3000)] + [("peak", -1e300)]
    rows += [("inf", x) for x in [float("inf")] * 5 + [float("-inf")] * 4 + [1.0, 2.0]]
    rows += [("all", float("inf"))] * 3
    df = spark.createDataFrame(rows, "g string, x double")
    probs = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    got = {r.g: [r.p25, r.median, r.p75] for r in S.refined_quantiles(df, ["g"], "x", probs).collect()}
    for g in ("far", "peak", "inf", "all"):
        v = sorted(x for h, x in rows if h == g)
        want = []
        for p in probs.values():
            at = (len(v) - 1) * p
            a, b = v[math.floor(at)], v[math.ceil(at)]
            want.append(a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)
        assert got[g] == want, g


def test_shuffle_is_bounded_by_bins(spark):
    """Rows leaving the map side do not follow the number of distinct values."""
    def shuffled(n):
        df = spark.range(0, n, 1, 4).select(F.lit(1).alias("g"), F.rand(3).alias("x"))
        bins = df.groupBy("g", S._bin(F.col("x"), F.lit(0.0), F.lit(1.0), False).alias("b")).count()
        return bins.count()
    assert shuffled(20_000) <= S.BINS + 2 and shuffled(400_000) <= S.BINS + 2


def test_edges(spark):
    df = spark.createDataFrame([("a", None)], "g string, x double")
    probs = {"median": 0.5}
    assert S.refined_quantiles(df, ["g"], "x", probs).collect() == []
    assert S.refined_quantiles(df.limit(0), ["g"], "x", probs).collect() == []
    assert R.boundaries(R.summarise(df.limit(0), ["g"], "x"), ["g"]).collect() == []
    many = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "g int, x double")
    assert S.refined_quantiles(many, ["g"], "x", probs, max_groups=10).count() == 50      # beyond the limit
