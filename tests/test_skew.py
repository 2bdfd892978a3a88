"""A group holding a third of all rows must be split, pre-aggregated, and
never handled by one task."""

import random

from pyspark.sql import functions as F

from cohortlens.operators import contrast, gap_extremes
from cohortlens.operators.quantiles import exact_quantiles, value_slices


def _skewed(spark, n=60000):
    rnd = random.Random(17)
    rows = []
    for i in range(n):
        g = 0 if i % 3 == 0 else rnd.randint(1, 40)  # group 0: one third of all rows
        rows.append((g, rnd.random() * 1e6))
    return spark.createDataFrame(rows, "g int, x double")


def test_hot_group_spans_many_slices(spark):
    df = _skewed(spark)
    slices = value_slices(df, ["g"], F.col("x"), 16)
    per_pid = {r._pid: r.rows for r in slices.groupBy("_pid").agg(F.count(F.lit(1)).alias("rows")).collect()}
    hot = slices.filter(F.col("g") == 0).select("_pid").distinct().count()
    assert hot >= 4                                   # the hot group is split across slices
    assert max(per_pid.values()) <= 2.5 * (sum(per_pid.values()) / len(per_pid))  # balanced slices


def test_exact_quantiles_on_hot_group_equal_percentile(spark):
    df = _skewed(spark)
    got = {r.g: r.median for r in exact_quantiles(df, ["g"], "x", {"median": 0.5}, partitions=16).collect()}
    want = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("x", 0.5).alias("m")).collect()}
    assert got == want


def test_contrast_spreads_a_hot_group_by_value(spark):
    """The exact contrast shuffles partial counts keyed by (cohort, level,
    value): a hot cohort is pre-aggregated map-side and then spread over the
    reducers by value, never merged in one task."""
    df = spark.range(0, 30000).select((F.col("id") % 3 == 0).cast("int").alias("c"),
                                      (F.col("id") % 5).alias("l"), (F.col("id") % 97).alias("x"))
    plan = contrast(df, "c", "l", "x")._jdf.queryExecution().executedPlan().toString()
    first = plan.rindex("Exchange hashpartitioning")
    assert plan[first:].startswith("Exchange hashpartitioning(c#") and ", x#" in plan[first:first + 80]
    assert "partial_count" in plan[first:]
    # quantiles are taken over the histogram (value _v weighted by count _c),
    # never over the raw rows of the scan
    assert "percentile(_v#" in plan and "percentile(x#" not in plan


def test_gap_extremes_keep_all_ties(spark):
    gaps = spark.createDataFrame([("a", -4.0), ("b", -4.0), ("c", -6.0), ("d", None)], "level string, gap double")
    rows = [(r.extreme, r.level) for r in gap_extremes(gaps, "level").collect()]
    assert sorted(rows) == [("narrowest", "a"), ("narrowest", "b"), ("widest", "c")]
    one = spark.createDataFrame([("a", 2.0)], "level string, gap double")
    assert sorted((r.extreme, r.level) for r in gap_extremes(one, "level").collect()) == \
        [("narrowest", "a"), ("widest", "a")]


def test_exact_quantiles_with_null_and_multi_keys(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 0, 1]), rnd.choice([None, "a", "b"]), rnd.choice([None, rnd.random() * 100]))
            for _ in range(5000)]
    df = spark.createDataFrame(rows, "g int, h string, x double")
    probs = {"p0": 0.0, "p25": 0.25, "median": 0.5, "p100": 1.0}
    got = {(r.g, r.h): (r.p0, r.p25, r.median, r.p100)
           for r in exact_quantiles(df, ["g", "h"], "x", probs, partitions=11).collect()}
    want = {(r.g, r.h): tuple(r.q) for r in df.groupBy("g", "h").agg(
        F.percentile("x", list(probs.values())).alias("q")).collect() if r.q is not None}
    assert got == want and len(got) == 9


def test_sketch_contrast_is_within_rank_error(spark):
    """Two-level KLL quartiles: n/avg/min/max exact, quartiles observed values
    within the sketch's rank error of the exact rank, for a hot group too."""
    rnd = random.Random(23)
    rows = [(0 if i % 3 == 0 else rnd.randint(1, 3), rnd.randint(1, 4), rnd.random() * 1000) for i in range(60000)]
    df = spark.createDataFrame(rows, "c int, l int, x double")
    stats = ("n", "avg", "min", "max", "median", "p25", "p75")
    sk = {(r.c, r.l): r for r in contrast(df, "c", "l", "x", stats=stats, method="sketch", salts=8).collect()}
    ex = {(r.c, r.l): r for r in contrast(df, "c", "l", "x", stats=("n", "avg", "min", "max"),
                                          method="percentile").collect()}
    assert sk.keys() == ex.keys()
    for key, r in sk.items():
        assert (r.n, r.avg_wait_minutes, r.min_wait_minutes, r.max_wait_minutes) == \
            (ex[key].n, ex[key].avg_wait_minutes, ex[key].min_wait_minutes, ex[key].max_wait_minutes)
        xs = sorted(x for c, lv, x in rows if (c, lv) == key)
        for name, p in (("p25_wait_minutes", 0.25), ("median_wait_minutes", 0.5), ("p75_wait_minutes", 0.75)):
            q = getattr(r, name)
            rank = sum(1 for x in xs if x <= q) / len(xs)
            assert q in xs and abs(rank - p) <= 0.03, (key, name, rank)


def test_sketch_contrast_small_groups_are_exact_observed_values(spark):
    df = spark.createDataFrame([(1, 1, v) for v in (5, 1, 9, 3, 7)], "c int, l int, x int")
    r = contrast(df, "c", "l", "x", stats=("median", "p25"), method="sketch").first()
    assert (r.median_wait_minutes, r.p25_wait_minutes) == (5.0, 3.0)
