"""Property tests: invariants that hold for any coded input, plus exactness
of the rounding and quantile building blocks against Python references."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.functions.stats import rounded_ratio
from cohortlens.operators import contrast, frequency, layer_accounting, waterfall
from cohortlens.operators.quantiles import exact_quantiles
from cohortlens.plans import study as S
from fixture import visit, visits_df

codes = st.fixed_dictionaries({
    "ARREMS": st.sampled_from([-9, -8, 1, 2, None]),
    "WAITTIME": st.one_of(st.sampled_from([-9, -7, 99]), st.integers(0, 300)),
    "IMMEDR": st.sampled_from([-9, -8, 0, 7, 1, 2, 3, 4, 5]),
    "PAINSCALE": st.integers(-9, 10),
    "BOARDED": st.sampled_from([-9, -8, -7, 0, 5, 100]),
    "ARRTIME": st.integers(-9, 2400),
})


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck),
          phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(st.lists(codes, min_size=1, max_size=60))
def test_contrast_invariants(spark, rows):
    df = visits_df(spark, [visit(**r) for r in rows])
    universe = S.clean_universe(df).count()
    con = S.run_dimension(df, "distribution").collect()
    assert sum(r.n for r in con) == universe
    for r in con:
        assert r.p25_wait_minutes <= r.median_wait_minutes <= r.p75_wait_minutes
    core = S.run_dimension(df, "core").collect()
    for r in core:
        assert r.min_wait_minutes <= r.avg_wait_minutes <= r.max_wait_minutes
    board = S.run_dimension(df, "boarding").collect()
    for cohort in {r.arrival_method for r in board}:
        total = sum(r.pct_of_arrival_method for r in board if r.arrival_method == cohort)
        assert abs(total - 100.0) <= 0.01 * len(board)
    w = waterfall(df, S.TWO_LAYER_RULES).first()
    nulls = sum(1 for r in rows if r["ARREMS"] is None and r["WAITTIME"] not in (-9, -7, 99))
    # inclusion-exclusion: rows caught by no rule = survivors + rows that no
    # rule catches but whose NOT IN predicate is NULL
    assert w.total_records - w.arrems_excluded - w.waittime_excluded + w.multi_rule_excluded \
        == w.clean_universe + nulls
    layers = layer_accounting(df, [("a", S.TWO_LAYER_RULES), ("b", S.IMMEDR_RULE)]).collect()
    assert layers[-1].rows_remaining == universe
    assert sum(r.rows_removed for r in layers) == len(rows) - universe


def test_frequency_shares_sum_to_100(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(rnd.randint(0, 40),) for _ in range(997)], "x int")
    rows = frequency(df, "x").collect()
    assert sum(r.n for r in rows) == 997
    assert abs(sum(r.pct_of_total for r in rows) - 100) <= 0.005 * len(rows)


def test_rounded_ratio_is_exact_half_up(spark):
    rnd = random.Random(11)
    pairs = [(rnd.randint(-10 ** 12, 10 ** 12), rnd.choice([1, 2, 3, 4, 8, 20, 40, 7, 10 ** 6 + 3]))
             for _ in range(3000)]
    pairs += [(5, 2), (-5, 2), (1, 8), (-1, 8), (3, 8), (0, 5), (1, 0)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", rounded_ratio("a", "b", 1).alias("r1"),
                    rounded_ratio("a", "b", 2, factor=100).alias("r2")).collect()
    for row in got:
        if row.b == 0:
            assert row.r1 is None
            continue
        q = Decimal(row.a) / Decimal(row.b)
        assert row.r1 == float(q.quantize(Decimal("0.1"), ROUND_HALF_UP)), row
        assert row.r2 == float((q * 100).quantize(Decimal("0.01"), ROUND_HALF_UP)), row


def test_exact_quantiles_match_numpy_and_percentile(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(6):
        n = 5000 if g == 0 else rnd.randint(1, 200)  # group 0 is hot
        rows += [(g, rnd.random() * 1e6 if g % 2 else float(rnd.randint(0, 30))) for _ in range(n)]
    df = spark.createDataFrame(rows, "g int, x double")
    probs = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    got = {r.g: (r.p25, r.median, r.p75) for r in exact_quantiles(df, ["g"], "x", probs, partitions=7).collect()}
    ref = {r.g: (r.a, r.b, r.c) for r in df.groupBy("g").agg(
        F.percentile("x", 0.25).alias("a"), F.percentile("x", 0.5).alias("b"),
        F.percentile("x", 0.75).alias("c")).collect()}
    assert got == ref
    for g, qs in got.items():
        xs = np.array([x for gg, x in rows if gg == g])
        assert np.allclose(qs, np.percentile(xs, [25, 50, 75]), rtol=0, atol=1e-6)


def test_exact_sorted_contrast_equals_exact(spark):
    rnd = random.Random(9)
    rows = [visit(ARREMS=rnd.choice([1, 2]), IMMEDR=rnd.randint(1, 5), WAITTIME=rnd.randint(0, 500))
            for _ in range(2000)]
    df = visits_df(spark, rows)
    a = sorted(tuple(r) for r in S.run_dimension(df, "distribution", "exact").collect())
    b = sorted(tuple(r) for r in S.run_dimension(df, "distribution", "exact_sorted").collect())
    assert a == b


def test_generic_contrast_on_decimal_measure(spark):
    df = spark.createDataFrame([("a", 1, "1.05"), ("a", 1, "2.00"), ("a", 1, "0.10")],
                               "c string, l int, x string").withColumn("x", F.col("x").cast("decimal(10,2)"))
    r = contrast(df, "c", "l", "x", stats=("n", "avg"), digits=2).first()
    assert r.avg_wait_minutes == 1.05  # 3.15 / 3 exactly


def test_half_even_rounding_is_exact(spark):
    rnd = random.Random(21)
    pairs = [(rnd.randint(-10 ** 9, 10 ** 9), rnd.choice([2, 4, 8, 20, 40, 3, 7])) for _ in range(2000)]
    pairs += [(25, 20), (35, 20), (-25, 20), (125, 100), (135, 100)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", rounded_ratio("a", "b", 1, rounding="half_even").alias("r")).collect()
    from decimal import ROUND_HALF_EVEN
    for row in got:
        want = float((Decimal(row.a) / Decimal(row.b)).quantize(Decimal("0.1"), ROUND_HALF_EVEN))
        assert row.r == want, row


def test_half_even_contrast_flavour(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 2)], "c int, l int, x int")
    up = contrast(df, "c", "l", "x", stats=("p25",)).first().p25_wait_minutes
    even = contrast(df, "c", "l", "x", stats=("p25",), rounding="half_even").first().p25_wait_minutes
    assert (up, even) == (1.3, 1.2)


def test_histogram_methods_equal_spark_aggregates(spark):
    rnd = random.Random(31)
    rows = [visit(ARREMS=rnd.choice([1, 2]), IMMEDR=rnd.randint(1, 5),
                  WAITTIME=rnd.choice([rnd.randint(0, 400), None, None]) if rnd.random() < 0.05 else rnd.randint(0, 400))
            for _ in range(3000)]
    df = visits_df(spark, rows)
    stats = ("n", "n_valid", "avg", "min", "max", "median", "p25", "p75")
    key = lambda r: (r.c, r.l)
    hist = {key(r): r for r in contrast(df, "ARREMS", "IMMEDR", "WAITTIME", stats=stats, cohort_name="c",
                                         level_name="l").collect()}
    ref = {key(r): r for r in contrast(df, "ARREMS", "IMMEDR", "WAITTIME", stats=stats, method="percentile",
                                        cohort_name="c", level_name="l").collect()}
    assert hist == ref
    disc = {key(r): r for r in contrast(df, "ARREMS", "IMMEDR", "WAITTIME", stats=("median", "p25", "p75"),
                                         method="discrete", cohort_name="c", level_name="l").collect()}
    appr = {key(r): r for r in contrast(df, "ARREMS", "IMMEDR", "WAITTIME", stats=("median", "p25", "p75"),
                                         method="approx", cohort_name="c", level_name="l").collect()}
    assert disc == appr
