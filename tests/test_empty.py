"""Operators on an empty visit table: empty results or zero counts, never
an error (a filter upstream can always leave nothing)."""

from cohortlens.operators import cardinality, frequency, top_values, waterfall
from cohortlens.operators.quantiles import exact_quantiles
from cohortlens.plans import steps as T
from cohortlens.plans import study as S
from fixture import visits_df


def test_empty_visits(spark):
    v = visits_df(spark, [])
    w = waterfall(v, S.TWO_LAYER_RULES).first()
    assert (w.total_records, w.clean_universe, w.clean_pct_of_total) == (0, 0, None)
    assert cardinality(v, S.CARDINALITY_COLUMNS).first().total_records == 0
    assert frequency(v, "ARREMS").count() == 0 and top_values(v, "WAITTIME").count() == 0
    assert exact_quantiles(v, ["ARREMS"], "WAITTIME", {"median": 0.5}).count() == 0
    clean = S.clean_universe(v)
    for dim in S.DIMENSIONS:
        assert S.dimension_contrast(clean, dim).count() == 0
    out = T.run_study(v)
    sc = out["scorecard"].collect()
    assert len(sc) == 21 and sc[0].actual == 0.0
    assert all(r.actual is None for r in sc if "median" in r.label or "mean" in r.label)
    assert out["final_universe"].first().total_records == 0
    assert out["gap_verdict"].count() == 0


def test_single_row_and_all_null_groups(spark):
    from cohortlens.operators import contrast
    df = spark.createDataFrame([(1, 1, 7), (1, 2, None), (1, 2, None)], "c int, l int, x int")
    stats = ("n", "n_valid", "avg", "min", "max", "median", "p25", "p75")
    for method in ("exact", "discrete", "percentile", "exact_sorted", "approx", "sketch"):
        rows = {r.l: r for r in contrast(df, "c", "l", "x", stats=stats, method=method).collect()}
        one, none = rows[1], rows[2]
        assert (one.n, one.n_valid, one.avg_wait_minutes, one.median_wait_minutes, one.p25_wait_minutes) == \
            (1, 1, 7.0, 7.0, 7.0), method
        assert (none.n, none.n_valid, none.avg_wait_minutes, none.min_wait_minutes, none.median_wait_minutes) == \
            (2, 0, None, None, None), method
