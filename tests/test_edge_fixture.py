"""Edge fixture (FIXTURES.md section 4): one test per pinned-down point."""

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from cohortlens.operators import (cohort_rate, contrast, gap_table, gap_verdict, rate_ratio, top_values,
                                  waterfall)
from cohortlens.plans import study as S
from fixture import visit, visits_df


def test_nulls_are_dropped_by_not_in(spark):
    df = visits_df(spark, [visit(ARREMS=None), visit(WAITTIME=None), visit(IMMEDR=None), visit()])
    assert S.clean_universe(df).count() == 1
    w = waterfall(df, S.TWO_LAYER_RULES).first()
    assert (w.total_records, w.arrems_excluded, w.waittime_excluded, w.clean_universe) == (4, 0, 0, 2)


def test_unmapped_cohort_code_is_a_null_group(spark):
    df = visits_df(spark, [visit(ARREMS=3), visit(ARREMS=1), visit(ARREMS=2)])
    out = S.run_dimension(df, "distribution").collect()
    labels = sorted((r.arrival_method is None) for r in out)
    assert labels == [False, False, True]


def test_band_ranges_and_band_cuts(spark):
    times = [575, 1170, 1799, 2400, -9, 0, 559, 600, 2359]
    df = spark.createDataFrame([(t,) for t in times], "ARRTIME int")
    got = {r.ARRTIME: (r.rng, r.cut) for r in
           df.select("ARRTIME", S.time_band().alias("rng"), S.time_band_cuts().alias("cut")).collect()}
    for t in (575, 1170, 1799, 2400, -9):
        assert got[t][0] is None
    assert got[575][1].startswith("2 - Morning")
    assert got[1170][1].startswith("3 - Afternoon")
    assert got[1799][1].startswith("4 - Evening")
    assert got[2400][1] is None and got[-9][1] is None
    assert got[0] == ("1 - Overnight (0000-0559)",) * 2
    assert got[559][0] == got[559][1] == "1 - Overnight (0000-0559)"
    assert got[600][0] == got[600][1] == "2 - Morning (0600-1159)"
    assert got[2359][0] == got[2359][1] == "4 - Evening (1800-2359)"


def test_boarding_status_unmapped_is_null(spark):
    df = spark.createDataFrame([(-8,), (None,), (-7,), (-9,), (0,), (15,)], "BOARDED int")
    got = [r.s for r in df.select(S.boarding_status().alias("s")).collect()]
    assert got == [None, None, "Not Boarded", "Unknown", "Boarded - 0 min", "Boarded - >0 min"]


def test_waittime_99_excluded_neighbours_kept(spark):
    df = visits_df(spark, [visit(WAITTIME=98), visit(WAITTIME=99), visit(WAITTIME=100)])
    assert sorted(r.WAITTIME for r in S.clean_universe(df).collect()) == [98, 100]


def test_immedr_0_and_7_excluded(spark):
    df = visits_df(spark, [visit(IMMEDR=0), visit(IMMEDR=7), visit(IMMEDR=5)])
    assert [r.IMMEDR for r in S.clean_universe(df).collect()] == [5]


def test_pain_sentinels_in_contrast_not_in_gap(spark):
    rows = [visit(ARREMS=a, PAINSCALE=p) for a in (1, 2) for p in (-9, -8, 0, 10)]
    df = visits_df(spark, rows)
    con = S.run_dimension(df, "pain")
    assert {r.pain_score for r in con.collect()} == {-9, -8, 0, 10}
    gaps = gap_table(con.filter(F.col("pain_score").between(0, 10)), "pain_score", "arrival_method",
                     "median_wait_minutes", S.GAP_COHORTS)
    assert {r.pain_score for r in gaps.collect()} == {0, 10}


def test_single_cohort_level_gives_null_gap(spark):
    df = visits_df(spark, [visit(ARREMS=1, IMMEDR=1), visit(ARREMS=2, IMMEDR=1), visit(ARREMS=2, IMMEDR=2)])
    con = S.run_dimension(df, "distribution")
    g = {r.triage_level: r.gap for r in
         gap_table(con, "triage_level", "arrival_method", "median_wait_minutes", S.GAP_COHORTS).collect()}
    assert g["2 - Emergent"] is None and g["1 - Immediate"] == 0.0
    v = gap_verdict(gap_table(con, "triage_level", "arrival_method", "median_wait_minutes",
                              S.GAP_COHORTS)).first()
    assert v.n_missing == 1 and v.verdict == "mixed"


def test_top_k_ties_broken_by_value(spark):
    vals = [5, 5, 3, 3, 9, 9, 1]
    df = spark.createDataFrame([(v,) for v in vals], "x int")
    got = [(r.value, r.rank) for r in top_values(df, "x", k=2).orderBy("rank").collect()]
    assert got == [(3, 1), (5, 2)]


def test_rate_ratio_with_empty_cohort_is_null(spark):
    df = visits_df(spark, [visit(ARREMS=2, BOARDED=0), visit(ARREMS=2, BOARDED=-7)])
    cu = S.clean_universe(df)
    rr = rate_ratio(cu, "ARREMS", F.col("boarding_status").isin(S.BOARDED_STATUSES), 1, 2).first()
    assert rr.total_a == 0 and rr.rate_a_pct is None and rr.rate_ratio is None
    assert rr.rate_b_pct == 50.0
    rates = cohort_rate(cu, "ARREMS", F.col("boarding_status").isin(S.BOARDED_STATUSES)).collect()
    assert [(r.hits, r.total, r.rate_pct) for r in rates] == [(1, 2, 50.0)]


def test_quartile_at_quarter_rounds_half_up(spark):
    # four values 1, 2, 3, 4 -> p25 = 1.75; values 1, 1, 2, 3, 9 -> p25 = 1.0;
    # values 1, 2 -> p25 = 1.25 -> HALF_UP 1.3 (half-even would give 1.2)
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 2)], "c int, l int, x int")
    out = contrast(df, "c", "l", "x", stats=("n", "p25", "median", "avg")).first()
    assert out.p25_wait_minutes == 1.3
    assert out.median_wait_minutes == 1.5
    assert out.avg_wait_minutes == 1.5
    assert float(Decimal("1.25").quantize(Decimal("0.1"), ROUND_HALF_UP)) == out.p25_wait_minutes


def test_drop_unlabelled_is_the_pandas_flavour(spark):
    df = visits_df(spark, [visit(ARREMS=3), visit(ARREMS=1), visit(ARREMS=2, IMMEDR=5)])
    cu = S.clean_universe(df)
    kept = contrast(cu, "ARREMS", "IMMEDR", "WAITTIME", cohort_labels=S.ARRIVAL_LABELS,
                    level_labels=S.TRIAGE_LABELS, cohort_name="arrival_method", level_name="triage_level")
    dropped = contrast(cu, "ARREMS", "IMMEDR", "WAITTIME", cohort_labels=S.ARRIVAL_LABELS,
                       level_labels=S.TRIAGE_LABELS, cohort_name="arrival_method", level_name="triage_level",
                       drop_unlabelled=True)
    assert kept.count() == 3 and dropped.count() == 2


def test_approximate_cardinality_is_close(spark):
    from cohortlens.operators import cardinality
    df = spark.range(0, 50000).select((F.col("id") % 1000).alias("a"), (F.col("id") % 7).alias("b"))
    exact = cardinality(df, ["a", "b"]).first()
    approx = cardinality(df, ["a", "b"], approx=True).first()
    assert (exact.distinct_a, exact.distinct_b) == (1000, 7)
    assert abs(approx.distinct_a - 1000) <= 30 and approx.distinct_b == 7


def test_gap_table_is_deterministic_when_codes_share_a_label(spark):
    rows = [visit(ARREMS=1, REGION=0, WAITTIME=10), visit(ARREMS=1, REGION=5, WAITTIME=40),
            visit(ARREMS=2, REGION=0, WAITTIME=20), visit(ARREMS=2, REGION=1, WAITTIME=30)]
    con = S.run_dimension(visits_df(spark, rows), "region")
    g = {r.census_region: (r.ambulance, r.walk_in, r.gap) for r in
         gap_table(con, "census_region", "arrival_method", "median_wait_minutes", S.GAP_COHORTS).collect()}
    assert g[None] == (40.0, 20.0, 20.0)


def test_decode_with_table_matches_case_decode(spark):
    import pytest
    from cohortlens.functions.labels import decode_codes
    from cohortlens.operators import decode_with_table
    df = visits_df(spark, [visit(IMMEDR=i) for i in (1, 2, 3, 4, 5, 0, 9)])
    book = spark.createDataFrame(list(S.TRIAGE_LABELS.items()), "code int, label string")
    got = decode_with_table(df, "IMMEDR", book, "code", "label", "triage_level")
    want = df.withColumn("triage_level", decode_codes("IMMEDR", S.TRIAGE_LABELS))
    assert sorted(got.select("IMMEDR", "triage_level").collect(), key=repr) == \
        sorted(want.select("IMMEDR", "triage_level").collect(), key=repr)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    dup = spark.createDataFrame([(1, "a"), (1, "b")], "code int, label string")
    with pytest.raises(ValueError):
        decode_with_table(df, "IMMEDR", dup, "code", "label", "x")


def test_layers_on_the_same_column_accumulate(spark):
    from cohortlens.operators import layer_accounting
    df = visits_df(spark, [visit(IMMEDR=c) for c in (0, 7, 1, 2)])
    rows = layer_accounting(df, [("no triage 0", {"IMMEDR": [0]}), ("it's 7", {"IMMEDR": [7]})]).collect()
    assert [(r.layer, r.rows_remaining, r.rows_removed) for r in rows] == \
        [("start", 4, 0), ("no triage 0", 3, 1), ("it's 7", 2, 1)]
