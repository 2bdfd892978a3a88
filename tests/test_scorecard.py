from pyspark.sql import functions as F

from cohortlens.operators import filtered_statistics
from cohortlens.operators.scorecard import Check, scorecard, scorecard_summary
from cohortlens.plans import checks as K
from cohortlens.plans import study as S
from cohortlens.sources import coded_visits
from conftest import SF001
from fixture import visit, visits_df


def test_planted_fail_and_null_actual(spark):
    df = visits_df(spark, [visit(WAITTIME=10), visit(WAITTIME=20), visit(WAITTIME=30)])
    checks = [
        Check("rows", "count", 3, 0),
        Check("median", "median", 20, 0),
        Check("planted fail", "mean", 25, 1.0),
        Check("null actual", "median", 0, 100, where=F.col("ARREMS") == 99),
        Check("share", "share", 66.6667, 0.001, where=F.col("WAITTIME") >= 20),
    ]
    rows = scorecard(df, "WAITTIME", checks).collect()
    status = {r.label: r.status for r in rows}
    assert status == {"rows": "PASS", "median": "PASS", "planted fail": "FAIL", "null actual": "FAIL",
                      "share": "PASS"}
    assert [r.check_id for r in rows] == [1, 2, 3, 4, 5]
    s = scorecard_summary(scorecard(df, "WAITTIME", checks)).first()
    assert (s.passed, s.total, s.verdict) == (3, 5, "REVIEW")


def test_study_scorecard_statuses_follow_the_deltas(spark):
    """Each status equals an independent recomputation: |actual - expected|
    <= tolerance, with the actual re-derived by a separate query."""
    lv = S.labelled_visits(coded_visits(spark, SF001))
    rows = scorecard(lv, "WAITTIME", K.checks()).collect()
    assert len(rows) == 21
    stats = {r.label: r.value for r in filtered_statistics(lv, "WAITTIME", K.statistic_specs()).collect()}
    for r in rows:
        if r.label in stats:
            assert abs(r.actual - stats[r.label]) < 1e-9
        ok = r.actual is not None and abs(r.actual - r.expected) <= r.tolerance
        assert r.status == ("PASS" if ok else "FAIL"), r
    assert rows[0].actual == 1500.0 and rows[1].actual == 903.0
