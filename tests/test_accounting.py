"""Row accounting with NULLs, and what a session may not override."""

import pytest

from cohortlens.operators import profile as P
from cohortlens.operators.rules import waterfall
from cohortlens.session import scratch_dir


def test_waterfall_balances_with_nulls(spark):
    rows = [(1, 5, 1), (-9, 5, 1), (-9, -7, 0), (None, 5, 1), (1, None, None), (None, -7, 1), (2, 8, 0), (-9, None, 0), (None, None, None)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    rules = {"a": [-9], "b": [-7], "c": [0]}
    w = waterfall(df, rules).first()
    caught = w.a_excluded + w.b_excluded + w.c_excluded
    assert (w.total_records, w.a_excluded, w.b_excluded, w.c_excluded) == (9, 3, 2, 3)
    assert w.null_excluded == 3
    assert w.total_records - caught + w.overlap_correction - w.null_excluded == w.clean_universe == 1


def test_null_code_counts_as_excluded(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (-9,)], "code int")
    out = {r.category: r.n for r in P.profile_subtotals(P.frequency(df, "code"), "value", [-9]).collect()}
    assert out == {"legitimate": 2, "excluded": 2}


def test_top_values_need_no_single_partition_sort(spark):
    df = spark.range(20000).selectExpr("id % 7000 AS v")
    top = P.top_values(df, "v", 5000)
    assert [r["rank"] for r in top.orderBy("rank").collect()] == list(range(1, 5001))
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


class _Conf:
    def __init__(self, **kw):
        self.kw = kw

    def get(self, key, default=None):
        return self.kw.get(key, default)


def test_no_local_scratch_on_a_cluster():
    class Cluster:
        conf = _Conf(**{"spark.master": "spark://host:7077"})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Cluster())
