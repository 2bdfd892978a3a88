"""The coded binding reproduces the reconciliation figures documented for
sf0.01 (FIXTURES.md section 2): cohort sizes, clean universe, planted
sentinels and the cohort medians."""

from pyspark.sql import functions as F

from cohortlens.plans import study as S
from cohortlens.sources import coded_visits
from conftest import SF01


def test_binding_reconciles_at_sf001(spark):
    v = coded_visits(spark, SF01)
    assert v.count() == 15000
    arrems = {r.ARREMS: r["count"] for r in v.groupBy("ARREMS").count().collect()}
    assert arrems == {-9: 150, -8: 300, 1: 2400, 2: 12150}
    assert v.filter(F.col("WAITTIME") == 99).count() == 82
    clean = S.clean_universe(v)
    assert clean.count() == 9065
    arrtime = {r.ARRTIME: r["count"] for r in clean.filter(F.col("ARRTIME").isin(575, -9))
               .groupBy("ARRTIME").count().collect()}
    assert arrtime == {575: 12, -9: 11}
    boarded = clean.agg(F.count_if(F.col("BOARDED") == -8).alias("m8"), F.count_if(F.col("BOARDED") == 0).alias("z"),
                        F.count_if(F.col("BOARDED") > 0).alias("p")).first()
    assert (boarded.m8, boarded.z, boarded.p) == (9, 368, 424)
    med = {r.ARREMS: r.m for r in clean.groupBy("ARREMS").agg(F.percentile("WAITTIME", 0.5).alias("m")).collect()}
    assert med == {1: 91.0, 2: 94.0}
    cells = [r["count"] for r in clean.groupBy("ARREMS", "IMMEDR").count().collect()]
    assert (min(cells), max(cells)) == (254, 1534)
