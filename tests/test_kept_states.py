"""Histogram cube, maintained statistics, observed scorecard."""

import random
import shutil
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import rules as R
from cohortlens.operators.cube import HistogramCube
from cohortlens.operators.maintained import MaintainedStatistics
from cohortlens.operators.scorecard import scorecard
from cohortlens.plans import checks as K
from cohortlens.plans import study as S
from cohortlens.plans.observed import observed_store
from cohortlens.sources import coded_visits
from conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def filtered(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 2]), rnd.choice(["a", "b", None]), rnd.choice([1, 2, None]), rnd.choice(["x", "y"]),
             rnd.choice([None, rnd.randint(0, 30)])) for _ in range(1500)]
    return spark.createDataFrame(rows, "k int, f string, g int, h string, v int")


def test_cube_answers_every_filter_combination(spark, filtered):
    cube = HistogramCube.build(filtered, ["k"], ["f", "g", "h"], "v")
    values = {"f": ["a", "b", None], "g": [1, 2, None], "h": ["x", "y"]}
    asked = 0
    for n in range(4):
        for names in combinations(values, n):
            for pick in (0, -1):
                where = {c: values[c][pick] for c in names}
                rows = filtered
                for c, v in where.items():
                    rows = rows.filter(F.col(c).eqNullSafe(F.lit(v)))
                want = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"), F.sum("v").alias("total"),
                                             F.min("v").alias("min"), F.max("v").alias("max"), F.percentile("v", 0.5).alias("median"))
                got = cube.statistics(where)
                assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), where
                asked += 1
    assert asked == 16
    by = cube.statistics({"h": "x"}, by=["g"])
    want = filtered.filter("h = 'x'").groupBy("k", "g").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(by.select("k", "g", "n").collect(), key=str) == sorted(want.collect(), key=str)
    with pytest.raises(ValueError, match="no filter"):
        cube.statistics({"z": 1})


def test_cube_reads_the_source_once_and_one_folder_each(spark, filtered, tmp_path):
    src = str(tmp_path / "src")
    filtered.write.parquet(src)
    cube = HistogramCube.build(spark.read.parquet(src), ["k"], ["f", "g", "h"], "v", str(tmp_path / "cube"))
    shutil.rmtree(src)                                     # nothing reads it any more
    got = cube.slice({"f": "a", "g": 1})
    assert got.count() > 0
    text = plan(cube.slice({"f": "a", "g": 1}))
    assert "PartitionFilters: [isnotnull(_set" in text and "EqualTo(f,a)" in text and "src" not in text.replace("pytest", "")


def test_cube_of_an_empty_table(spark, filtered):
    cube = HistogramCube.build(filtered.limit(0), ["k"], ["f"], "v")
    assert cube.everything().count() == 0 and cube.statistics({"f": "a"}).count() == 0


@pytest.fixture
def table(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(d, rnd.choice([1, 2]), rnd.choice([1, 2, 3, None]), rnd.choice([None, rnd.randint(0, 99)])) for d in range(6) for _ in range(300)]
    df = spark.createDataFrame(rows, "day int, c int, l int, v int")
    src = str(tmp_path / "table")

    def put(some):
        some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(src)
    kept = MaintainedStatistics(spark, src, str(tmp_path / "state"), "day", "c", {"level": "l"}, "v")
    return df, src, put, kept


def full(spark, src):
    df = spark.read.parquet(src)
    return sorted(map(tuple, df.groupBy(F.col("c").alias("cohort"), F.col("l").cast("string").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.count("v"), F.sum("v"), F.min("v"), F.max("v"), F.percentile("v", 0.5)).collect()), key=str)


def now(kept):
    return sorted(map(tuple, kept.statistics("level").collect()), key=str)


def test_states_follow_added_rewritten_and_deleted_partitions(spark, table):
    df, src, put, kept = table
    with pytest.raises(ValueError, match="no state"):
        kept.statistics("level")
    put(df.filter("day < 3"))
    assert kept.refresh() == {"read": ["0", "1", "2"], "kept": [], "dropped": []}
    assert now(kept) == full(spark, src)
    assert kept.refresh()["read"] == [] and now(kept) == full(spark, src)          # nothing changed, nothing read
    put(df.filter("day IN (3, 4)"))
    assert kept.refresh() == {"read": ["3", "4"], "kept": ["0", "1", "2"], "dropped": []}
    assert now(kept) == full(spark, src)
    put(df.filter("day = 1").withColumn("v", F.col("v") + 1000))                    # rewritten
    assert kept.refresh()["read"] == ["1"] and now(kept) == full(spark, src)
    shutil.rmtree(f"{src}/day=2")                                                   # deleted
    assert kept.refresh() == {"read": [], "kept": ["0", "1", "3", "4"], "dropped": ["2"]}
    assert now(kept) == full(spark, src)


def test_a_broken_refresh_leaves_the_old_states_in_force(spark, table, monkeypatch):
    df, src, put, kept = table
    put(df.filter("day < 2"))
    kept.refresh()
    before = now(kept)
    put(df.filter("day IN (1, 2, 3)").withColumn("v", F.col("v") * 2))
    real, calls = kept._counts, []

    def failing(rows):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(rows)
    monkeypatch.setattr(kept, "_counts", failing)
    with pytest.raises(RuntimeError):
        kept.refresh()
    assert now(kept) == before
    monkeypatch.setattr(kept, "_counts", real)
    assert kept.refresh()["read"] == ["3"]          # what was written before the failure is taken up
    assert now(kept) == full(spark, src)


def test_observed_figures_equal_the_waterfall_and_pass(spark):
    visits = coded_visits(spark, SF001)
    base = observed_store(visits)
    want = R.waterfall(visits, S.TWO_LAYER_RULES).first().asDict()
    assert base.waterfall and all(want[k] == v for k, v in base.waterfall.items())
    assert base.waterfall["total_records"] == visits.count() == base.stored.count()
    assert set(base.expected) == {c.label for c in K.checks()} and None not in base.expected.values()
    rows = scorecard(base.stored, "WAITTIME", K.checks(base.expected)).collect()
    assert {r.status for r in rows if "median" not in r.label} == {"PASS"}


def test_a_planted_error_fails_each_kind_of_check(spark, tmp_path):
    base = observed_store(coded_visits(spark, SF001))

    def failed(damaged):
        path = str(tmp_path / f"d{len(list(tmp_path.iterdir()))}")
        damaged.write.parquet(path)
        rows = scorecard(spark.read.parquet(path), "WAITTIME", K.checks(base.expected)).collect()
        kinds = {c.label: c.kind for c in K.checks()}
        return {kinds[r.label] for r in rows if r.status == "FAIL"}

    good = failed(base.stored) - {"median"}          # exact against observed medians may differ by over a minute here
    assert good == set()
    assert "count" in failed(base.stored.filter("rand(1) < 0.999"))                                   # lost rows
    assert {"count", "share"} <= failed(base.stored.filter("NOT in_clean OR rand(1) < 0.9"))           # lost clean rows
    assert "mean" in failed(base.stored.withColumn("WAITTIME", F.when(F.col("REGION") == 1, F.col("WAITTIME") + 2).otherwise(F.col("WAITTIME"))))
    assert "median" in failed(base.stored.withColumn("WAITTIME", F.col("WAITTIME") + 5))
    assert "share" in failed(base.stored.withColumn("boarding_status", F.when(F.col("ARREMS") == 1, F.lit("Not Boarded")).otherwise(F.col("boarding_status"))))
