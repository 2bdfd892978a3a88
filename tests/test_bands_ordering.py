"""Band tables and distributed order."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.labels import band_ranges
from cohortlens.operators import bands as B
from cohortlens.operators.ordering import numbered, with_previous
from cohortlens.plans import study as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_bands(rnd, n):
    ends = sorted(rnd.sample(range(-10_000, 10_000), 2 * n))
    return [(a, b, f"b{i}") for i, (a, b) in enumerate(zip(ends[::2], ends[1::2]))]


def test_stretches_cover_each_band_exactly(spark):
    rnd = random.Random(1)
    bands = random_bands(rnd, 40) + [(20_000, 20_000, "one"), (1 << 40, (1 << 41) + 12345, "long"), (-(1 << 60), -(1 << 59), "low")]
    cut = B._stretches(spark.createDataFrame(bands, "low long, high long, label string")).collect()
    for low, high, label in bands:
        own = sorted((r["_start"], r["_level"]) for r in cut if r.label == label)
        at = low
        for start, level in own:
            assert start == at and start % (1 << level) == 0
            at = start + (1 << level)
        assert at == high + 1 and len(own) <= 2 * B._LEVELS


@pytest.mark.parametrize("n", [1, 60, 700])
def test_lookup_equals_the_case_form(spark, n):
    rnd = random.Random(n)
    bands = random_bands(rnd, n)
    values = [rnd.randint(-11_000, 11_000) for _ in range(4000)] + [b[0] for b in bands] + [b[1] for b in bands] + [None] * 5 + [7] * 2000
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, label int").repartition(4)
    got = B.band_lookup(df, "v", spark.createDataFrame(bands, "low long, high long, label string"), "band")
    assert got.columns == ["v", "label", "band"]
    want = df.withColumn("band", band_ranges("v", bands)) if n < 100 else None
    if want is not None:
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    for r in got.collect():
        own = [lab for lo, hi, lab in bands if r.v is not None and lo <= r.v <= hi]
        assert r.band == (own[0] if own else None)
    text = plan(got)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_shuffled_lookup_of_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(B, "BROADCAST_ROW_LIMIT", 10)
    bands = random_bands(random.Random(3), 300)
    df = spark.range(-10_500, 10_500).select(F.col("id").alias("v"))
    got = B.band_lookup(df, "v", spark.createDataFrame(bands, "low long, high long, label string"), "band")
    assert got.count() == 21_000
    assert got.filter("band IS NOT NULL").count() == sum(b - a + 1 for a, b, _ in bands)


def test_check_finds_overlaps_gaps_and_bad_bounds(spark):
    make = lambda rows: spark.createDataFrame(rows, "low long, high long, label string")
    whole = make([(0, 9, "a"), (10, 19, "b"), (20, 20, "c")])
    assert B.check_bands(whole).count() == 0
    odd = make([(0, 9, "a"), (9, 12, "b"), (15, 20, "c"), (30, 25, "d"), (None, 3, "e")])
    got = {(r.problem, r.label, r.previous_label) for r in B.check_bands(odd).collect()}
    assert got == {("overlap", "b", "a"), ("gap", "c", "b"), ("empty", "d", None), ("open", "e", None)}
    with pytest.raises(ValueError, match="overlap at 9..12"):
        B.band_lookup(spark.range(3), "id", odd, "x")
    study = make([(lo, hi, lab) for lo, hi, lab in S.TIME_BANDS])
    assert {r.problem for r in B.check_bands(study).collect()} <= {"gap"}


def test_empty_bands_and_values(spark):
    bands = spark.createDataFrame([(0, 5, "a")], "low long, high long, label string")
    df = spark.range(3)
    assert {r.band for r in B.band_lookup(df, "id", bands.limit(0), "band").collect()} == {None}
    assert B.band_lookup(df.limit(0), "id", bands, "band").count() == 0


def test_numbering_matches_a_window_without_one(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.randint(0, 50), i) for i in range(5000)] + [("a", 7, 9000 + i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, n int, id int").repartition(6)
    got = numbered(df, [F.asc_nulls_first("g"), F.desc("n"), F.asc("id")])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1], r[2]))
    assert [(r.g, r.n, r.id) for r in sorted(got.collect(), key=lambda r: r.position)] == want
    assert sorted(r.position for r in got.collect()) == list(range(1, len(rows) + 1))
    # rows of equal order are numbered too, each once
    tied = numbered(df.select("g"), [F.asc_nulls_first("g")])
    assert sorted(r.position for r in tied.collect()) == list(range(1, len(rows) + 1))
    assert numbered(df.limit(0), [F.asc("id")]).count() == 0


def test_rows_before(spark):
    rows = [(i * 3 % 101, f"s{i * 3 % 101}") for i in range(101)]
    df = spark.createDataFrame(rows, "x int, s string").repartition(5)
    got = {r.x: (r.previous_x, r.previous_s) for r in with_previous(df, ["x"], ["x", "s"]).collect()}
    assert got == {i: (i - 1, f"s{i - 1}") if i else (None, None) for i in range(101)}
