"""Footer catalogs, statistics reads, bitmaps, proven top-k."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import distinct as D
from cohortlens.operators import heavy as H
from cohortlens.operators import profile as P
from cohortlens.sources import footers as FT
from cohortlens.sources import statistics as ST


@pytest.fixture
def drifting(tmp_path):
    """Three like files in partition folders, one with another type, one
    without a column, one with one more, one that is no Parquet file."""
    def put(at, **columns):
        path = tmp_path / at
        path.parent.mkdir(exist_ok=True)
        pq.write_table(pa.table(columns), path)
    for day in (1, 2, 3):
        put(f"day={day}/part.parquet", id=pa.array([1, 2, None]), name=pa.array(["a", "b", "c"]))
    put("day=4/a.parquet", id=pa.array(["1", "2"]), name=pa.array(["a", None]))
    put("day=4/b.parquet", id=pa.array([7]))
    put("day=5/c.parquet", id=pa.array([8]), name=pa.array(["z"]), more=pa.array([[1.5]], pa.list_(pa.float64())))
    (tmp_path / "day=5" / "cut.parquet").write_bytes(b"PAR1 no table")
    return str(tmp_path)


def test_inventory_and_drift_of_a_folder(spark, drifting):
    found = FT.file_footers(spark, drifting)
    rows = {(r.column_name, r.data_type): r for r in FT.stored_inventory(found).collect()}
    assert set(rows) == {("id", "bigint"), ("id", "string"), ("name", "string"), ("more", "array<double>")}
    r = rows["id", "bigint"]
    assert (r.n_files, r.n_rows, r.null_count, r.ordinal_position) == (5, 11, 3, 1)
    assert rows["name", "string"].null_count == 1 and rows["more", "array<double>"].null_count is None
    drift = {(r.column_name, r.data_type): (r.n_files, r.all_files) for r in FT.schema_drift(found).collect()}
    problem = next(k for k in drift if k[0] is None)
    assert problem[1] and drift.pop(problem) == (1, None)
    assert drift == {("id", "bigint"): (5, 6), ("id", "string"): (1, 6), ("name", "string"): (5, 6), ("name", None): (1, 6),
                     ("more", "array<double>"): (1, 6), ("more", None): (5, 6)}
    assert {r.least_file.rsplit("/", 1)[1] for r in FT.schema_drift(found).filter("column_name = 'name' AND data_type IS NULL")
            .collect()} == {"b.parquet"}


def test_no_drift_in_like_files(spark, drifting):
    found = FT.file_footers(spark, *[f"{drifting}/day={d}" for d in (1, 2, 3)])
    assert FT.schema_drift(found).count() == 0
    ok = {r.column_name: (r.data_type, r.ok) for r in FT.validate_stored(found, {"id": "bigint", "name": "int", "gone": "int"}).collect()}
    assert ok == {"id": ("bigint", True), "name": ("string", False), "gone": (None, False)}


def test_required_and_validated_columns_of_a_drifting_folder(spark, drifting):
    found = FT.file_footers(spark, drifting)
    got = {r.column_name: (r.present, r.n_files, r.missing_files) for r in FT.required_stored(found, ["id", "name", "gone"]).collect()}
    assert got == {"id": (True, 6, 0), "name": (False, 5, 1), "gone": (False, 0, 6)}
    assert not any(r.ok for r in FT.validate_stored(found, {"id": "bigint", "name": "string"}).collect())


def test_footers_read_no_data_page(spark, tmp_path):
    """With every data page overwritten, catalog and statistics still answer."""
    path = str(tmp_path / "t.parquet")
    n = 50_000
    pq.write_table(pa.table({"a": pa.array([None if i % 10 == 0 else i for i in range(n)]), "b": pa.array([i / 4 for i in range(n)]),
                             "s": pa.array([str(i) for i in range(n)])}), path)
    meta = pq.read_metadata(path)
    end = os.path.getsize(path) - meta.serialized_size - 8
    with open(path, "r+b") as f:
        f.seek(4)
        f.write(b"\xff" * (end - 4))
    got = {r.column_name: r for r in ST.ranges(ST.read(spark, path)).collect()}
    assert (got["a"].n_rows, got["a"].n_values, got["a"].null_count, got["a"].min_value, got["a"].max_value) == (n, n * 9 // 10, n // 10, 1, n - 1)
    assert (got["b"].min_value, got["b"].max_value, got["s"].n_values, got["s"].min_value) == (0.0, (n - 1) / 4, n, None)
    assert {r.n_rows for r in FT.stored_inventory(FT.file_footers(spark, path)).collect()} == {n}
    with pytest.raises(Exception):
        spark.read.parquet(path).agg(F.sum("a")).collect()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_push_down_is_in_the_plan_and_falls_back(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select("id", (F.col("id") % 7).cast("int").alias("c"), F.lit("x").alias("s")).write.parquet(path)
    t = ST.read(spark, path)
    whole = ST.ranges(t, ["id", "c"])
    assert "PushedAggregation: [COUNT(*), COUNT(id), COUNT(c), MIN(id), MAX(id), MIN(c), MAX(c)]" in plan(whole)
    assert [tuple(r) for r in whole.collect()] == [("id", 1000, 1000, 0, 0.0, 999.0), ("c", 1000, 1000, 0, 0.0, 6.0)]
    some = ST.ranges(t.filter("id >= 500"), ["id"])
    assert "PushedAggregation: []" in plan(some)
    assert [tuple(r) for r in some.collect()] == [("id", 500, 500, 0, 500.0, 999.0)]
    assert [tuple(r) for r in ST.ranges(t.filter("id < 0")).collect()] == [
        ("id", 0, 0, 0, None, None), ("c", 0, 0, 0, None, None), ("s", 0, 0, 0, None, None)]
    # the caller's session is as it was
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_bitmaps_count_and_merge(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice([None, rnd.randint(-70_000, 70_000), rnd.randint(-9, 9)]), rnd.choice([-9, -8, 0, 7]))
            for _ in range(4000)]
    df = spark.createDataFrame(rows, "day int, x long, c int").repartition(6)
    state = D.distinct_state(df, ["x", "c"], "day")
    assert "Expand" not in plan(state)
    want = tuple(df.agg(F.count(F.lit(1)), F.count_distinct("x"), F.count_distinct("c")).first())
    assert tuple(D.distinct_counts(state, ["x", "c"]).first()) == want
    # states of single days, kept apart, merge to the whole
    for day in ("day = 1", "day = 2", "day = 3", "day IS NULL"):
        D.distinct_state(df.filter(day), ["x", "c"], "day").write.mode("append").parquet(str(tmp_path / "s"))
    kept = spark.read.parquet(str(tmp_path / "s"))
    assert tuple(D.distinct_counts(kept, ["x", "c"]).first()) == want
    some = df.filter("day IN (1, 3)")
    assert tuple(D.distinct_counts(kept.filter("part IN (1, 3)"), ["x", "c"]).first()) == tuple(
        some.agg(F.count(F.lit(1)), F.count_distinct("x"), F.count_distinct("c")).first())
    assert tuple(D.distinct_counts(D.distinct_state(df.limit(0), ["x"]), ["x"]).first()) == (0, 0)
    with pytest.raises(TypeError):
        D.distinct_state(df.selectExpr("cast(x AS string) AS x"), ["x"])


@pytest.mark.parametrize("buckets,first", [(H.BUCKETS, None), (8, 1), (64, 2), (1, 1)])
def test_heavy_hitters_equal_the_profile(spark, buckets, first):
    rnd = random.Random(buckets)
    values = [None if rnd.random() < 0.05 else f"v{int(rnd.paretovariate(0.8))}" for _ in range(5000)] + [f"u{i}" for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    for k in (1, 5, 20, 100_000):
        got = H.heavy_hitters(df, "v", k, buckets=buckets, first_buckets=first)
        want = P.top_values(df, "v", k)
        assert got.drop("others_at_most").collect() == want.collect()
        r = got.collect()
        if len(r) == k:
            assert all(x.n > x.others_at_most for x in r)


def test_heavy_hitters_edges(spark):
    df = spark.createDataFrame([(None,), (None,), (3,)], "v int")
    assert [(r.value, r.n, r["rank"]) for r in H.heavy_hitters(df, "v", 5).collect()] == [(None, 2, 1), (3, 1, 2)]
    assert H.heavy_hitters(df.limit(0), "v", 5).collect() == []
