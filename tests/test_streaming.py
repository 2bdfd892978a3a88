import pytest

from cohortlens.plans import study as S
from cohortlens.session import scratch_dir
from cohortlens.sources import coded_visits
from cohortlens.streaming import finish_batch, incremental_contrast, start, visit_stream
from conftest import SF001


@pytest.fixture(scope="module")
def visit_files(spark):
    path = scratch_dir(spark, "test-visit-files")
    coded_visits(spark, SF001).repartition(5).write.parquet(path)
    return path


@pytest.mark.parametrize("dimension", ["distribution", "region", "time_of_day"])
def test_incremental_equals_batch(spark, visit_files, dimension):
    stream = visit_stream(spark, visit_files, max_files_per_trigger=1)
    q = start(incremental_contrast(stream, dimension), f"inc_{dimension}")
    q.awaitTermination(180)
    assert len(q.recentProgress) >= 5  # one micro-batch per file
    got = sorted((tuple(r) for r in spark.table(f"inc_{dimension}").collect()), key=repr)
    want = sorted((tuple(r) for r in S.run_dimension(coded_visits(spark, SF001), dimension).collect()), key=repr)
    assert got == want


def test_parquet_sink(spark, visit_files):
    out = scratch_dir(spark, "test-stream-sink")
    q = start(incremental_contrast(visit_stream(spark, visit_files), "core"), "inc_core_sink", sink_path=out)
    q.awaitTermination(180)
    assert spark.read.parquet(out).count() == 10


def test_boarding_streams_with_a_per_batch_share(spark, visit_files):
    out = scratch_dir(spark, "test-stream-boarding")
    stream = visit_stream(spark, visit_files, max_files_per_trigger=2)
    q = start(incremental_contrast(stream, "boarding"), "inc_boarding", sink_path=out,
              finish=finish_batch("boarding"))
    q.awaitTermination(180)
    got = spark.read.parquet(out)
    want = S.run_dimension(coded_visits(spark, SF001), "boarding")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_finish_needs_a_sink(spark, visit_files):
    with pytest.raises(ValueError):
        start(incremental_contrast(visit_stream(spark, visit_files), "boarding"), "x",
              finish=finish_batch("boarding"))
