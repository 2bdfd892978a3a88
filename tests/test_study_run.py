"""A whole study run reads every dimension step off one shared statistics
table; its outputs must equal the standalone steps exactly (same order)."""

from cohortlens.plans import steps as T
from cohortlens.plans import study as S
from cohortlens.sources import coded_visits
from conftest import SF001


def test_shared_statistics_equal_standalone_steps(spark):
    visits = coded_visits(spark, SF001)
    clean = S.clean_universe(visits)
    shared = T.run_study(visits, steps=list(T.SHARED_STEPS))
    for name in T.SHARED_STEPS:
        alone = T.STEPS[name](visits, clean)
        got = shared[name]
        assert got.columns == alone.columns, name
        assert dict(got.dtypes) == dict(alone.dtypes), name
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in alone.collect()], name


def test_shared_run_scans_the_source_once_for_all_dimensions(spark):
    visits = coded_visits(spark, SF001)
    out = T.run_study(visits, steps=["distribution_contrast", "regional_contrast", "gap_verdict"])
    for df in out.values():
        files = df.inputFiles()
        assert files and all("study-statistics" in f for f in files)  # the stored table only, no rescan


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_profile_steps_from_one_count_table_equal_standalone(spark):
    from cohortlens.plans import profiles as PR
    from fixture import visit, visits_df
    import random
    rnd = random.Random(5)
    extra = [visit(ARREMS=rnd.choice([None, 3, -9, 1]), WAITTIME=rnd.choice([None, 99, -7, 5]),
                   IMMEDR=rnd.choice([None, 0, 7, 2]), ARRTIME=rnd.choice([None, 575, 2400, 1000]),
                   BOARDED=rnd.choice([None, -8, 0, 5])) for _ in range(300)]
    for visits in (coded_visits(spark, SF001), coded_visits(spark, SF001).unionByName(visits_df(spark, extra))):
        clean = S.clean_universe(visits)
        counts = PR.profile_counts(visits)
        for name, fn in PR.FROM_COUNTS.items():
            got, alone = fn(visits, counts), T.STEPS[name](visits, clean)
            assert got.columns == alone.columns, name
            assert dict(got.dtypes) == dict(alone.dtypes), name
            assert _rows(got) == _rows(alone), name


def test_whole_study_run_shared_equals_standalone(spark):
    visits = coded_visits(spark, SF001)
    shared = T.run_study(visits)
    alone = T.run_study(visits, shared=False)
    assert list(shared) == list(alone)
    for name in shared:
        assert shared[name].columns == alone[name].columns, name
        assert _rows(shared[name]) == _rows(alone[name]), name
