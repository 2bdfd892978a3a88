import __spark_entry__ as entry


def test_entry_runs_with_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["arrival_method", "triage_level", "n", "avg_wait_minutes", "median_wait_minutes",
                          "p25_wait_minutes", "p75_wait_minutes"]
    rows = df.collect()
    assert len(rows) == 10
    assert sum(r.n for r in rows) == 903  # clean universe at sf0.001 (FIXTURES.md)


def test_registry_names_are_plain():
    for name in entry.queries():
        assert name.isidentifier()
