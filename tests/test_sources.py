from cohortlens.session import scratch_dir
from cohortlens.sources import coded_visits, column_inventory, csv_round_trip, validate_schema
from cohortlens.sources.csv import VISIT_SCHEMA
from conftest import SF001


def test_csv_round_trip_lands_under_checkpoint_dir(spark):
    v = coded_visits(spark, SF001)
    back = csv_round_trip(spark, v, VISIT_SCHEMA)
    base = scratch_dir(spark)
    assert any(base.rstrip("/").split("://")[-1] in p for p in back.inputFiles())
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect()))


def test_inventory_and_validation(spark):
    v = coded_visits(spark, SF001)
    inv = column_inventory(v).collect()
    assert [r.ordinal_position for r in inv] == list(range(1, 16))
    bad = validate_schema(v, {"ARREMS": "int", "PATWT": "int", "NOPE": "int"}).collect()
    assert {r.column_name: r.ok for r in bad} == {"ARREMS": True, "PATWT": False, "NOPE": False}


def test_binding_scan_prunes_columns(spark):
    plan = coded_visits(spark, SF001).select("ARREMS")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_csv_with_inferred_types(spark):
    from cohortlens.sources.csv import read_visits_csv
    v = coded_visits(spark, SF001)
    back = csv_round_trip(spark, v, VISIT_SCHEMA)
    inferred = read_visits_csv(spark, back.inputFiles()[0].rsplit("/", 1)[0], schema=None)
    assert dict(inferred.dtypes)["ARREMS"] == "int" and dict(inferred.dtypes)["PATWT"] == "double"
    assert inferred.count() == v.count()


def test_stored_visits_get_pushdown_and_pruning(spark):
    from cohortlens.plans.registry import QUERIES
    df = QUERIES["distribution_contrast_stored"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    start = plan.index("PushedFilters: [")
    pushed = plan[start:plan.index("ReadSchema", start)]
    for col in ("ARREMS", "WAITTIME", "IMMEDR"):
        assert f"Not(In({col}, [" in pushed
    assert "ReadSchema: struct<WAITTIME:int,ARREMS:int,IMMEDR:int>" in plan
    assert sum(r.n for r in df.collect()) == 903


def test_n_valid_counts_non_null_measure(spark):
    from cohortlens.operators import contrast
    df = spark.createDataFrame([(1, 1, 5), (1, 1, None), (1, 1, 7)], "c int, l int, x int")
    r = contrast(df, "c", "l", "x", stats=("n", "n_valid", "avg")).first()
    assert (r.n, r.n_valid, r.avg_wait_minutes) == (3, 2, 6.0)


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Context:
    def __init__(self):
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    def __init__(self, values):
        self.conf = _Conf(values)
        self.sparkContext = _Context()


def test_scratch_dir_uses_the_configured_shared_folder():
    s = _Session({"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    path = scratch_dir(s, "csv")
    assert path.startswith("hdfs:///shared/ckpt/csv/")
    assert scratch_dir(s, "csv") != path                     # a fresh folder every time
    assert s.sparkContext.dir == "hdfs:///shared/ckpt"        # checkpoint() writes there too
    assert s.conf.get("spark.checkpoint.dir") == "hdfs:///shared/ckpt"  # never overridden


def test_scratch_dir_sets_a_local_folder_only_when_unset():
    s = _Session({"spark.master": "local[2]"})
    base = scratch_dir(s)
    assert base and s.conf.get("spark.checkpoint.dir") == base
    assert scratch_dir(s) == base                              # set once, then read back


def test_scratch_dir_off_a_local_master_must_be_named():
    import pytest
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_dir(_Session({"spark.master": master}))
