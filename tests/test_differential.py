"""Differential test: every registered query against its DuckDB twin on a
random ``orders`` table with NULLs in every column the binding reads (so
NOT IN, NULL groups, NULL labels and NULL ordering are exercised), plus the
driver's own lineitem and events."""

import os
import random
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cohortlens.plans.registry import ORACLE, QUERIES
from conftest import SF001
from tools.oracle_check import compare, duck


@pytest.fixture(scope="module")
def random_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("random_sf")
    rnd = random.Random(2024)
    n = 4000
    keys = list(range(n))
    rnd.shuffle(keys)

    def maybe(v, p=0.03):
        return None if rnd.random() < p else v

    import datetime as dt
    prios = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    table = pa.table({
        "o_orderkey": pa.array([maybe(k, 0.01) for k in keys], pa.int64()),
        "o_custkey": pa.array([maybe(rnd.randint(0, 500)) for _ in keys], pa.int64()),
        "o_orderstatus": pa.array([maybe(rnd.choice("FOP")) for _ in keys], pa.string()),
        "o_totalprice": pa.array([maybe(round(rnd.uniform(900, 500000), 2)) for _ in keys], pa.float64()),
        "o_orderdate": pa.array([maybe(dt.datetime(1992, 1, 1) + dt.timedelta(days=rnd.randint(0, 2400)))
                                 for _ in keys], pa.timestamp("us")),
        "o_orderpriority": pa.array([maybe(rnd.choice(prios)) for _ in keys], pa.string()),
    })
    pq.write_table(table, os.path.join(d, "orders.parquet"))
    for name in os.listdir(SF001):
        if name != "orders.parquet":
            shutil.copy(os.path.join(SF001, name), os.path.join(d, name))
    return str(d)




@pytest.mark.parametrize("name", sorted(ORACLE))
def test_random_nulls_match_duckdb(spark, random_dir, name):
    ok, msg = compare(spark, random_dir, name, QUERIES[name], ORACLE[name], duck(random_dir))
    assert ok, msg
