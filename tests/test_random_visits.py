"""Every study step against its DuckDB twin on random visit tables with
NULLs in every column and codes outside every codebook (unmapped arrival
and region codes, HHMM values in the band gaps, BOARDED -8, pain -9/-8)."""

import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from cohortlens.plans.oracle import VISITS_CTE
from cohortlens.plans.steps import STEPS
from cohortlens.sources.csv import VISIT_SCHEMA
from tools.oracle_check import canonical

ORACLE = entry.oracle_sql()
NAMES = sorted(n for n in ORACLE if n in STEPS and n != "csv_scan")


def _random_visits(seed: int, n: int = 3000) -> list[tuple]:
    rnd = random.Random(seed)

    def maybe(v, p=0.04):
        return None if rnd.random() < p else v

    rows = []
    for _ in range(n):
        rows.append((
            maybe(rnd.randint(1, 12)), maybe(rnd.randint(1, 8)),
            maybe(rnd.choice([rnd.randint(0, 2359), 575, 1170, 1799, 2400, -9])),
            maybe(rnd.choice([rnd.randint(0, 300), -9, -7, 99, 98, 100])),
            maybe(rnd.randint(0, 1400)), maybe(rnd.randint(0, 95)),
            maybe(rnd.choice([1, 1, 2, 2, 2, 2, -8, -9, 3])),
            maybe(rnd.choice([1, 2, 3, 3, 4, 5, -9, -8, 0, 7, 6])),
            maybe(rnd.randint(-9, 10)), maybe(rnd.randint(0, 6)), maybe(rnd.randint(0, 1)),
            maybe(rnd.choice([1, 2, 3, 4, 7])),
            maybe(round(rnd.uniform(1, 5000), 2)), maybe(round(rnd.uniform(1, 50), 4)),
            maybe(rnd.choice([-7, -7, -7, -9, 0, rnd.randint(1, 300), -8])),
        ))
    return rows


@pytest.fixture(scope="module", params=[11, 12])
def tables(request, spark):
    rows = _random_visits(request.param)
    visits = spark.createDataFrame(rows, VISIT_SCHEMA)
    con = duckdb.connect()
    pdf = pd.DataFrame(rows, columns=VISIT_SCHEMA.names)
    for f in VISIT_SCHEMA.fields:
        pdf[f.name] = pdf[f.name].astype("Int32" if f.dataType.simpleString() == "int" else "Float64")
    con.register("visits_df", pdf)
    casts = ", ".join(f"CAST({f.name} AS {'INTEGER' if f.dataType.simpleString() == 'int' else 'DOUBLE'}) "
                      f"AS {f.name}" for f in VISIT_SCHEMA.fields)
    con.execute(f"CREATE TABLE visits_raw AS SELECT {casts} FROM visits_df")
    from cohortlens.plans import study as S
    return visits, S.clean_universe(visits), con


@pytest.mark.parametrize("name", NAMES)
def test_step_matches_duckdb_on_random_visits(tables, name):
    visits, clean, con = tables
    sdf = STEPS[name](visits, clean)
    sql = ORACLE[name].replace(VISITS_CTE, "\nvisits AS (SELECT * FROM visits_raw)")
    assert "FROM orders" not in sql
    res = con.execute(sql)
    dcols, drows = [d[0] for d in res.description], res.fetchall()
    srows = [tuple(r) for r in sdf.collect()]
    assert len(srows) == len(drows)
    sn, sb = canonical(sdf.columns, srows)
    dn, db = canonical(dcols, drows)
    assert sn == dn
    assert sb == db, [(a, b) for a, b in zip(sb, db) if a != b][:3]
