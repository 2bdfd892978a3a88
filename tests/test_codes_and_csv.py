"""Gap tables paired by code, and CSV reads that keep every value."""

import pytest

from cohortlens.operators import gap_table, waterfall
from cohortlens.plans import steps as T
from cohortlens.plans import study as S
from cohortlens.sources.csv import VISIT_SCHEMA, failed_cells, read_visits_csv, read_visits_csv_by_name
from fixture import visit, visits_df


def _unmapped(spark):
    rows = [visit(ARREMS=a, REGION=g, WAITTIME=w) for a, g, w in
            [(1, 8, 90), (2, 8, 30), (1, 9, 10), (2, 9, 20), (1, 1, 5), (2, 1, 6)]]
    return visits_df(spark, rows)


def test_unmapped_codes_stay_separate_levels(spark):
    v = _unmapped(spark)
    con = S.dimension_contrast(S.clean_universe(v), "region", keep_code=True)
    got = gap_table(con, "census_region", "arrival_method", "median_wait_minutes", S.GAP_COHORTS, code="level_code")
    assert got.columns == ["census_region", "ambulance", "walk_in", "gap"]
    want = sorted([(None, 90.0, 30.0, 60.0), (None, 10.0, 20.0, -10.0), (S.REGION_LABELS[1], 5.0, 6.0, -1.0)], key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    clean = S.clean_universe(v)
    shared = T.run_study(v, steps=["gap_by_region", "gap_verdict", "mean_median_divergence"])
    assert sorted(map(tuple, shared["gap_by_region"].collect()), key=repr) == want
    assert sorted(map(tuple, T.gap_by_region(v, clean).collect()), key=repr) == want
    verdict = {r.dimension: (r.n_levels, r.n_positive) for r in shared["gap_verdict"].collect()}
    assert verdict["region"] == (3, 1)
    region = [r for r in shared["mean_median_divergence"].collect() if r.dimension == "region"]
    assert sorted((r.median_ambulance, r.median_walk_in) for r in region) == [(5.0, 6.0), (10.0, 20.0), (90.0, 30.0)]


def _write(folder, name, columns, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([",".join(columns), *[",".join(map(str, r)) for r in rows]]) + "\n")
    return str(folder)


NAMES = [f.name for f in VISIT_SCHEMA.fields]
ROW = list(visit(WAITTIME=17, LOV=300))


def _swapped(values):
    i, j = NAMES.index("WAITTIME"), NAMES.index("LOV")
    out = list(values)
    out[i], out[j] = out[j], out[i]
    return out


def test_swapped_header_is_an_error_by_schema_and_read_by_name(spark, tmp_path):
    path = _write(tmp_path / "a", "x.csv", _swapped(NAMES), _swapped(ROW))
    with pytest.raises(Exception, match="(?i)header"):
        read_visits_csv(spark, path).collect()
    got = read_visits_csv_by_name(spark, path).first()
    assert (got.WAITTIME, got.LOV) == (17, 300)


def test_files_of_different_column_order_are_never_mixed_up(spark, tmp_path):
    _write(tmp_path / "b", "x.csv", NAMES, ROW)
    path = _write(tmp_path / "b", "y.csv", _swapped(NAMES), _swapped(ROW))
    with pytest.raises(Exception, match="(?i)header"):
        read_visits_csv_by_name(spark, path).collect()


def test_numeric_text_blanks_and_failed_cells(spark, tmp_path):
    i = NAMES.index("WAITTIME")
    cells = ["12.0", "", " 7 ", "1e2"]
    path = _write(tmp_path / "c", "x.csv", NAMES, *[ROW[:i] + [c] + ROW[i + 1:] for c in cells])
    assert sorted((r.WAITTIME for r in read_visits_csv_by_name(spark, path).collect()), key=repr) == sorted(
        [12, None, 7, 100], key=repr)
    bad = _write(tmp_path / "d", "x.csv", NAMES, *[ROW[:i] + [c] + ROW[i + 1:] for c in ("12.5", "x", "3", "9e12")])
    with pytest.raises(Exception, match="WAITTIME"):
        read_visits_csv_by_name(spark, bad).collect()
    assert sorted((r.WAITTIME for r in read_visits_csv_by_name(spark, bad, on_failed="null").collect()), key=repr) == \
        sorted([None, None, 3, None], key=repr)
    counts = failed_cells(spark, bad).first().asDict()
    assert counts.pop("WAITTIME") == 3 and set(counts.values()) == {0}


def test_missing_rule_column_is_an_error(spark, tmp_path):
    keep = [n for n in NAMES if n != "IMMEDR"]
    path = _write(tmp_path / "e", "x.csv", keep, [v for n, v in zip(NAMES, ROW) if n != "IMMEDR"])
    with pytest.raises(ValueError, match="IMMEDR"):
        read_visits_csv_by_name(spark, path, strict=False)
    other = [n for n in NAMES if n != "LOV"]
    path = _write(tmp_path / "f", "x.csv", other, [v for n, v in zip(NAMES, ROW) if n != "LOV"])
    got = read_visits_csv_by_name(spark, path, strict=False)
    assert got.first().LOV is None and waterfall(got, S.TWO_LAYER_RULES).first().clean_universe == 1
