"""Registered queries: one Spark builder and (where SQL can say it) one DuckDB
twin per operator of the study.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``.
Every query reads the driver's tables (through the bindings) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.labels import band_ranges
from cohortlens.functions.stats import weekday_of
from cohortlens.operators import contrasts as C
from cohortlens.operators import profile as P
from cohortlens.operators import rules as R
from cohortlens.operators.quantiles import rank_check
from cohortlens.operators.scorecard import scorecard_summary as _scorecard_summary
from cohortlens.plans import checks as K
from cohortlens.plans import steps as T
from cohortlens.plans import study as S
from cohortlens.plans.oracle import avg1, case_sql, keep_sql, r, r_even, with_visits
from cohortlens.session import scratch_dir
from cohortlens.sources import bindings as B

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# The base relations are lazy plans, built anew for every query so that a
# rewritten input is listed again.
def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.coded_visits(spark, sf_dir)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clean_universe(visits(spark, sf_dir))


def _study(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A study step (``plans.steps``) over the coded binding of ``sf_dir``:
    the base relation is built once, labels only for steps that read them."""
    rows = visits(spark, sf_dir)
    return T.STEPS[name](rows, None if name in T.VISIT_STEPS else S.clean_universe(rows))


# SQL fragments ---------------------------------------------------------------
TWO_LAYER_SQL = keep_sql(S.TWO_LAYER_RULES)
CLEAN_SQL = keep_sql(S.CLEAN_RULES)
N = "CAST(count(*) AS BIGINT)"
PCT_ALL = r("count(*)", "sum(count(*)) OVER ()", 2, 100)
MED = "round(quantile_cont(WAITTIME, 0.5), 1)"


def _int_list(xs) -> str:
    return ", ".join(str(x) for x in xs)


# ---- sources: scans, CSV, catalog (S1-S8, P1, P2, O7) ------------------------

@query("scan_visits", with_visits("SELECT * FROM visits", clean=False))
def scan_visits(spark, sf_dir):
    return _study(spark, sf_dir, "scan_visits")


@query("csv_scan", with_visits("SELECT * FROM visits", clean=False))
def csv_scan(spark, sf_dir):
    return _study(spark, sf_dir, "csv_scan")


@query("dataset_shape", with_visits(
    f"SELECT {N} AS n_rows, CAST(15 AS INTEGER) AS n_columns, "
    f"'{', '.join(S.CORE_COLUMNS[:10])}' AS first_columns FROM visits", clean=False))
def dataset_shape(spark, sf_dir):
    return _study(spark, sf_dir, "dataset_shape")


_HEAD = ", ".join(S.HEAD_COLUMNS)


@query("head_sample", with_visits(
    f"SELECT {_HEAD} FROM visits ORDER BY {', '.join(c + ' ASC NULLS FIRST' for c in S.HEAD_COLUMNS)} LIMIT 3",
    clean=False))
def head_sample(spark, sf_dir):
    return _study(spark, sf_dir, "head_sample")


_TYPES = {c: ("double" if c in ("PATWT", "EDWT") else "int") for c in S.CORE_COLUMNS}
_POS = {c: i for i, c in enumerate(S.CORE_COLUMNS, start=1)}


@query("column_inventory", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{_TYPES[c]}', {_POS[c]})" for c in S.CORE_COLUMNS)
    + ") AS t(column_name, data_type, ordinal_position)")
def column_inventory(spark, sf_dir):
    return _study(spark, sf_dir, "column_inventory")


@query("schema_validation", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', 'int', 'int', {_POS[c]}, true)" for c in S.SCHEMA_CHECK_COLUMNS)
    + ") AS t(column_name, data_type, expected_type, ordinal_position, ok)")
def schema_validation(spark, sf_dir):
    return _study(spark, sf_dir, "schema_validation")


@query("required_columns", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', true, {_POS[c]})" for c in S.CORE_COLUMNS) + ") AS t(column_name, present, ordinal_position)")
def required_columns(spark, sf_dir):
    return _study(spark, sf_dir, "required_columns")


# ---- counts, rules, waterfall (A1-A6, P4, P5, P11, P21, V3) ------------------

@query("cardinality_baseline", with_visits(
    f"SELECT {N} AS total_records, "
    + ", ".join(f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_{c.lower()}" for c in S.CARDINALITY_COLUMNS)
    + " FROM visits", clean=False))
def cardinality_baseline(spark, sf_dir):
    return _study(spark, sf_dir, "cardinality_baseline")


@query("clean_universe_two_layer", with_visits(f"SELECT * FROM visits WHERE {TWO_LAYER_SQL}", clean=False))
def clean_universe_two_layer(spark, sf_dir):
    return _study(spark, sf_dir, "clean_universe_two_layer")


@query("clean_universe", with_visits("SELECT * FROM clean"))
def clean_universe(spark, sf_dir):
    return _study(spark, sf_dir, "clean_universe")


_A_EX = f"ARREMS IN ({_int_list(S.ARREMS_RULE['ARREMS'])})"
_W_EX = f"WAITTIME IN ({_int_list(S.WAITTIME_RULE['WAITTIME'])})"


@query("exclusion_waterfall", with_visits(
    f"SELECT {N} AS total_records, CAST(count_if({_A_EX}) AS BIGINT) AS arrems_excluded, "
    f"CAST(count_if({_W_EX}) AS BIGINT) AS waittime_excluded, "
    f"CAST(count_if(coalesce(CAST({_A_EX} AS INTEGER), 0) + coalesce(CAST({_W_EX} AS INTEGER), 0) >= 2) AS BIGINT)"
    f" AS multi_rule_excluded, CAST(count_if({_A_EX} AND {_W_EX}) AS BIGINT) AS overlap_correction, "
    "CAST(count(*) FILTER (WHERE (ARREMS IS NULL AND (WAITTIME IS NULL OR WAITTIME NOT IN (-9, -7, 99))) OR "
    "(WAITTIME IS NULL AND (ARREMS IS NULL OR ARREMS NOT IN (-9, -8)))) AS BIGINT) AS null_excluded, "
    f"CAST(count_if({TWO_LAYER_SQL}) AS BIGINT) AS clean_universe, "
    f"{r(f'count_if({TWO_LAYER_SQL})', 'count(*)', 2, 100)} AS clean_pct_of_total FROM visits", clean=False))
def exclusion_waterfall(spark, sf_dir):
    return _study(spark, sf_dir, "exclusion_waterfall")


@query("final_universe", with_visits(
    f"SELECT {N} AS total_records, CAST(count_if({CLEAN_SQL}) AS BIGINT) AS clean_universe_final, "
    f"{r(f'count_if({CLEAN_SQL})', 'count(*)', 2, 100)} AS pct_of_original, "
    f"CAST(count(*) - count_if({CLEAN_SQL}) AS BIGINT) AS total_excluded, "
    f"{r(f'count(*) - count_if({CLEAN_SQL})', 'count(*)', 2, 100)} AS total_excluded_pct FROM visits",
    clean=False))
def final_universe(spark, sf_dir):
    return _study(spark, sf_dir, "final_universe")


_LAYERS = [("ARREMS + WAITTIME", S.TWO_LAYER_RULES), ("IMMEDR", S.IMMEDR_RULE)]


@query("layer_accounting", with_visits(
    f", s AS (SELECT CAST(count(*) AS BIGINT) AS s0, CAST(count_if({TWO_LAYER_SQL}) AS BIGINT) AS s1, "
    f"CAST(count_if({CLEAN_SQL}) AS BIGINT) AS s2 FROM visits) "
    "SELECT step, layer, rows_remaining, rows_removed, "
    f"{r('rows_remaining', 'total', 2, 100)} AS pct_of_original FROM ("
    "SELECT 0 AS step, 'start' AS layer, s0 AS rows_remaining, CAST(0 AS BIGINT) AS rows_removed, s0 AS total FROM s "
    "UNION ALL SELECT 1, 'ARREMS + WAITTIME', s1, s0 - s1, s0 FROM s "
    "UNION ALL SELECT 2, 'IMMEDR', s2, s1 - s2, s0 FROM s)", clean=False))
def layer_accounting(spark, sf_dir):
    return _study(spark, sf_dir, "layer_accounting")


# ---- profiles (A7-A11, A20, O5, O6, W1, W3, W4, U1, U2, P3, P6, X1) ------------

@query("frequency_profile", with_visits(
    f"SELECT ARREMS AS value, {N} AS n, {PCT_ALL} AS pct_of_total FROM visits GROUP BY ARREMS", clean=False))
def frequency_profile(spark, sf_dir):
    return _study(spark, sf_dir, "frequency_profile")


@query("triage_profile", with_visits(
    f"SELECT IMMEDR AS triage_level, {N} AS n, {PCT_ALL} AS pct_of_total FROM visits "
    f"WHERE {TWO_LAYER_SQL} GROUP BY IMMEDR", clean=False))
def triage_profile(spark, sf_dir):
    return _study(spark, sf_dir, "triage_profile")


@query("profile_subtotals", with_visits(
    "SELECT category, CAST(sum(n) AS BIGINT) AS n, "
    f"{r('sum(n)', 'sum(sum(n)) OVER ()', 2, 100)} AS pct_of_total FROM ("
    "SELECT CASE WHEN IMMEDR IS NULL OR IMMEDR IN (-9, -8, 0, 7) THEN 'excluded' ELSE 'legitimate' END AS category, "
    f"count(*) AS n FROM visits WHERE {TWO_LAYER_SQL} GROUP BY IMMEDR) GROUP BY category", clean=False))
def profile_subtotals(spark, sf_dir):
    return _study(spark, sf_dir, "profile_subtotals")


_SHORT_DAY_SQL = case_sql("VDAYR", S.WEEKDAY_SHORT)


@query("weekday_profile", with_visits(
    f"SELECT VDAYR AS vdayr, {_SHORT_DAY_SQL} AS label, {N} AS n, {PCT_ALL} AS pct_of_total "
    "FROM clean GROUP BY VDAYR"))
def weekday_profile(spark, sf_dir):
    return _study(spark, sf_dir, "weekday_profile")


_SUSPECT = _int_list(S.WAITTIME_SUSPECT_CODES)


@query("sentinel_hunt", with_visits(
    f"SELECT WAITTIME AS value, {N} AS n, {r('count(*)', 'sum(count(*)) OVER ()', 2, 100)} AS pct_of_hunted, "
    f"{r('count(*)', '(SELECT count(*) FROM visits)', 2, 100)} AS pct_of_total "
    f"FROM visits WHERE WAITTIME IN ({_SUSPECT}) GROUP BY WAITTIME", clean=False))
def sentinel_hunt(spark, sf_dir):
    return _study(spark, sf_dir, "sentinel_hunt")


@query("sentinel_summary", with_visits(
    f"SELECT CAST(count_if(WAITTIME IN ({_SUSPECT})) AS BIGINT) AS sentinel_rows, {N} AS total_records, "
    f"{r(f'count_if(WAITTIME IN ({_SUSPECT}))', 'count(*)', 2, 100)} AS pct_of_total FROM visits", clean=False))
def sentinel_summary(spark, sf_dir):
    return _study(spark, sf_dir, "sentinel_summary")


def _top_sql(col: str, source: str, k: int = S.TOP_K) -> str:
    return (f"SELECT value, n, pct_of_total, rank FROM (SELECT {col} AS value, {N} AS n, {PCT_ALL} AS pct_of_total, "
            f"CAST(row_number() OVER (ORDER BY count(*) DESC, {col} ASC NULLS LAST) AS INTEGER) AS rank "
            f"FROM {source} GROUP BY {col}) WHERE rank <= {k}")


@query("top_values", with_visits(_top_sql("WAITTIME", "visits"), clean=False))
def top_values(spark, sf_dir):
    return _study(spark, sf_dir, "top_values")


@query("top_arrival_times", with_visits(_top_sql("ARRTIME", "clean")))
def top_arrival_times(spark, sf_dir):
    return _study(spark, sf_dir, "top_arrival_times")


@query("stacked_profile", with_visits(
    f"SELECT 'ARREMS' AS column_name, CAST(ARREMS AS VARCHAR) AS value, {N} AS n, {PCT_ALL} AS pct_of_total, "
    "'arrival_distribution' AS block FROM visits GROUP BY ARREMS "
    "UNION ALL SELECT 'WAITTIME', CAST(value AS VARCHAR), n, pct_of_total, 'waittime_top20' FROM ("
    + _top_sql("WAITTIME", "visits") + ") "
    f"UNION ALL SELECT 'WAITTIME_PLACEHOLDERS', CAST(WAITTIME AS VARCHAR), {N}, {PCT_ALL}, 'placeholder_hunt' "
    f"FROM visits WHERE WAITTIME IN ({_SUSPECT}) GROUP BY WAITTIME", clean=False))
def stacked_profile(spark, sf_dir):
    return _study(spark, sf_dir, "stacked_profile")


@query("stacked_profile_clean", with_visits(
    "SELECT 'ARRTIME' AS column_name, value, n, pct_of_total FROM (" + _top_sql("ARRTIME", "clean") + ") "
    f"UNION ALL SELECT 'VDAYR', VDAYR, {N}, {PCT_ALL} FROM clean GROUP BY VDAYR"))
def stacked_profile_clean(spark, sf_dir):
    return _study(spark, sf_dir, "stacked_profile_clean")


@query("time_range_check", with_visits(
    "SELECT min(ARRTIME) AS min_value, max(ARRTIME) AS max_value, "
    f"CAST(count_if(ARRTIME IS NULL) AS BIGINT) AS null_count, {N} AS n_rows FROM clean"))
def time_range_check(spark, sf_dir):
    return _study(spark, sf_dir, "time_range_check")


@query("band_ranges_profile", with_visits(
    f"SELECT time_of_day, {N} AS n, {PCT_ALL} AS pct_of_total FROM clean GROUP BY time_of_day"))
def band_ranges_profile(spark, sf_dir):
    return _study(spark, sf_dir, "band_ranges_profile")


_CUTS_SQL = "CASE " + " ".join(
    f"WHEN ARRTIME > {lo} AND ARRTIME <= {hi} THEN '{lab}'"
    for lo, hi, lab in zip(S.TIME_CUT_EDGES[:-1], S.TIME_CUT_EDGES[1:], [b[2] for b in S.TIME_BANDS])) + " END"


@query("band_cuts_profile", with_visits(
    f"SELECT {_CUTS_SQL} AS time_of_day, {N} AS n, {PCT_ALL} AS pct_of_total FROM clean GROUP BY 1"))
def band_cuts_profile(spark, sf_dir):
    return _study(spark, sf_dir, "band_cuts_profile")


@query("boarding_status_profile", with_visits(
    f"SELECT boarding_status, {N} AS n, {PCT_ALL} AS pct_of_total FROM clean GROUP BY boarding_status"))
def boarding_status_profile(spark, sf_dir):
    return _study(spark, sf_dir, "boarding_status_profile")


# ---- contrasts (A12-A14, A16-A19, A21-A23, W2, O2, O3, P13-P17) ---------------

def _contrast_sql(level_expr: str, level_name: str, group: str, stats: str, level_first: bool = False) -> str:
    heads = ["arrival_method", f"{level_expr} AS {level_name}"]
    if level_first:
        heads.reverse()
    return with_visits(f"SELECT {', '.join(heads)}, {N} AS n, {stats} FROM clean GROUP BY {group}")


_AVG = f"{avg1('WAITTIME')} AS avg_wait_minutes"
_MED = f"{MED} AS median_wait_minutes"

ORACLE_CONTRASTS = {
    "core_contrast": _contrast_sql(
        "triage_level", "triage_level", "ARREMS, IMMEDR, arrival_method, triage_level",
        f"{_AVG}, round(CAST(min(WAITTIME) AS DOUBLE), 1) AS min_wait_minutes, "
        "round(CAST(max(WAITTIME) AS DOUBLE), 1) AS max_wait_minutes"),
    "distribution_contrast": _contrast_sql(
        "triage_level", "triage_level", "ARREMS, IMMEDR, arrival_method, triage_level",
        f"{_AVG}, {_MED}, round(quantile_cont(WAITTIME, 0.25), 1) AS p25_wait_minutes, "
        "round(quantile_cont(WAITTIME, 0.75), 1) AS p75_wait_minutes"),
    "distribution_contrast_approx": _contrast_sql(
        "triage_level", "triage_level", "ARREMS, IMMEDR, arrival_method, triage_level",
        f"{_AVG}, CAST(quantile_disc(WAITTIME, 0.5) AS DOUBLE) AS median_wait_minutes, "
        "CAST(quantile_disc(WAITTIME, 0.25) AS DOUBLE) AS p25_wait_minutes, "
        "CAST(quantile_disc(WAITTIME, 0.75) AS DOUBLE) AS p75_wait_minutes"),
    "time_of_day_contrast": _contrast_sql("time_of_day", "time_of_day", "ARREMS, arrival_method, time_of_day",
                                          f"{_AVG}, {_MED}"),
    "day_of_week_contrast": _contrast_sql("day_of_week", "day_of_week", "ARREMS, VDAYR, arrival_method, day_of_week",
                                          f"{_AVG}, {_MED}"),
    "pain_contrast": _contrast_sql("PAINSCALE", "pain_score", "ARREMS, PAINSCALE, arrival_method",
                                   f"{_AVG}, {_MED}"),
    "boarding_contrast": _contrast_sql(
        "boarding_status", "boarding_status", "ARREMS, arrival_method, boarding_status",
        f"{r('count(*)', 'sum(count(*)) OVER (PARTITION BY ARREMS)', 2, 100)} AS pct_of_arrival_method, "
        f"{_AVG}, {_MED}"),
    "regional_contrast": _contrast_sql("census_region", "census_region", "REGION, ARREMS, census_region, "
                                       "arrival_method", f"{_AVG}, {_MED}", level_first=True),
}
ORACLE_CONTRASTS["run_dimension_default"] = ORACLE_CONTRASTS["distribution_contrast"]
ORACLE_CONTRASTS["distribution_contrast_discrete"] = ORACLE_CONTRASTS["distribution_contrast_approx"]
ORACLE_CONTRASTS["distribution_contrast_half_even"] = _contrast_sql(
    "triage_level", "triage_level", "ARREMS, IMMEDR, arrival_method, triage_level",
    f"{r_even('sum(WAITTIME)', 'count(WAITTIME)', 1)} AS avg_wait_minutes, "
    "CAST(round_even(quantile_cont(WAITTIME, 0.5), 1) AS DOUBLE) AS median_wait_minutes, "
    "CAST(round_even(quantile_cont(WAITTIME, 0.25), 1) AS DOUBLE) AS p25_wait_minutes, "
    "CAST(round_even(quantile_cont(WAITTIME, 0.75), 1) AS DOUBLE) AS p75_wait_minutes")

ORACLE_CONTRASTS["time_of_day_cuts_contrast"] = with_visits(
    f"SELECT arrival_method, time_of_day, {N} AS n, CAST(count(WAITTIME) AS BIGINT) AS n_valid, "
    f"{r_even('sum(WAITTIME)', 'count(WAITTIME)', 1)} AS avg_wait_minutes, "
    "CAST(round_even(quantile_cont(WAITTIME, 0.5), 1) AS DOUBLE) AS median_wait_minutes "
    f"FROM (SELECT * REPLACE ({_CUTS_SQL} AS time_of_day) FROM clean) "
    "WHERE arrival_method IS NOT NULL AND time_of_day IS NOT NULL GROUP BY ARREMS, arrival_method, time_of_day")

_DIMENSION_QUERIES = {
    "core_contrast": ("core", "exact"),
    "distribution_contrast": ("distribution", "exact"),
    "distribution_contrast_approx": ("distribution", "approx"),
    "time_of_day_contrast": ("time_of_day", "exact"),
    "day_of_week_contrast": ("day_of_week", "exact"),
    "pain_contrast": ("pain", "exact"),
    "boarding_contrast": ("boarding", "exact"),
    "regional_contrast": ("region", "exact"),
    "run_dimension_default": (S.DEFAULT_DIMENSION, "exact"),
    "distribution_contrast_discrete": ("distribution", "discrete"),
    "distribution_contrast_half_even": ("distribution", "exact"),
    "time_of_day_cuts_contrast": ("time_of_day", "exact"),
}


def _step_query(name: str) -> QueryFn:
    def fn(spark, sf_dir):
        return _study(spark, sf_dir, name)
    fn.__name__ = name
    return fn


for _name in _DIMENSION_QUERIES:
    query(_name, ORACLE_CONTRASTS[_name])(_step_query(_name))

_BOARDED_SQL = f"boarding_status IN ({', '.join(repr(b) for b in S.BOARDED_STATUSES)})"


@query("boarding_rate", with_visits(
    f"SELECT arrival_method, CAST(count_if({_BOARDED_SQL}) AS BIGINT) AS boarded, {N} AS total, "
    f"{r(f'count_if({_BOARDED_SQL})', 'count(*)', 2, 100)} AS boarding_rate_pct FROM clean "
    "GROUP BY ARREMS, arrival_method"))
def boarding_rate(spark, sf_dir):
    return _study(spark, sf_dir, "boarding_rate")


_HA, _TA = f"count_if(ARREMS = 1 AND {_BOARDED_SQL})", "count_if(ARREMS = 1)"
_HB, _TB = f"count_if(ARREMS = 2 AND {_BOARDED_SQL})", "count_if(ARREMS = 2)"


@query("boarding_rate_ratio", with_visits(
    f"SELECT CAST({_HA} AS BIGINT) AS hits_ambulance, CAST({_TA} AS BIGINT) AS total_ambulance, "
    f"CAST({_HB} AS BIGINT) AS hits_walk_in, CAST({_TB} AS BIGINT) AS total_walk_in, "
    f"{r(_HA, _TA, 2, 100)} AS rate_ambulance_pct, {r(_HB, _TB, 2, 100)} AS rate_walk_in_pct, "
    f"{r(f'CAST({_HA} AS HUGEINT) * {_TB}', f'CAST({_TA} AS HUGEINT) * {_HB}', 2)} AS rate_ratio FROM clean"))
def boarding_rate_ratio(spark, sf_dir):
    return _study(spark, sf_dir, "boarding_rate_ratio")


# ---- gap tables and verdicts (G1-G8, P8, P22) ---------------------------------

def _gap_sql(contrast_sql_name: str, index: str, code: str, where: str = "") -> str:
    full = ORACLE_CONTRASTS[contrast_sql_name]
    sel_start = full.index("\nSELECT ")
    ctes, select = full[:sel_start], full[sel_start + 1:].replace("SELECT ", f"SELECT {code} AS code, ", 1)
    return (f"{ctes}, c AS ({select}) SELECT {index}, "
            "max(median_wait_minutes) FILTER (WHERE arrival_method = 'Ambulance') AS ambulance, "
            "max(median_wait_minutes) FILTER (WHERE arrival_method = 'Walk-in') AS walk_in, "
            "round(max(median_wait_minutes) FILTER (WHERE arrival_method = 'Ambulance') - "
            "max(median_wait_minutes) FILTER (WHERE arrival_method = 'Walk-in'), 1) AS gap "
            f"FROM c {where} GROUP BY code, {index}")


_GAP_QUERIES = {
    "gap_by_triage": ("IMMEDR", "distribution_contrast", "triage_level", None),
    "gap_by_time": ("time_of_day", "time_of_day_contrast", "time_of_day", None),
    "gap_by_day": ("VDAYR", "day_of_week_contrast", "day_of_week", None),
    "gap_by_pain": ("PAINSCALE", "pain_contrast", "pain_score", S.PAIN_GAP_RANGE),
    "gap_by_region": ("REGION", "regional_contrast", "census_region", None),
}


for _name, (_code, _sqlname, _index, _rng) in _GAP_QUERIES.items():
    _where = f"WHERE {_index} BETWEEN {_rng[0]} AND {_rng[1]}" if _rng else ""
    query(_name, _gap_sql(_sqlname, _index, _code, _where))(_step_query(_name))


query("gap_by_time_cuts", _gap_sql("time_of_day_cuts_contrast", "time_of_day", "time_of_day"))(_step_query("gap_by_time_cuts"))


def _dims_sql(code: bool = False) -> str:
    parts = []
    for name, level_sql, code_sql, group in [
        ("triage", "triage_level", "IMMEDR", "IMMEDR, triage_level"),
        ("time_of_day", "time_of_day", "time_of_day", "time_of_day"),
        ("day_of_week", "day_of_week", "VDAYR", "VDAYR, day_of_week"),
        ("pain", "CAST(PAINSCALE AS VARCHAR)", "PAINSCALE", "PAINSCALE"),
        ("boarding", "boarding_status", "boarding_status", "boarding_status"),
        ("region", "census_region", "REGION", "REGION, census_region"),
    ]:
        own = f"CAST({code_sql} AS VARCHAR) AS code, " if code else ""
        parts.append(f"SELECT '{name}' AS dimension, {own}arrival_method, {level_sql} AS level, {N} AS n, "
                     f"{_AVG}, {_MED} FROM clean GROUP BY ARREMS, arrival_method, {group}")
    return " UNION ALL ".join(parts)


@query("study_all_dimensions", with_visits(_dims_sql()))
def study_all_dimensions(spark, sf_dir):
    return _study(spark, sf_dir, "study_all_dimensions")


_GAPS_CTE = (
    f", dims AS ({_dims_sql(code=True)}), gaps AS (SELECT dimension, level, "
    "max(median_wait_minutes) FILTER (WHERE arrival_method = 'Ambulance') AS ambulance, "
    "max(median_wait_minutes) FILTER (WHERE arrival_method = 'Walk-in') AS walk_in, "
    "round(max(median_wait_minutes) FILTER (WHERE arrival_method = 'Ambulance') - "
    "max(median_wait_minutes) FILTER (WHERE arrival_method = 'Walk-in'), 1) AS gap, "
    "max(avg_wait_minutes) FILTER (WHERE arrival_method = 'Ambulance') AS mean_ambulance, "
    "max(avg_wait_minutes) FILTER (WHERE arrival_method = 'Walk-in') AS mean_walk_in "
    "FROM dims WHERE dimension <> 'boarding' AND (dimension <> 'pain' OR TRY_CAST(level AS INTEGER) "
    f"BETWEEN {S.PAIN_GAP_RANGE[0]} AND {S.PAIN_GAP_RANGE[1]}) GROUP BY dimension, code, level)")


def _with_gaps(body: str) -> str:
    return with_visits(_GAPS_CTE + "\n" + body)


@query("gap_verdict", _with_gaps(
    "SELECT dimension, CAST(count(*) AS BIGINT) AS n_levels, CAST(count_if(gap < 0) AS BIGINT) AS n_negative, "
    "CAST(count_if(gap > 0) AS BIGINT) AS n_positive, CAST(count_if(gap = 0) AS BIGINT) AS n_zero, "
    "CAST(count_if(gap IS NULL) AS BIGINT) AS n_missing, min(gap) AS min_gap, max(gap) AS max_gap, "
    "CASE WHEN count_if(gap < 0) = count(*) THEN 'lower at every level' "
    "WHEN count_if(gap > 0) = count(*) THEN 'higher at every level' ELSE 'mixed' END AS verdict "
    "FROM gaps GROUP BY dimension"))
def gap_verdict(spark, sf_dir):
    return _study(spark, sf_dir, "gap_verdict")


@query("gap_extremes", _with_gaps(
    "SELECT dimension, extreme, level, gap, abs_gap FROM ("
    "SELECT dimension, 'widest' AS extreme, level, gap, abs(gap) AS abs_gap, "
    "max(abs(gap)) OVER (PARTITION BY dimension) AS target FROM gaps WHERE gap IS NOT NULL "
    "UNION ALL SELECT dimension, 'narrowest', level, gap, abs(gap), "
    "min(abs(gap)) OVER (PARTITION BY dimension) FROM gaps WHERE gap IS NOT NULL) WHERE abs_gap = target"))
def gap_extremes(spark, sf_dir):
    return _study(spark, sf_dir, "gap_extremes")


@query("mean_median_divergence", _with_gaps(
    "SELECT dimension, level, mean_ambulance, mean_walk_in, ambulance AS median_ambulance, "
    "walk_in AS median_walk_in, round(mean_ambulance - mean_walk_in, 1) AS mean_gap, "
    "gap AS median_gap, round(abs(gap - round(mean_ambulance - mean_walk_in, 1)), 1) AS divergence FROM gaps"))
def mean_median_divergence(spark, sf_dir):
    return _study(spark, sf_dir, "mean_median_divergence")


# ---- filtered statistics and scorecard (A15, P12, V1, V2, X7, F3) -------------

@query("filtered_statistics", with_visits(K.filtered_statistics_sql(), clean=False))
def filtered_statistics(spark, sf_dir):
    return _study(spark, sf_dir, "filtered_statistics")


@query("median_method_agreement", with_visits(K.method_agreement_sql(), clean=False))
def median_method_agreement(spark, sf_dir):
    return _study(spark, sf_dir, "median_method_agreement")


@query("scorecard", with_visits(K.scorecard_sql(), clean=False))
def scorecard_query(spark, sf_dir):
    """Figures of the stored visits against those observed as they were written."""
    return T.observed_scorecard(visits(spark, sf_dir))


@query("scorecard_summary", with_visits(K.scorecard_summary_sql(), clean=False))
def scorecard_summary_query(spark, sf_dir):
    return _scorecard_summary(T.observed_scorecard(visits(spark, sf_dir)))


# ---- the same operators on real columns (lineitem, events) ---------------------

@query("lineitem_status_contrast",
       "SELECT l_linestatus, l_linenumber, " + N + " AS n, " + avg1("quantity") + " AS avg_quantity, "
       "round(quantile_cont(quantity, 0.5), 1) AS median_quantity, "
       "round(quantile_cont(quantity, 0.25), 1) AS p25_quantity, "
       "round(quantile_cont(quantity, 0.75), 1) AS p75_quantity FROM ("
       "SELECT l_linestatus, l_linenumber, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem "
       ") GROUP BY l_linestatus, l_linenumber")
def lineitem_status_contrast(spark, sf_dir):
    return C.contrast(B.lineitem_measures(spark, sf_dir), "l_linestatus", "l_linenumber", "quantity", suffix="quantity")


@query("lineitem_weekday_share",
       "SELECT l_linestatus, CAST(dayofweek(l_shipdate) + 1 AS INTEGER) AS ship_weekday, " + N + " AS n, "
       + r("count(*)", "sum(count(*)) OVER (PARTITION BY l_linestatus)", 2, 100) + " AS pct_of_cohort "
       "FROM lineitem GROUP BY l_linestatus, dayofweek(l_shipdate)")
def lineitem_weekday_share(spark, sf_dir):
    li = B.lineitem_measures(spark, sf_dir).withColumn("ship_weekday", weekday_of("l_shipdate"))
    return C.contrast(li, "l_linestatus", "ship_weekday", "quantity", stats=("n", "share"))


@query("lineitem_return_rate",
       "SELECT l_linestatus, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS returned, " + N + " AS total, "
       + r("count_if(l_returnflag = 'R')", "count(*)", 2, 100) + " AS return_rate_pct "
       "FROM lineitem GROUP BY l_linestatus")
def lineitem_return_rate(spark, sf_dir):
    return C.cohort_rate(B.lineitem_measures(spark, sf_dir), "l_linestatus", F.col("l_returnflag") == "R",
                         numerator="returned", denominator="total", rate_name="return_rate_pct")


_EVENT_BAND_SQL = "CASE " + " ".join(
    f"WHEN hhmm BETWEEN {lo} AND {hi} THEN '{lab}'" for lo, hi, lab in S.TIME_BANDS) + " END"


@query("events_band_contrast",
       f"SELECT event_type, {_EVENT_BAND_SQL} AS time_band, {N} AS n, {avg1('amount_cents')} AS avg_amount_cents, "
       "round(quantile_cont(amount_cents, 0.5), 1) AS median_amount_cents FROM ("
       "SELECT event_type, CAST(hour(ts) * 100 + minute(ts) AS INTEGER) AS hhmm, "
       "CAST(round(value * 100) AS BIGINT) AS amount_cents FROM events) "
       "GROUP BY event_type, 2")
def events_band_contrast(spark, sf_dir):
    ev = B.event_measures(spark, sf_dir).withColumn("time_band", band_ranges("hhmm", S.TIME_BANDS))
    return C.contrast(ev, "event_type", "time_band", "amount_cents", stats=("n", "avg", "median"),
                      method="exact_sorted", suffix="amount_cents")


# ---- high-cardinality measure: order totals (exact without per-group state) ----

_PRICE_GROUP = "o_orderstatus, o_orderpriority"


@query("orders_price_quartiles",
       f"SELECT {_PRICE_GROUP}, {N} AS n, round(quantile_cont(o_totalprice, 0.5), 4) AS median_totalprice, "
       "round(quantile_cont(o_totalprice, 0.25), 4) AS p25_totalprice, "
       f"round(quantile_cont(o_totalprice, 0.75), 4) AS p75_totalprice FROM orders GROUP BY {_PRICE_GROUP}")
def orders_price_quartiles(spark, sf_dir):
    o = B.read_table(spark, sf_dir, "orders", ["o_orderstatus", "o_orderpriority", "o_totalprice"])
    return C.contrast(o, "o_orderstatus", "o_orderpriority", "o_totalprice",
                      stats=("n", "median", "p25", "p75"), method="exact_sorted", digits=4, suffix="totalprice")


@query("orders_price_quartiles_approx",
       f"SELECT {_PRICE_GROUP}, {N} AS n, CAST(quantile_disc(o_totalprice, 0.5) AS DOUBLE) AS median_totalprice, "
       "CAST(quantile_disc(o_totalprice, 0.25) AS DOUBLE) AS p25_totalprice, "
       f"CAST(quantile_disc(o_totalprice, 0.75) AS DOUBLE) AS p75_totalprice FROM orders GROUP BY {_PRICE_GROUP}")
def orders_price_quartiles_approx(spark, sf_dir):
    o = B.read_table(spark, sf_dir, "orders", ["o_orderstatus", "o_orderpriority", "o_totalprice"])
    return C.contrast(o, "o_orderstatus", "o_orderpriority", "o_totalprice",
                      stats=("n", "median", "p25", "p75"), method="approx", suffix="totalprice")


# Approximate quantiles are held against the ranks of the data, at any size.
# ``n`` counts the rows with a value; a group without one has nothing to hold.
def _ranks_hold_sql(group: str, table: str, measure: str) -> str:
    return (f"SELECT {group}, CAST(count({measure}) AS BIGINT) AS n, true AS median_wait_minutes_ok, "
            f"true AS p25_wait_minutes_ok, true AS p75_wait_minutes_ok FROM {table} GROUP BY {group}")


def _ranks(df: DataFrame, cohort: str, level: str, measure: str, method: str, tolerance: float) -> DataFrame:
    found = C.contrast(df, cohort, level, measure, stats=("median", "p25", "p75"), method=method, digits=4)
    return rank_check(df, [cohort, level], measure, found,
                      {"median_wait_minutes": 0.5, "p25_wait_minutes": 0.25, "p75_wait_minutes": 0.75}, tolerance)


@query("distribution_approx_ranks", with_visits(_ranks_hold_sql("ARREMS, IMMEDR", "clean", "WAITTIME")))
def distribution_approx_ranks(spark, sf_dir):
    return _ranks(clean(spark, sf_dir), "ARREMS", "IMMEDR", "WAITTIME", "approx", 0.001)


@query("orders_price_approx_ranks", _ranks_hold_sql(_PRICE_GROUP, "orders", "o_totalprice"))
def orders_price_approx_ranks(spark, sf_dir):
    o = B.read_table(spark, sf_dir, "orders", ["o_orderstatus", "o_orderpriority", "o_totalprice"])
    return _ranks(o, "o_orderstatus", "o_orderpriority", "o_totalprice", "approx", 0.001)


@query("orders_price_sketch_ranks", _ranks_hold_sql(_PRICE_GROUP, "orders", "o_totalprice"))
def orders_price_sketch_ranks(spark, sf_dir):
    """KLL sketches, salted by value and merged in two levels."""
    o = B.read_table(spark, sf_dir, "orders", ["o_orderstatus", "o_orderpriority", "o_totalprice"])
    return _ranks(o, "o_orderstatus", "o_orderpriority", "o_totalprice", "sketch", 0.03)


# The order of the rows is part of these results: numbered as they come.
def _positions(df: DataFrame) -> DataFrame:
    """``df``'s few group rows with their place in its order."""
    return df.coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1)


def _position_sql(order: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS position"


@query("distribution_contrast_order", _contrast_sql(
    "triage_level", "triage_level", "ARREMS, IMMEDR, arrival_method, triage_level",
    _position_sql("IMMEDR ASC NULLS FIRST, ARREMS ASC NULLS FIRST")))
def distribution_contrast_order(spark, sf_dir):
    return _positions(_study(spark, sf_dir, "distribution_contrast")).select(
        "arrival_method", "triage_level", "n", "position")


@query("boarding_contrast_order", _contrast_sql(
    "boarding_status", "boarding_status", "ARREMS, arrival_method, boarding_status",
    _position_sql("arrival_method ASC NULLS FIRST, boarding_status ASC NULLS FIRST")))
def boarding_contrast_order(spark, sf_dir):
    return _positions(_study(spark, sf_dir, "boarding_contrast")).select(
        "arrival_method", "boarding_status", "n", "position")


@query("triage_profile_order", with_visits(
    f"SELECT IMMEDR AS triage_level, {N} AS n, {_position_sql('IMMEDR ASC NULLS FIRST')} FROM visits "
    f"WHERE {TWO_LAYER_SQL} GROUP BY IMMEDR", clean=False))
def triage_profile_order(spark, sf_dir):
    return _positions(_study(spark, sf_dir, "triage_profile")).select("triage_level", "n", "position")


@query("distribution_contrast_sorted", ORACLE_CONTRASTS["distribution_contrast"])
def distribution_contrast_sorted(spark, sf_dir):
    """The flagship contrast with the distributed exact quantile path."""
    return _study(spark, sf_dir, "distribution_contrast_sorted")


# ---- the production path: a stored visit table (pushdown + pruning) -----------

@query("distribution_contrast_stored", ORACLE_CONTRASTS["distribution_contrast"])
def distribution_contrast_stored(spark, sf_dir):
    """The flagship contrast over the visits stored as parquet (written for
    this call under the shared checkpoint folder): the exclusion rules are
    pushed into the parquet reader and only the used columns are read."""
    path = scratch_dir(spark, "visits")
    visits(spark, sf_dir).write.mode("error").parquet(path)
    return S.run_dimension(B.read_visits(spark, path), "distribution")


# ---- profiles on real columns (low and high cardinality) ------------------------

@query("orders_status_profile",
       f"SELECT o_orderstatus AS value, {N} AS n, {PCT_ALL} AS pct_of_total FROM orders GROUP BY o_orderstatus")
def orders_status_profile(spark, sf_dir):
    o = B.read_table(spark, sf_dir, "orders", ["o_orderstatus"])
    return P.frequency(o, "o_orderstatus").orderBy(F.desc("n"))


@query("orders_top_prices",
       "SELECT value, n, pct_of_total, rank FROM (SELECT o_totalprice AS value, " + N + " AS n, "
       + PCT_ALL + " AS pct_of_total, CAST(row_number() OVER (ORDER BY count(*) DESC, o_totalprice ASC NULLS LAST) "
       "AS INTEGER) AS rank FROM orders GROUP BY o_totalprice) WHERE rank <= 20")
def orders_top_prices(spark, sf_dir):
    """Top-k over a column whose values are nearly all distinct: one group
    per order, shares over all of them, k rows kept per partition."""
    o = B.read_table(spark, sf_dir, "orders", ["o_totalprice"])
    return P.top_values(o, "o_totalprice", 20)


from cohortlens.plans import stored_queries  # noqa: E402,F401  (registers its queries here)
