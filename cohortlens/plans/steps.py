"""Every output of the study as a function of a visits table.

Each step takes ``(visits, clean)`` -- the raw visit relation and its clean
universe (``study.clean_universe(visits)``) -- and returns a DataFrame.
``STEPS`` lists them in the study's order; ``run_study`` builds all of them
for any visit table (the coded binding, a stored table, the study's own
CSV).  A run shares three small tables, each built in one scan (dimension
statistics, profile counts, the check summary); the steps are read off
them and equal the standalone steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.labels import decode_codes
from cohortlens.functions.stats import rounded_ratio
from cohortlens.operators import contrasts as C
from cohortlens.operators import gaps as G
from cohortlens.operators import profile as P
from cohortlens.operators import rules as R
from cohortlens.operators.scorecard import filtered_statistics as _filtered_statistics
from cohortlens.operators.scorecard import method_agreement
from cohortlens.operators.scorecard import scorecard as _scorecard
from cohortlens.operators.scorecard import scorecard_summary as _scorecard_summary
from cohortlens.plans import checks as K
from cohortlens.plans import study as S
from cohortlens.plans.observed import observed_store
from cohortlens.session import scratch_dir
from cohortlens.sources import catalog as CAT
from cohortlens.sources.csv import VISIT_SCHEMA, csv_round_trip

Step = Callable[[DataFrame, DataFrame], DataFrame]
LAYERS = [("ARREMS + WAITTIME", S.TWO_LAYER_RULES), ("IMMEDR", S.IMMEDR_RULE)]
GAP_LEVELS = {"distribution": "triage_level", "time_of_day": "time_of_day", "day_of_week": "day_of_week",
              "pain": "pain_score", "region": "census_region"}


# ---- scans, catalog (step 0, 4a) ------------------------------------------------

def scan_visits(visits, clean):
    return visits


def csv_scan(visits, clean):
    return csv_round_trip(visits.sparkSession, visits, VISIT_SCHEMA)


def dataset_shape(visits, clean):
    return CAT.dataset_shape(visits)


def head_sample(visits, clean):
    return CAT.head_sample(visits, S.HEAD_COLUMNS, 3)


def column_inventory(visits, clean):
    return CAT.column_inventory(visits)


def schema_validation(visits, clean):
    return CAT.validate_schema(visits, {c: "int" for c in S.SCHEMA_CHECK_COLUMNS})


def required_columns(visits, clean):
    return CAT.required_columns(visits, S.CORE_COLUMNS)


# ---- counts and exclusions (steps 1-4) --------------------------------------------

def cardinality_baseline(visits, clean):
    return P.cardinality(visits, S.CARDINALITY_COLUMNS)


def clean_universe_two_layer(visits, clean):
    return R.exclude_codes(visits, S.TWO_LAYER_RULES)


def clean_universe(visits, clean):
    return clean


def exclusion_waterfall(visits, clean):
    return R.waterfall(visits, S.TWO_LAYER_RULES)


def final_universe(visits, clean):
    return R.final_universe(visits, S.CLEAN_RULES)


def layer_accounting(visits, clean):
    return R.layer_accounting(visits, LAYERS)


# ---- profiles (steps 1a, 3, 7) ----------------------------------------------------

def frequency_profile(visits, clean):
    return P.frequency(visits, "ARREMS").orderBy(F.desc("n"))


def triage_profile(visits, clean):
    two = R.exclude_codes(visits, S.TWO_LAYER_RULES)
    return P.frequency(two, "IMMEDR", value_name="triage_level").orderBy("triage_level")


def profile_subtotals(visits, clean):
    return P.profile_subtotals(triage_profile(visits, clean), "triage_level", S.IMMEDR_RULE["IMMEDR"])


def weekday_profile(visits, clean):
    freq = P.frequency(clean, "VDAYR", value_name="vdayr")
    return (freq.select("vdayr", decode_codes("vdayr", S.WEEKDAY_SHORT).alias("label"), "n", "pct_of_total")
            .orderBy("vdayr"))


def sentinel_hunt(visits, clean):
    return P.sentinel_hunt(visits, "WAITTIME", S.WAITTIME_SUSPECT_CODES).orderBy(F.desc("n"))


def sentinel_summary(visits, clean):
    return P.sentinel_summary(visits, "WAITTIME", S.WAITTIME_SUSPECT_CODES)


def top_values(visits, clean):
    return P.top_values(visits, "WAITTIME", S.TOP_K)


def top_arrival_times(visits, clean):
    return P.top_values(clean, "ARRTIME", S.TOP_K)


def stacked_profile(visits, clean):
    def shape(df, name, block, pct="pct_of_total"):
        return df.select(F.lit(name).alias("column_name"), F.col("value").cast("string").alias("value"), "n",
                         F.col(pct).alias("pct_of_total"), F.lit(block).alias("block"))
    wait = P.frequency(visits, "WAITTIME")  # shared by the top-20 and the sentinel block
    blocks = [
        shape(P.frequency(visits, "ARREMS"), "ARREMS", "arrival_distribution"),
        shape(P.top_of_profile(wait, S.TOP_K), "WAITTIME", "waittime_top20"),
        shape(P.hunt_in_profile(wait, "value", S.WAITTIME_SUSPECT_CODES), "WAITTIME_PLACEHOLDERS",
              "placeholder_hunt", pct="pct_of_hunted"),
    ]
    return P.stack_blocks(blocks).orderBy("block", F.desc("n"))


def stacked_profile_clean(visits, clean):
    cols = ["value", "n", "pct_of_total"]
    blocks = [P.top_values(clean, "ARRTIME", S.TOP_K).select(F.lit("ARRTIME").alias("column_name"), *cols),
              P.frequency(clean, "VDAYR").select(F.lit("VDAYR").alias("column_name"), *cols)]
    return P.stack_blocks(blocks).orderBy("column_name", F.desc("n"))


def time_range_check(visits, clean):
    return P.range_check(clean, "ARRTIME")


def band_ranges_profile(visits, clean):
    return P.frequency(clean, "time_of_day", value_name="time_of_day").orderBy("time_of_day")


def band_cuts_profile(visits, clean):
    return P.frequency(clean, S.time_band_cuts("ARRTIME"), value_name="time_of_day").orderBy("time_of_day")


def boarding_status_profile(visits, clean):
    return P.frequency(clean, "boarding_status", value_name="boarding_status").orderBy("boarding_status")


# ---- contrasts (steps 5, 6, 8-12) ---------------------------------------------------

def _dimension(name: str, method: str = "exact", rounding: str = "half_up") -> Step:
    def step(visits, clean):
        return S.dimension_contrast(clean, name, method, rounding)
    step.__name__ = f"{name}_contrast"
    return step


core_contrast = _dimension("core")
distribution_contrast = _dimension("distribution")
distribution_contrast_approx = _dimension("distribution", "approx")
distribution_contrast_sorted = _dimension("distribution", "exact_sorted")
distribution_contrast_discrete = _dimension("distribution", "discrete")
distribution_contrast_half_even = _dimension("distribution", "exact", "half_even")
time_of_day_contrast = _dimension("time_of_day")
day_of_week_contrast = _dimension("day_of_week")
pain_contrast = _dimension("pain")
boarding_contrast = _dimension("boarding")
regional_contrast = _dimension("region")
run_dimension_default = _dimension(S.DEFAULT_DIMENSION)


def _cuts_contrast(clean, keep_code: bool = False):
    return C.contrast(clean.withColumn("time_of_day", S.time_band_cuts("ARRTIME")), S.COHORT, "time_of_day", S.MEASURE,
                      stats=("n", "n_valid", "avg", "median"), rounding="half_even", drop_unlabelled=True,
                      cohort_labels=S.ARRIVAL_LABELS, cohort_name="arrival_method", keep_code=keep_code)


def time_of_day_cuts_contrast(visits, clean):
    """Time of day on the gap-free cuts: rows and non-NULL waits, half-even
    rounding, groups without a label dropped."""
    return _cuts_contrast(clean)


def boarding_rate(visits, clean):
    return C.cohort_rate(clean, "ARREMS", F.col("boarding_status").isin(S.BOARDED_STATUSES),
                         cohort_labels=S.ARRIVAL_LABELS, cohort_name="arrival_method", numerator="boarded",
                         denominator="total", rate_name="boarding_rate_pct")


def boarding_rate_ratio(visits, clean):
    return C.rate_ratio(clean, "ARREMS", F.col("boarding_status").isin(S.BOARDED_STATUSES), 1, 2,
                        names=("ambulance", "walk_in"))


# ---- gaps and verdicts ------------------------------------------------------------

def _gap(dim: str) -> Step:
    index = GAP_LEVELS[dim]

    def step(visits, clean):
        con = S.dimension_contrast(clean, dim, keep_code=True)
        if dim == "pain":
            con = con.filter(F.col(index).between(*S.PAIN_GAP_RANGE))
        return G.gap_table(con, index, "arrival_method", "median_wait_minutes", S.GAP_COHORTS, code="level_code")
    step.__name__ = f"gap_by_{dim}"
    return step


gap_by_triage = _gap("distribution")
gap_by_time = _gap("time_of_day")
gap_by_day = _gap("day_of_week")
gap_by_pain = _gap("pain")
gap_by_region = _gap("region")


def gap_by_time_cuts(visits, clean):
    return G.gap_table(_cuts_contrast(clean, keep_code=True), "time_of_day", "arrival_method", "median_wait_minutes",
                       S.GAP_COHORTS, code="level_code")


def study_all_dimensions(visits, clean):
    return S.all_dimensions(visits, clean=clean)


def gap_verdict(visits, clean):
    return G.gap_verdict(S.gap_tables(visits, clean=clean), by=["dimension"])


def gap_extremes(visits, clean):
    return G.gap_extremes(S.gap_tables(visits, clean=clean), "level", by=["dimension"])


def mean_median_divergence(visits, clean):
    return S.divergence_table(visits, clean=clean)


# ---- reproducibility checks -------------------------------------------------------

def _all_clean(clean):
    """The clean universe with the flag the check filters name, so that the
    exclusion rules reach the reader."""
    return clean.withColumn("in_clean", F.lit(True))


def filtered_statistics(visits, clean, shared=None):
    return _filtered_statistics(_all_clean(clean), "WAITTIME", K.statistic_specs(), shared=shared)


def median_method_agreement(visits, clean, shared=None):
    return method_agreement(_all_clean(clean), "WAITTIME", K.median_specs(), shared=shared)


def scorecard(visits, clean, expected: dict[str, float] | None = None, shared=None):
    return _scorecard(S.labelled_visits(visits), "WAITTIME", K.checks(expected),
                      shared=shared)


def observed_scorecard(visits):
    """The scorecard of a stored copy of the visits, against the figures
    observed while it was written."""
    base = observed_store(visits)
    return _scorecard(base.stored, "WAITTIME", K.checks(base.expected))


def scorecard_summary(visits, clean, expected: dict[str, float] | None = None, shared=None):
    return _scorecard_summary(scorecard(visits, clean, expected, shared))


CHECK_STEPS = ("filtered_statistics", "median_method_agreement", "scorecard", "scorecard_summary")


def shared_checks(visits: DataFrame):
    """One stored filter summary for every filter of the check steps."""
    from cohortlens.operators.scorecard import shared_summary
    preds = [p for _, _, p in K.statistic_specs()] + [p for _, p in K.median_specs()]
    for c in K.checks():
        preds += [c.where, c.of] if c.kind == "share" else [c.where]
    return shared_summary(S.labelled_visits(visits), "WAITTIME", preds,
                          scratch_dir(visits.sparkSession, "study-checks"))


STEPS: dict[str, Step] = {
    "scan_visits": scan_visits, "csv_scan": csv_scan, "dataset_shape": dataset_shape,
    "head_sample": head_sample, "column_inventory": column_inventory, "schema_validation": schema_validation,
    "required_columns": required_columns, "cardinality_baseline": cardinality_baseline,
    "clean_universe_two_layer": clean_universe_two_layer, "clean_universe": clean_universe,
    "exclusion_waterfall": exclusion_waterfall, "final_universe": final_universe,
    "layer_accounting": layer_accounting, "frequency_profile": frequency_profile,
    "triage_profile": triage_profile, "profile_subtotals": profile_subtotals,
    "weekday_profile": weekday_profile, "sentinel_hunt": sentinel_hunt, "sentinel_summary": sentinel_summary,
    "top_values": top_values, "top_arrival_times": top_arrival_times, "stacked_profile": stacked_profile,
    "stacked_profile_clean": stacked_profile_clean, "time_range_check": time_range_check,
    "band_ranges_profile": band_ranges_profile, "band_cuts_profile": band_cuts_profile,
    "boarding_status_profile": boarding_status_profile,
    "core_contrast": core_contrast, "distribution_contrast": distribution_contrast,
    "distribution_contrast_approx": distribution_contrast_approx,
    "distribution_contrast_sorted": distribution_contrast_sorted,
    "distribution_contrast_discrete": distribution_contrast_discrete,
    "distribution_contrast_half_even": distribution_contrast_half_even,
    "time_of_day_contrast": time_of_day_contrast, "day_of_week_contrast": day_of_week_contrast,
    "pain_contrast": pain_contrast, "boarding_contrast": boarding_contrast,
    "regional_contrast": regional_contrast, "run_dimension_default": run_dimension_default,
    "time_of_day_cuts_contrast": time_of_day_cuts_contrast, "gap_by_time_cuts": gap_by_time_cuts,
    "boarding_rate": boarding_rate, "boarding_rate_ratio": boarding_rate_ratio,
    "gap_by_triage": gap_by_triage, "gap_by_time": gap_by_time, "gap_by_day": gap_by_day,
    "gap_by_pain": gap_by_pain, "gap_by_region": gap_by_region,
    "study_all_dimensions": study_all_dimensions, "gap_verdict": gap_verdict, "gap_extremes": gap_extremes,
    "mean_median_divergence": mean_median_divergence, "filtered_statistics": filtered_statistics,
    "median_method_agreement": median_method_agreement,
    "scorecard": scorecard, "scorecard_summary": scorecard_summary,
}


# Steps that read the raw visits; every other step reads the clean universe.
VISIT_STEPS = {
    "scan_visits", "csv_scan", "dataset_shape", "head_sample", "column_inventory", "schema_validation",
    "required_columns", "cardinality_baseline", "clean_universe_two_layer", "exclusion_waterfall", "final_universe",
    "layer_accounting", "frequency_profile", "triage_profile", "profile_subtotals", "sentinel_hunt",
    "sentinel_summary", "top_values", "stacked_profile", "scorecard", "scorecard_summary",
}

# Steps about the table itself rather than the typed visit columns.
CATALOG_STEPS = ("column_inventory", "required_columns", "dataset_shape", "head_sample")

# Steps a study run reads off the shared per-dimension statistics table:
# name -> (dimension, rounding) for contrasts; gap steps by dimension.
_SHARED_CONTRASTS = {
    "core_contrast": ("core", "half_up"), "distribution_contrast": ("distribution", "half_up"),
    "distribution_contrast_half_even": ("distribution", "half_even"),
    "time_of_day_contrast": ("time_of_day", "half_up"), "day_of_week_contrast": ("day_of_week", "half_up"),
    "pain_contrast": ("pain", "half_up"), "boarding_contrast": ("boarding", "half_up"),
    "regional_contrast": ("region", "half_up"), "run_dimension_default": (S.DEFAULT_DIMENSION, "half_up"),
    "distribution_contrast_discrete": ("distribution", "half_up", "discrete"),
}
_SHARED_GAPS = {"gap_by_triage": "distribution", "gap_by_time": "time_of_day", "gap_by_day": "day_of_week",
                "gap_by_pain": "pain", "gap_by_region": "region"}
_SHARED_VERDICTS = ("study_all_dimensions", "gap_verdict", "gap_extremes", "mean_median_divergence")
_SHARED_RATES = ("boarding_rate", "boarding_rate_ratio")
SHARED_STEPS = (*_SHARED_CONTRASTS, *_SHARED_GAPS, *_SHARED_VERDICTS, *_SHARED_RATES)


def _boarding_counts(table: DataFrame) -> DataFrame:
    """(ARREMS, boarded rows, rows) of the clean universe, from the boarding
    set of the statistics table."""
    rows = table.filter(F.col("_gid") == F.lit(S._set_gid("boarding_status")))
    boarded = F.col("boarding_status").isin(S.BOARDED_STATUSES)
    return rows.groupBy(S.COHORT).agg(
        F.coalesce(F.sum(F.when(boarded, F.col("_n"))), F.lit(0)).cast("long").alias("_hits"),
        F.sum("_n").cast("long").alias("_rows"))


def _from_statistics(name: str, visits: DataFrame, clean: DataFrame, table: DataFrame) -> DataFrame:
    dtype = clean.schema[S.MEASURE].dataType
    if name in _SHARED_CONTRASTS:
        dim, rounding, *method = _SHARED_CONTRASTS[name]
        return S.contrast_from_statistics(table, dim, method[0] if method else "exact", rounding, dtype)
    if name in _SHARED_GAPS:
        dim = _SHARED_GAPS[name]
        index = GAP_LEVELS[dim]
        con = S.contrast_from_statistics(table, dim, dtype=dtype, keep_code=True)
        if dim == "pain":
            con = con.filter(F.col(index).between(*S.PAIN_GAP_RANGE))
        return G.gap_table(con, index, "arrival_method", "median_wait_minutes", S.GAP_COHORTS, code="level_code")
    if name == "boarding_rate":
        counts = _boarding_counts(table)
        return (counts.orderBy(F.asc_nulls_first(S.COHORT))
                .select(decode_codes(S.COHORT, S.ARRIVAL_LABELS).alias("arrival_method"),
                        F.col("_hits").alias("boarded"), F.col("_rows").alias("total"),
                        rounded_ratio("_hits", "_rows", 2, factor=100).alias("boarding_rate_pct")))
    if name == "boarding_rate_ratio":
        c = _boarding_counts(table)

        def pick(col: str, code: int) -> Column:
            return F.coalesce(F.sum(F.when(F.col(S.COHORT) == F.lit(code), F.col(col))), F.lit(0)).cast("long")
        one = c.agg(pick("_hits", 1).alias("hits_ambulance"), pick("_rows", 1).alias("total_ambulance"),
                    pick("_hits", 2).alias("hits_walk_in"), pick("_rows", 2).alias("total_walk_in"))
        ha, ta, hb, tb = (F.col(x) for x in ("hits_ambulance", "total_ambulance", "hits_walk_in", "total_walk_in"))
        return one.select("hits_ambulance", "total_ambulance", "hits_walk_in", "total_walk_in",
                          rounded_ratio(ha, ta, 2, factor=100).alias("rate_ambulance_pct"),
                          rounded_ratio(hb, tb, 2, factor=100).alias("rate_walk_in_pct"),
                          rounded_ratio(ha.cast("decimal(38,0)") * tb, ta.cast("decimal(38,0)") * hb, 2)
                          .alias("rate_ratio"))
    if name == "study_all_dimensions":
        return S.all_dimensions(visits, clean=clean, stats=table)
    if name == "gap_verdict":
        return G.gap_verdict(S.gap_tables(visits, clean=clean, stats=table), by=["dimension"])
    if name == "gap_extremes":
        return G.gap_extremes(S.gap_tables(visits, clean=clean, stats=table), "level", by=["dimension"])
    return S.divergence_table(visits, clean=clean, stats=table)


def shared_statistics(clean: DataFrame) -> DataFrame:
    """The per-dimension statistics of ``clean`` computed once (one scan)
    and written under the shared checkpoint folder; returns the stored
    table, so every step that reads it neither rescans nor recomputes."""
    spark = clean.sparkSession
    path = scratch_dir(spark, "study-statistics")
    S.dimension_statistics(clean, with_discrete=True).write.mode("error").parquet(path)
    return spark.read.parquet(path)


def shared_counts(visits: DataFrame) -> DataFrame:
    """The profile counts of ``visits`` (``plans.profiles.profile_counts``)
    computed once and stored under the shared checkpoint folder."""
    from cohortlens.plans.profiles import profile_counts
    spark = visits.sparkSession
    path = scratch_dir(spark, "study-counts")
    profile_counts(visits).write.mode("error").parquet(path)
    return spark.read.parquet(path)


def run_study(visits: DataFrame, steps: list[str] | None = None,
              expected: dict[str, float] | None = None, raw: DataFrame | None = None,
              shared: bool = True) -> dict[str, DataFrame]:
    """Every step's output for ``visits`` (DataFrames, study order).

    With ``shared`` (default) the contrasts, gap tables and verdicts of all
    dimensions are read off one statistics table, and the profile and
    exclusion steps off one count table, and the check steps off one filter
    summary; each is computed in a single scan and stored under the shared
    checkpoint folder (``shared_statistics``, ``shared_counts``,
    ``shared_checks``; those jobs run here).  Every other step stays lazy.
    ``expected`` feeds the scorecard (label -> value); without it the
    scorecard compares against the figures by observed values.
    ``raw`` is the table as stored when ``visits`` is a typed projection of
    it (a wide CSV): the catalog steps describe ``raw``.  Steps that write
    (``csv_scan``) run only when named in ``steps``.
    """
    from cohortlens.plans.profiles import FROM_COUNTS
    clean = S.clean_universe(visits)
    names = steps or [n for n in STEPS if n != "csv_scan"]
    table = shared_statistics(clean) if shared and any(n in SHARED_STEPS for n in names) else None
    # profile and exclusion steps: one count table, unless they describe a
    # raw table other than the typed visits
    counted = [n for n in names if n in FROM_COUNTS and not (raw is not None and n in CATALOG_STEPS)]
    counts = shared_counts(visits) if shared and counted else None
    checks = shared_checks(visits) if shared and any(n in CHECK_STEPS for n in names) else None
    out = {}
    for name in names:
        fn = STEPS[name]
        if table is not None and name in SHARED_STEPS:
            out[name] = _from_statistics(name, visits, clean, table)
        elif counts is not None and name in counted:
            out[name] = FROM_COUNTS[name](visits, counts)
        elif name in ("scorecard", "scorecard_summary"):
            out[name] = fn(visits, clean, expected, shared=checks)
        elif name in CHECK_STEPS:
            out[name] = fn(visits, clean, shared=checks)
        elif name in CATALOG_STEPS and raw is not None:
            out[name] = fn(raw, clean)
        else:
            out[name] = fn(visits, clean)
    return out
