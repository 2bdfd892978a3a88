"""The visit study as one configuration of the
operators: its codebook, exclusion rules, label columns and dimensions.

``clean_universe`` is the shared base relation (defined once, reused by
every dimension).  ``run_dimension`` dispatches one dimension;
``all_dimensions`` answers every dimension from a single scan with
GROUPING SETS.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.labels import band_cuts, band_ranges, classify, decode_codes
from cohortlens.functions.stats import QUANTILE_PROBS, mean_expr, mean_from, quantile_exprs, round_value
from cohortlens.operators.contrasts import contrast, present
from cohortlens.operators.gaps import gap_table, mean_median_divergence
from cohortlens.operators.quantiles import histogram_summary
from cohortlens.operators.rules import exclude_codes, keep_mask

# ---------------------------------------------------------------------------
# Codebook labels, exclusion codes and bands of the study.
# They must equal the study's own values for the results to match.
# ---------------------------------------------------------------------------
ARRIVAL_LABELS = {1: "Ambulance", 2: "Walk-in"}
TRIAGE_LABELS = {1: "1 - Immediate", 2: "2 - Emergent", 3: "3 - Urgent", 4: "4 - Semi-urgent",
                 5: "5 - Non-urgent"}
WEEKDAY_LABELS = {1: "1 - Sunday", 2: "2 - Monday", 3: "3 - Tuesday", 4: "4 - Wednesday",
                  5: "5 - Thursday", 6: "6 - Friday", 7: "7 - Saturday"}
WEEKDAY_SHORT = {1: "Sunday", 2: "Monday", 3: "Tuesday", 4: "Wednesday", 5: "Thursday",
                 6: "Friday", 7: "Saturday"}
REGION_LABELS = {1: "1 - Northeast", 2: "2 - Midwest", 3: "3 - South", 4: "4 - West"}
TIME_BANDS = [(0, 559, "1 - Overnight (0000-0559)"), (600, 1159, "2 - Morning (0600-1159)"),
              (1200, 1759, "3 - Afternoon (1200-1759)"), (1800, 2359, "4 - Evening (1800-2359)")]
TIME_CUT_EDGES = [-1, 559, 1159, 1759, 2359]
BOARDING_RULES = [("eq", -7, "Not Boarded"), ("eq", -9, "Unknown"), ("eq", 0, "Boarded - 0 min"),
                  ("gt", 0, "Boarded - >0 min")]
BOARDED_STATUSES = ["Boarded - 0 min", "Boarded - >0 min"]
ARREMS_RULE = {"ARREMS": [-9, -8]}
WAITTIME_RULE = {"WAITTIME": [-9, -7, 99]}
IMMEDR_RULE = {"IMMEDR": [-9, -8, 0, 7]}
TWO_LAYER_RULES = {**ARREMS_RULE, **WAITTIME_RULE}
CLEAN_RULES = {**ARREMS_RULE, **WAITTIME_RULE, **IMMEDR_RULE}
WAITTIME_SUSPECT_CODES = [-9, -8, -7, 99, 999, 9999]
CARDINALITY_COLUMNS = ["ARREMS", "WAITTIME", "IMMEDR", "LOV"]
SCHEMA_CHECK_COLUMNS = ["ARREMS", "WAITTIME", "IMMEDR", "LOV"]
CORE_COLUMNS = ["VMONTH", "VDAYR", "ARRTIME", "WAITTIME", "LOV", "AGE", "ARREMS", "IMMEDR",
                "PAINSCALE", "TOTCHRON", "ADMIT", "REGION", "PATWT", "EDWT", "BOARDED"]
HEAD_COLUMNS = ["ARREMS", "WAITTIME", "IMMEDR", "ARRTIME", "VDAYR", "PAINSCALE", "BOARDED", "REGION"]
TOP_K = 20
PAIN_GAP_RANGE = (0, 10)
# ---------------------------------------------------------------------------

COHORT = "ARREMS"
MEASURE = "WAITTIME"
GAP_COHORTS = {"Ambulance": "ambulance", "Walk-in": "walk_in"}
BASE_COLUMNS = ["ARREMS", "WAITTIME", "IMMEDR", "ARRTIME", "VDAYR", "PAINSCALE", "BOARDED", "REGION"]


def time_band(col: str = "ARRTIME") -> Column:
    """Closed staffing bands with gaps (SQL flavour)."""
    return band_ranges(col, TIME_BANDS)


def time_band_cuts(col: str = "ARRTIME") -> Column:
    """Left-open right-closed cuts without gaps (pandas flavour)."""
    return band_cuts(col, TIME_CUT_EDGES, [label for _, _, label in TIME_BANDS])


def boarding_status(col: str = "BOARDED") -> Column:
    return classify(col, BOARDING_RULES)


def label_columns() -> dict[str, Column]:
    """Every label of the study, derived once on the base relation."""
    return {
        "arrival_method": decode_codes("ARREMS", ARRIVAL_LABELS),
        "triage_level": decode_codes("IMMEDR", TRIAGE_LABELS),
        "time_of_day": time_band("ARRTIME"),
        "day_of_week": decode_codes("VDAYR", WEEKDAY_LABELS),
        "boarding_status": boarding_status("BOARDED"),
        "census_region": decode_codes("REGION", REGION_LABELS),
    }


def clean_universe(visits: DataFrame, rules=None) -> DataFrame:
    """Rows passing all three exclusion layers, 8 base columns + 6 labels.

    Lazy: nothing runs until an action; Catalyst prunes whatever label a
    given dimension does not use.
    """
    base = exclude_codes(visits, rules or CLEAN_RULES).select(*BASE_COLUMNS)
    return base.withColumns(label_columns())


@dataclass(frozen=True)
class Dimension:
    """One contrast dimension: how to group, name and order its level."""
    level: str                          # grouping column in the clean universe
    level_name: str                     # output column name of the level
    level_labels: dict | None = None    # decode the level code after aggregation
    stats: tuple = ("n", "avg", "median")
    level_first: bool = False
    order_by: tuple | None = None
    extra: dict = field(default_factory=dict)


DIMENSIONS: dict[str, Dimension] = {
    "core": Dimension("IMMEDR", "triage_level", TRIAGE_LABELS, ("n", "avg", "min", "max")),
    "distribution": Dimension("IMMEDR", "triage_level", TRIAGE_LABELS, ("n", "avg", "median", "p25", "p75")),
    "time_of_day": Dimension("time_of_day", "time_of_day"),
    "day_of_week": Dimension("VDAYR", "day_of_week", WEEKDAY_LABELS),
    "pain": Dimension("PAINSCALE", "pain_score"),
    "boarding": Dimension("boarding_status", "boarding_status", None, ("n", "share", "avg", "median"),
                          order_by=("arrival_method", "boarding_status")),
    "region": Dimension("REGION", "census_region", REGION_LABELS, level_first=True),
}
DEFAULT_DIMENSION = "distribution"


def run_dimension(visits: DataFrame, name: str = DEFAULT_DIMENSION, method: str = "exact",
                  rounding: str = "half_up") -> DataFrame:
    """The contrast of one dimension over the clean universe of ``visits``."""
    return dimension_contrast(clean_universe(visits), name, method, rounding)


def dimension_contrast(clean: DataFrame, name: str = DEFAULT_DIMENSION, method: str = "exact",
                       rounding: str = "half_up", keep_code: bool = False) -> DataFrame:
    """The contrast of one dimension over an already-built clean universe."""
    d = DIMENSIONS[name]
    return contrast(
        clean, COHORT, d.level, MEASURE, stats=d.stats, method=method, rounding=rounding,
        cohort_labels=ARRIVAL_LABELS, level_labels=d.level_labels, cohort_name="arrival_method",
        level_name=d.level_name, share_name="pct_of_arrival_method", level_first=d.level_first,
        order_by=list(d.order_by) if d.order_by else None, keep_code=keep_code,
    )


# Level columns of the dimension sets, one grouping set each (core and
# distribution share the triage set).
STAT_LEVELS = ["IMMEDR", "time_of_day", "VDAYR", "PAINSCALE", "boarding_status", "REGION"]


def _set_gid(level: str) -> int:
    """grouping_id() of the set that groups ``level`` (cohort and value bits 0)."""
    k = len(STAT_LEVELS)
    return (2 ** k - 1) ^ (1 << (k - 1 - STAT_LEVELS.index(level)))


def dimension_statistics(clean: DataFrame, method: str = "exact", with_discrete: bool = False) -> DataFrame:
    """Every statistic of every dimension from ONE scan of the clean universe.

    GROUPING SETS over (cohort, value, level_i) give one histogram for all
    dimensions (partial counts shuffled by value); each (set, cohort, level)
    row then carries ``_n``, ``_nv``, ``_sum``, ``_min``, ``_max`` and the
    quartiles (unrounded).  The result is small -- one row per group of every
    dimension -- and a whole study run derives all its contrasts, gap tables
    and verdicts from it (``contrast_from_statistics``, ``all_dimensions``).
    ``with_discrete`` adds the observed-value quartiles (``p25_disc``...)
    from the same histogram.
    """
    kind = "interpolated" if method == "exact" else "discrete"
    hist = (clean.groupingSets([[COHORT, MEASURE, lvl] for lvl in STAT_LEVELS], COHORT, MEASURE, *STAT_LEVELS)
            .agg(F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("_c"))
            .withColumnRenamed(MEASURE, "_v"))
    keys = ["_gid", COHORT, *STAT_LEVELS]
    out = histogram_summary(hist, keys, QUANTILE_PROBS, kind)
    if not with_discrete or kind == "discrete":
        return out
    # observed-value quartiles from the same histogram (the SQL flavour)
    disc = histogram_summary(hist, keys, {f"{n}_disc": p for n, p in QUANTILE_PROBS.items()}, "discrete")
    disc = disc.select(*[F.col(k).alias(f"_d{k}") for k in keys], *[f"{n}_disc" for n in QUANTILE_PROBS])
    cond = None
    for k in keys:
        term = out[k].eqNullSafe(disc[f"_d{k}"])
        cond = term if cond is None else cond & term
    return out.join(disc, cond, "left").drop(*[f"_d{k}" for k in keys])


def _round_stats(rows: DataFrame, level: str, dtype, discrete: bool, rounding: str, digits: int = 1) -> DataFrame:
    """(cohort, level, _n, _n_valid, _avg, _min, _max, _p25, _median, _p75) rounded as ``contrast`` does."""
    def q(c: str) -> Column:
        return (F.col(c) if discrete else round_value(F.col(c), digits, rounding)).cast("double")
    return rows.select(COHORT, level, F.col("_n"), F.col("_nv").alias("_n_valid"),
                       mean_from(F.col("_sum"), F.col("_nv"), dtype, digits, rounding).alias("_avg"),
                       round_value(F.col("_min").cast("double"), digits, rounding).alias("_min"),
                       round_value(F.col("_max").cast("double"), digits, rounding).alias("_max"),
                       *[q(n).alias(f"_{n}") for n in QUANTILE_PROBS])


def contrast_from_statistics(table: DataFrame, name: str = DEFAULT_DIMENSION, method: str = "exact",
                             rounding: str = "half_up", dtype=None, keep_code: bool = False) -> DataFrame:
    """``dimension_contrast`` of one dimension, read off ``dimension_statistics``
    (same columns, values and order)."""
    d = DIMENSIONS[name]
    rows = table.filter(F.col("_gid") == F.lit(_set_gid(d.level)))
    if method == "discrete" and "median_disc" in table.columns:
        rows = rows.select(*[c for c in rows.columns if c not in QUANTILE_PROBS],
                           *[F.col(f"{n}_disc").alias(n) for n in QUANTILE_PROBS])
    grouped = _round_stats(rows, d.level, dtype or T.IntegerType(), method == "discrete", rounding)
    return present(grouped, COHORT, d.level, stats=d.stats, cohort_labels=ARRIVAL_LABELS,
                   level_labels=d.level_labels, cohort_name="arrival_method", level_name=d.level_name,
                   share_name="pct_of_arrival_method", level_first=d.level_first,
                   order_by=list(d.order_by) if d.order_by else None, rounding=rounding, keep_code=keep_code)


# Dimensions answered together by ``all_dimensions`` (core/distribution share
# one grouping, so the triage grouping appears once).
_SET_LEVELS = [("triage", "IMMEDR", TRIAGE_LABELS), ("time_of_day", "time_of_day", None),
               ("day_of_week", "VDAYR", WEEKDAY_LABELS), ("pain", "PAINSCALE", None),
               ("boarding", "boarding_status", None), ("region", "REGION", REGION_LABELS)]


def all_dimensions(visits: DataFrame, method: str = "exact", clean: DataFrame | None = None,
                   stats: DataFrame | None = None, keep_code: bool = False) -> DataFrame:
    """Every dimension from one scan: ``GROUPING SETS`` over (cohort, level_i).

    The Expand that feeds the sets sits in the same codegen stage as the
    partial aggregate, so the copies never reach the shuffle.  With the
    exact (default) and discrete methods the sets group (cohort, value,
    level_i): one histogram for every dimension, shuffled by value so no
    group is merged in one task, then each group's statistics from its
    distinct values.  Output shape:
    (dimension, arrival_method, level, n, avg_wait_minutes, median_wait_minutes),
    with ``keep_code`` also the level's code as text, ``level_code``.
    """
    cu = (clean if clean is not None else clean_universe(visits)) \
        .withColumn("PAINSCALE_S", F.col("PAINSCALE").cast("string"))
    levels = [lvl if lvl != "PAINSCALE" else "PAINSCALE_S" for _, lvl, _ in _SET_LEVELS]
    dtype = cu.schema[MEASURE].dataType
    if method in ("exact", "discrete"):
        table = stats if stats is not None else dimension_statistics(clean if clean is not None
                                                                     else clean_universe(visits), method)
        return _dimensions_from_statistics(table, method, dtype, keep_code)
    else:
        q = quantile_exprs(MEASURE, ["median"], method)
        grouped = cu.groupingSets([[COHORT, lvl] for lvl in levels], COHORT, *levels).agg(
            F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n"),
            mean_expr(MEASURE, dtype, 1).alias("avg_wait_minutes"), q["median"].alias("median_wait_minutes"))
    # grouping_id() spans the grouping columns; the cohort (and value) bits
    # are always 0 and the bit of level i is 0 only in the set grouping it.
    k = len(levels)
    dim = level = None
    for i, ((name, _, labels), lvl) in enumerate(zip(_SET_LEVELS, levels)):
        gid = (2 ** k - 1) ^ (1 << (k - 1 - i))
        lab = decode_codes(lvl, labels) if labels else F.col(lvl)
        hit = F.col("_gid") == gid
        dim = F.when(hit, F.lit(name)) if dim is None else dim.when(hit, F.lit(name))
        level = F.when(hit, lab) if level is None else level.when(hit, lab)
    out = grouped.select(dim.alias("dimension"), decode_codes(COHORT, ARRIVAL_LABELS).alias("arrival_method"),
                         level.alias("level"), "n", "avg_wait_minutes", "median_wait_minutes",
                         _level_code(levels).alias("level_code"))
    return out if keep_code else out.drop("level_code")


def _level_code(levels: list[str]) -> Column:
    """The level's code as text: a row of a set has a value in its level alone."""
    return F.coalesce(*[F.col(c).cast("string") for c in levels])


def _dimensions_from_statistics(table: DataFrame, method: str, dtype, keep_code: bool = False) -> DataFrame:
    """The ``all_dimensions`` shape read off ``dimension_statistics``."""
    dim = level = None
    for name, lvl, labels in _SET_LEVELS:
        hit = F.col("_gid") == F.lit(_set_gid(lvl))
        lab = decode_codes(lvl, labels) if labels else F.col(lvl).cast("string")
        dim = F.when(hit, F.lit(name)) if dim is None else dim.when(hit, F.lit(name))
        level = F.when(hit, lab) if level is None else level.when(hit, lab)
    med = F.col("median") if method == "discrete" else F.round(F.col("median"), 1)
    out = table.select(dim.alias("dimension"), decode_codes(COHORT, ARRIVAL_LABELS).alias("arrival_method"),
                       level.alias("level"), F.col("_n").alias("n"),
                       mean_from(F.col("_sum"), F.col("_nv"), dtype, 1).alias("avg_wait_minutes"),
                       med.cast("double").alias("median_wait_minutes"),
                       _level_code([lvl for _, lvl, _ in _SET_LEVELS]).alias("level_code"))
    return out if keep_code else out.drop("level_code")


def labelled_visits(visits: DataFrame) -> DataFrame:
    """All rows with the study's labels and an ``in_clean`` flag, so checks
    over the raw table and over the clean universe share one scan."""
    return visits.withColumns({**label_columns(),
                               "in_clean": F.coalesce(keep_mask(CLEAN_RULES), F.lit(False))})


def _gap_input(visits: DataFrame, method: str, clean: DataFrame | None = None,
               stats: DataFrame | None = None) -> DataFrame:
    """All-dimension contrast rows that enter the gap family: every dimension
    but boarding, and pain scores 0-10 only (sentinel scores stay out)."""
    dims = all_dimensions(visits, method, clean, stats, keep_code=True)
    lo, hi = PAIN_GAP_RANGE
    pain_ok = F.col("level").try_cast("int").between(lo, hi)
    return dims.filter((F.col("dimension") != "boarding")
                       & ((F.col("dimension") != "pain") | F.coalesce(pain_ok, F.lit(False))))


def gap_tables(visits: DataFrame, method: str = "exact", clean: DataFrame | None = None,
               stats: DataFrame | None = None) -> DataFrame:
    """(dimension, level, ambulance, walk_in, gap) of medians for every
    dimension, from the single GROUPING SETS scan."""
    return gap_table(_gap_input(visits, method, clean, stats), ["dimension", "level"], "arrival_method",
                     "median_wait_minutes", GAP_COHORTS, code="level_code")


def divergence_table(visits: DataFrame, method: str = "exact", clean: DataFrame | None = None,
                     stats: DataFrame | None = None) -> DataFrame:
    """Mean gap versus median gap per (dimension, level)."""
    return mean_median_divergence(_gap_input(visits, method, clean, stats), ["dimension", "level"], "arrival_method",
                                  "avg_wait_minutes", "median_wait_minutes", GAP_COHORTS, code="level_code")
