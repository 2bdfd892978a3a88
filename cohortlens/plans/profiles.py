"""One scan for every profile and exclusion step of a study run.

A study run profiles the raw table, the two-layer universe and the clean
universe, and accounts for its exclusions -- eighteen steps that would each
scan the visits.  ``profile_counts`` answers all of them in one pass:
GROUPING SETS over (rule flags, column) for every profiled column, where
the three rule flags are ``column IN (codes)`` kept as nullable booleans
(so SQL ``NOT IN`` semantics survive: a NULL flag is neither kept nor
counted as excluded).  The result is a small table -- one row per flag
combination and distinct value -- from which each step is read with the
same operators as the standalone step (``with_share``, ``top_of_profile``,
``hunt_in_profile``, ``profile_subtotals``, ``accounting_rows``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.labels import decode_codes
from cohortlens.functions.stats import rounded_ratio
from cohortlens.operators import profile as P
from cohortlens.operators.rules import accounting_rows, excluded
from cohortlens.plans import study as S

_FLAGS = {"_a": ("ARREMS", S.ARREMS_RULE["ARREMS"]), "_w": ("WAITTIME", S.WAITTIME_RULE["WAITTIME"]),
          "_i": ("IMMEDR", S.IMMEDR_RULE["IMMEDR"])}


def _profiled() -> dict[str, Column]:
    return {"ARREMS": F.col("ARREMS"), "WAITTIME": F.col("WAITTIME"), "IMMEDR": F.col("IMMEDR"),
            "ARRTIME": F.col("ARRTIME"), "VDAYR": F.col("VDAYR"), "LOV": F.col("LOV"),
            "time_of_day": S.time_band("ARRTIME"), "time_cut": S.time_band_cuts("ARRTIME"),
            "boarding_status": S.boarding_status("BOARDED")}


NAMES = list(_profiled())


def _gid(name: str) -> int:
    k = len(NAMES)
    return (2 ** k - 1) ^ (1 << (k - 1 - NAMES.index(name)))


def profile_counts(visits: DataFrame) -> DataFrame:
    """``(_gid, _a, _w, _i, <profiled columns>, _c)``: rows per rule-flag
    combination and value of each profiled column, from one scan."""
    rows = visits.select(*[excluded(c, codes).alias(f) for f, (c, codes) in _FLAGS.items()],
                         *[e.alias(n) for n, e in _profiled().items()])
    flags = list(_FLAGS)
    return (rows.groupingSets([[*flags, n] for n in NAMES], *flags, *NAMES)
            .agg(F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("_c")))


RAW = F.lit(True)
TWO_LAYER = (F.col("_a") == F.lit(False)) & (F.col("_w") == F.lit(False))
CLEAN = TWO_LAYER & (F.col("_i") == F.lit(False))


def _set(counts: DataFrame, name: str) -> DataFrame:
    return counts.filter(F.col("_gid") == F.lit(_gid(name)))


def _freq(counts: DataFrame, name: str, where: Column, value_name: str = "value") -> DataFrame:
    grouped = (_set(counts, name).filter(where)
               .groupBy(F.col(name).alias(value_name)).agg(F.sum("_c").cast("long").alias("n")))
    return P.with_share(grouped, "n", grouped.select(F.sum("n")).scalar(), "pct_of_total")


def _sum(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("_c"))), F.lit(0)).cast("long")


def frequency_profile(visits, counts):
    return _freq(counts, "ARREMS", RAW).orderBy(F.desc("n"))


def triage_profile(visits, counts):
    return _freq(counts, "IMMEDR", TWO_LAYER, "triage_level").orderBy("triage_level")


def profile_subtotals(visits, counts):
    return P.profile_subtotals(triage_profile(visits, counts), "triage_level", S.IMMEDR_RULE["IMMEDR"])


def weekday_profile(visits, counts):
    freq = _freq(counts, "VDAYR", CLEAN, "vdayr")
    return (freq.select("vdayr", decode_codes("vdayr", S.WEEKDAY_SHORT).alias("label"), "n", "pct_of_total")
            .orderBy("vdayr"))


def sentinel_hunt(visits, counts):
    wait = _set(counts, "WAITTIME")
    hunted = (wait.filter(F.col("WAITTIME").isin(S.WAITTIME_SUSPECT_CODES))
              .groupBy(F.col("WAITTIME").alias("value")).agg(F.sum("_c").cast("long").alias("n")))
    out = P.with_share(hunted, "n", hunted.select(F.sum("n")).scalar(), "pct_of_hunted")
    return P.with_share(out, "n", wait.select(F.sum("_c")).scalar(), "pct_of_total").orderBy(F.desc("n"))


def sentinel_summary(visits, counts):
    out = _set(counts, "WAITTIME").agg(_sum(F.col("WAITTIME").isin(S.WAITTIME_SUSPECT_CODES)).alias("sentinel_rows"),
                                       _sum(RAW).alias("total_records"))
    return out.withColumn("pct_of_total", rounded_ratio("sentinel_rows", "total_records", 2, factor=100))


def top_values(visits, counts):
    return P.top_of_profile(_freq(counts, "WAITTIME", RAW), S.TOP_K)


def top_arrival_times(visits, counts):
    return P.top_of_profile(_freq(counts, "ARRTIME", CLEAN), S.TOP_K)


def stacked_profile(visits, counts):
    def shape(df, name, block, pct="pct_of_total"):
        return df.select(F.lit(name).alias("column_name"), F.col("value").cast("string").alias("value"), "n",
                         F.col(pct).alias("pct_of_total"), F.lit(block).alias("block"))
    wait = _freq(counts, "WAITTIME", RAW)
    blocks = [shape(_freq(counts, "ARREMS", RAW), "ARREMS", "arrival_distribution"),
              shape(P.top_of_profile(wait, S.TOP_K), "WAITTIME", "waittime_top20"),
              shape(P.hunt_in_profile(wait, "value", S.WAITTIME_SUSPECT_CODES), "WAITTIME_PLACEHOLDERS",
                    "placeholder_hunt", pct="pct_of_hunted")]
    return P.stack_blocks(blocks).orderBy("block", F.desc("n"))


def stacked_profile_clean(visits, counts):
    cols = ["value", "n", "pct_of_total"]
    blocks = [P.top_of_profile(_freq(counts, "ARRTIME", CLEAN), S.TOP_K)
              .select(F.lit("ARRTIME").alias("column_name"), *cols),
              _freq(counts, "VDAYR", CLEAN).select(F.lit("VDAYR").alias("column_name"), *cols)]
    return P.stack_blocks(blocks).orderBy("column_name", F.desc("n"))


def time_range_check(visits, counts):
    rows = _set(counts, "ARRTIME").filter(CLEAN)
    return rows.agg(F.min("ARRTIME").alias("min_value"), F.max("ARRTIME").alias("max_value"),
                    _sum(F.col("ARRTIME").isNull()).alias("null_count"), _sum(RAW).alias("n_rows"))


def band_ranges_profile(visits, counts):
    return _freq(counts, "time_of_day", CLEAN, "time_of_day").orderBy("time_of_day")


def band_cuts_profile(visits, counts):
    return _freq(counts, "time_cut", CLEAN, "time_of_day").orderBy("time_of_day")


def boarding_status_profile(visits, counts):
    return _freq(counts, "boarding_status", CLEAN, "boarding_status").orderBy("boarding_status")


def _one_set(counts: DataFrame) -> DataFrame:
    """Every row of the visit table exactly once (the ARREMS set)."""
    return _set(counts, "ARREMS")


def exclusion_waterfall(visits, counts):
    a, w = F.col("_a"), F.col("_w")
    n_fail = F.coalesce(a.cast("int"), F.lit(0)) + F.coalesce(w.cast("int"), F.lit(0))
    out = _one_set(counts).agg(_sum(RAW).alias("total_records"), _sum(a).alias("arrems_excluded"),
                               _sum(w).alias("waittime_excluded"), _sum(n_fail >= 2).alias("multi_rule_excluded"),
                               _sum(n_fail >= 2).alias("overlap_correction"),
                               _sum((n_fail == 0) & (a.isNull() | w.isNull())).alias("null_excluded"),
                               _sum(TWO_LAYER).alias("clean_universe"))
    return out.withColumn("clean_pct_of_total", rounded_ratio("clean_universe", "total_records", 2, factor=100))


def final_universe(visits, counts):
    out = _one_set(counts).agg(_sum(RAW).alias("total_records"), _sum(CLEAN).alias("clean_universe_final"))
    return out.select(
        "total_records", "clean_universe_final",
        rounded_ratio("clean_universe_final", "total_records", 2, factor=100).alias("pct_of_original"),
        (F.col("total_records") - F.col("clean_universe_final")).alias("total_excluded"),
        rounded_ratio(F.col("total_records") - F.col("clean_universe_final"), "total_records", 2,
                      factor=100).alias("total_excluded_pct"))


def layer_accounting(visits, counts):
    wide = _one_set(counts).agg(_sum(RAW).alias("s0"), _sum(TWO_LAYER).alias("s1"), _sum(CLEAN).alias("s2"))
    return accounting_rows(wide, ["start", "ARREMS + WAITTIME", "IMMEDR"])


def dataset_shape(visits, counts):
    first = ", ".join(visits.columns[:10])
    return _one_set(counts).agg(_sum(RAW).alias("n_rows")).select(
        "n_rows", F.lit(len(visits.columns)).cast("int").alias("n_columns"), F.lit(first).alias("first_columns"))


def cardinality_baseline(visits, counts):
    distinct = [F.count_distinct(F.when(F.col("_gid") == F.lit(_gid(c)), F.col(c))).alias(f"distinct_{c.lower()}")
                for c in S.CARDINALITY_COLUMNS]
    return counts.agg(_sum(F.col("_gid") == F.lit(_gid("ARREMS"))).alias("total_records"), *distinct)


FROM_COUNTS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    f.__name__: f for f in (
        frequency_profile, triage_profile, profile_subtotals, weekday_profile, sentinel_hunt, sentinel_summary,
        top_values, top_arrival_times, stacked_profile, stacked_profile_clean, time_range_check,
        band_ranges_profile, band_cuts_profile, boarding_status_profile, exclusion_waterfall, final_universe,
        layer_accounting, dataset_shape, cardinality_baseline)
}
