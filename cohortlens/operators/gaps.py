"""Gap summaries: cohorts pivoted side by side, the signed gap, and verdicts.

Inputs are contrast outputs (one row per level and cohort, a handful of
rows), so every operator here works on aggregated data.  Pivots are given
the explicit cohort list, which saves the extra job Spark would otherwise
run to discover the pivot values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _keys(index: str | Sequence[str]) -> list[str]:
    return [index] if isinstance(index, str) else list(index)


def gap_table(contrast_df: DataFrame, index: str | Sequence[str], cohort: str, value: str,
              cohorts: Mapping[str, str], gap_name: str = "gap", digits: int = 1,
              code: str | None = None) -> DataFrame:
    """``index`` x cohort pivot of ``value`` plus ``gap = first - second``.

    ``cohorts`` maps cohort label -> output column name, in order (first
    minus second: negative means the first cohort is lower).  A level that
    lacks one cohort gets a NULL there and a NULL gap.  ``code`` names the
    level's code column (``contrast(keep_code=True)``): levels are then paired
    by code, so those that share a label (codes outside a codebook all decode
    to NULL) keep a row each.  Without it, groups that share a label are one
    level, of which the largest value is taken.
    """
    labels = list(cohorts)
    if len(labels) != 2:
        raise ValueError("gap_table needs exactly two cohorts")
    keys = _keys(index)
    by = keys + [code] if code else keys
    wide = contrast_df.groupBy(*by).pivot(cohort, labels).agg(F.max(value))
    a, b = (cohorts[x] for x in labels)
    wide = wide.select(*by, F.col(f"`{labels[0]}`").alias(a), F.col(f"`{labels[1]}`").alias(b))
    return (wide.withColumn(gap_name, F.round(F.col(a) - F.col(b), digits))
            .orderBy(*[F.asc_nulls_first(k) for k in by]).select(*keys, a, b, gap_name))


def gap_verdict(gap_df: DataFrame, gap: str = "gap", by: Sequence[str] = ()) -> DataFrame:
    """One row (per ``by`` group): does the gap keep one sign at every level?"""
    g = F.col(gap)
    out = gap_df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_levels"),
        F.count_if(g < 0).alias("n_negative"),
        F.count_if(g > 0).alias("n_positive"),
        F.count_if(g == 0).alias("n_zero"),
        F.count_if(g.isNull()).alias("n_missing"),
        F.min(g).alias("min_gap"),
        F.max(g).alias("max_gap"),
    )
    verdict = (F.when(F.col("n_negative") == F.col("n_levels"), F.lit("lower at every level"))
               .when(F.col("n_positive") == F.col("n_levels"), F.lit("higher at every level"))
               .otherwise(F.lit("mixed")))
    return out.withColumn("verdict", verdict).orderBy(*by) if by else out.withColumn("verdict", verdict)


def gap_extremes(gap_df: DataFrame, index: str, gap: str = "gap", by: Sequence[str] = ()) -> DataFrame:
    """Levels where |gap| is widest and narrowest (per ``by`` group), every
    tied level kept.  The extremes are window aggregates over the gap rows
    (one row per level, so the window never sees raw data)."""
    w = Window.partitionBy(*by)
    base = (gap_df.filter(F.col(gap).isNotNull())
            .select(*by, index, gap, F.abs(F.col(gap)).alias("abs_gap"))
            .withColumn("_hi", F.max("abs_gap").over(w)).withColumn("_lo", F.min("abs_gap").over(w)))
    tags = F.array_compact(F.array(F.when(F.col("abs_gap") == F.col("_hi"), F.lit("widest")),
                                   F.when(F.col("abs_gap") == F.col("_lo"), F.lit("narrowest"))))
    return (base.select(*by, F.explode(tags).alias("extreme"), index, gap, "abs_gap")
            .orderBy(*by, "extreme", F.asc_nulls_first(index)))


def mean_median_divergence(contrast_df: DataFrame, index: str | Sequence[str], cohort: str, mean: str,
                           median: str,
                           cohorts: Mapping[str, str], digits: int = 1, code: str | None = None) -> DataFrame:
    """Per level: both cohorts' mean and median, the two gaps, and how far
    the median gap departs from the mean gap (``|median_gap - mean_gap|``).
    ``code`` as in ``gap_table``."""
    labels = list(cohorts)
    keys = _keys(index)
    by = keys + [code] if code else keys
    wide = (contrast_df.groupBy(*by).pivot(cohort, labels)
            .agg(F.max(mean).alias("mean"), F.max(median).alias("median")))
    a, b = (cohorts[x] for x in labels)
    cols = {f"mean_{a}": f"{labels[0]}_mean", f"mean_{b}": f"{labels[1]}_mean",
            f"median_{a}": f"{labels[0]}_median", f"median_{b}": f"{labels[1]}_median"}
    wide = wide.select(*by, *[F.col(f"`{src}`").alias(dst) for dst, src in cols.items()])
    mean_gap = F.round(F.col(f"mean_{a}") - F.col(f"mean_{b}"), digits)
    median_gap = F.round(F.col(f"median_{a}") - F.col(f"median_{b}"), digits)
    out = (wide.withColumn("mean_gap", mean_gap).withColumn("median_gap", median_gap)
           .withColumn("divergence", F.round(F.abs(F.col("median_gap") - F.col("mean_gap")), digits))
           .orderBy(*[F.asc_nulls_first(k) for k in by]))
    return out.drop(code) if code else out
