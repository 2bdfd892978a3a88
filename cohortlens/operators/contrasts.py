"""Cohort contrasts: a measure compared between cohorts at every level of a
control dimension, plus shares, rates and rate ratios inside cohorts.

Physical shape of ``contrast`` with quartiles (the default ``exact``):
scan -> filter -> partial counts per (cohort, level, value) on the
executors -> shuffle on (cohort, level, value) -> ``percentile`` with the
counts as frequencies per (cohort, level) -> labels on the few group rows.
A hot cohort (one group holding a third of the rows) is pre-aggregated
map-side and spread over the reducers by value; each group's final merge
combines one partial state per histogram partition.  Without quartiles a
contrast is a plain partial aggregate of fixed-size states (count, sum,
min, max) and one shuffle on (cohort, level).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.labels import decode_codes
from cohortlens.functions.stats import (
    QUANTILE_PROBS, mean_expr, mean_from, quantile_exprs, round_value, rounded_ratio,
)
from cohortlens.operators.quantiles import exact_quantiles, histogram, histogram_summary
from cohortlens.operators.selection import refined_quantiles

_SORTED = {"exact_sorted": exact_quantiles, "exact_refined": refined_quantiles}
STAT_ORDER = ("n", "n_valid", "share", "avg", "min", "max", "median", "p25", "p75")


def _labelled(code: str, labels: Mapping | None, name: str) -> Column:
    return (decode_codes(code, labels) if labels else F.col(code)).alias(name)


def contrast(df: DataFrame, cohort: str, level: str, measure: str, *,
             stats: Sequence[str] = ("n", "avg", "median", "p25", "p75"),
             method: str = "exact", digits: int = 1, suffix: str = "wait_minutes",
             cohort_labels: Mapping | None = None, level_labels: Mapping | None = None,
             cohort_name: str | None = None, level_name: str | None = None,
             share_name: str = "pct_of_cohort", level_first: bool = False,
             order_by: Sequence[str] | None = None, rounding: str = "half_up",
             drop_unlabelled: bool = False, keep_code: bool = False, salts: int = 32,
             sketch_k: int = 400) -> DataFrame:
    """Per (cohort, level): ``n`` (COUNT(*)), ``n_valid`` (non-NULL measure
    values), share of the cohort, mean, min, max and quartiles of ``measure``.

    ``method`` -- how quartiles (and, for the histogram methods, every
    statistic) are computed:

    * ``exact`` (default): interpolated quartiles (the pandas flavour) from
      the (cohort, level, value) histogram.  One shuffle of partial counts
      spreads a hot group over the reducers by value; the per-group work is
      bounded by the group's *distinct values*.  For measures drawn from a
      bounded set (codes, minutes).
    * ``discrete``: the same histogram, observed-value quartiles at rank
      ceil(n*p) (the SQL flavour, computed exactly).
    * ``exact_sorted``: exact for measures with unbounded distinct values
      (``operators.quantiles.exact_quantiles``; a range shuffle and one
      table write under the checkpoint folder).
    * ``exact_refined``: the same numbers by refining histograms
      (``operators.selection.refined_quantiles``): no value is shuffled or
      stored, the rows are read a few times more.
    * ``sketch``: approximate observed-value quartiles from KLL sketches
      merged in two levels: partial sketches per (cohort, level, salt), the
      salt a hash of the value (``salts`` of them), then one merge of
      ``salts`` sketches per group -- a hot group is split across tasks even
      for measures with unbounded values.  Randomised, rank error about
      1.7 / ``sketch_k`` ** 0.9.
    * ``approx``: ``percentile_approx`` sketches (bounded memory per group).
    * ``percentile``: Spark's ``percentile`` aggregate (a value->count map
      per group, merged in one task per group).

    ``rounding``: ``half_up`` (SQL flavour, default) or ``half_even``
    (pandas flavour); it only matters for values ending in an exact half.
    ``drop_unlabelled``: drop groups whose cohort or level label is NULL
    (the pandas flavour); by default they are kept (the SQL flavour).
    ``keep_code`` adds the level's code as ``level_code``.

    Groups are formed on the raw codes and decoded afterwards, so the CASE
    for a label runs once per group.  Codes outside a codebook survive as a
    NULL-labelled group.  Output is sorted by (level code, cohort code)
    unless ``order_by`` names output columns.
    """
    dtype = df.schema[measure].dataType
    x = F.col(measure)
    qnames = [s for s in ("median", "p25", "p75") if s in stats]
    probs = {n: QUANTILE_PROBS[n] for n in qnames}
    # The histogram is for quantiles.  Counts, sums, minima and maxima have
    # fixed-size partial states, so a plain partial aggregate is already
    # skew-proof for them and needs one shuffle fewer.
    if method in ("exact", "discrete") and qnames:
        grouped = _from_histogram(df, cohort, level, measure, dtype, probs, stats, digits, rounding,
                                  "interpolated" if method == "exact" else "discrete")
    elif method == "sketch":
        grouped = _from_sketches(df, cohort, level, measure, dtype, probs, stats, digits, rounding,
                                 salts, sketch_k)
    else:
        aggs: dict[str, Column] = {"n": F.count(F.lit(1)), "n_valid": F.count(x)}
        if "avg" in stats:
            aggs["avg"] = mean_expr(x, dtype, digits, rounding)
        if "min" in stats:
            aggs["min"] = round_value(F.min(x).cast("double"), digits, rounding)
        if "max" in stats:
            aggs["max"] = round_value(F.max(x).cast("double"), digits, rounding)
        if qnames and method not in _SORTED:
            aggs.update(quantile_exprs(x, qnames, method, digits, rounding=rounding))
        grouped = df.groupBy(cohort, level).agg(*[e.alias(f"_{k}") for k, e in aggs.items()])
        if qnames and method in _SORTED:
            # Distributed exact quantiles (no per-group state); joined back on
            # the group keys -- both sides hold one row per group.
            q = _SORTED[method](df, [cohort, level], measure, probs, digits=digits, rounding=rounding)
            q = q.select(*[F.col(c).alias(f"_q_{c}") for c in (cohort, level)],
                         *[F.col(n).alias(f"_{n}") for n in qnames])
            cond = grouped[cohort].eqNullSafe(q[f"_q_{cohort}"]) & grouped[level].eqNullSafe(q[f"_q_{level}"])
            grouped = grouped.join(q, cond, "left").drop(f"_q_{cohort}", f"_q_{level}")
    return present(grouped, cohort, level, stats=stats, suffix=suffix, cohort_labels=cohort_labels,
                   level_labels=level_labels, cohort_name=cohort_name, level_name=level_name,
                   share_name=share_name, level_first=level_first, order_by=order_by, rounding=rounding,
                   drop_unlabelled=drop_unlabelled, keep_code=keep_code)


def present(grouped: DataFrame, cohort: str, level: str, *, stats: Sequence[str], suffix: str = "wait_minutes",
            cohort_labels: Mapping | None = None, level_labels: Mapping | None = None,
            cohort_name: str | None = None, level_name: str | None = None,
            share_name: str = "pct_of_cohort", level_first: bool = False,
            order_by: Sequence[str] | None = None, rounding: str = "half_up",
            drop_unlabelled: bool = False, keep_code: bool = False) -> DataFrame:
    """Second half of ``contrast``: from one row per (cohort code, level
    code) with the statistics in ``_n``, ``_avg``, ``_median``... (already
    rounded) to the output -- share of the cohort, labels decoded on the
    group keys, named statistic columns, sorted by codes."""
    if "share" in stats:
        grouped = grouped.withColumn("_share", share_within("_n", [cohort], rounding=rounding))
    cohort_name = cohort_name or cohort
    level_name = level_name or level
    label_cols = [_labelled(cohort, cohort_labels, cohort_name), _labelled(level, level_labels, level_name)]
    if level_first:
        label_cols.reverse()
    names = {"n": "n", "n_valid": "n_valid", "share": share_name}
    stat_cols = [F.col(f"_{s}").alias(names.get(s, f"{s}_{suffix}")) for s in STAT_ORDER if s in stats]
    out = grouped.select(*label_cols, *stat_cols, F.col(level).alias("_lvl"), F.col(cohort).alias("_coh"))
    if drop_unlabelled:
        out = out.filter(F.col(cohort_name).isNotNull() & F.col(level_name).isNotNull())
    keys = list(order_by) if order_by else [F.asc_nulls_first("_lvl"), F.asc_nulls_first("_coh")]
    out = out.orderBy(*keys).drop("_coh")
    return out.withColumnRenamed("_lvl", "level_code") if keep_code else out.drop("_lvl")


def _from_histogram(df: DataFrame, cohort: str, level: str, measure: str, dtype, probs, stats, digits: int,
                    rounding: str, kind: str) -> DataFrame:
    """Every statistic of each (cohort, level) from its value histogram."""
    summ = histogram_summary(histogram(df, [cohort, level], measure), [cohort, level], probs, kind)
    cols = [F.col(cohort), F.col(level), F.col("_n"), F.col("_nv").alias("_n_valid")]
    if "avg" in stats:
        cols.append(mean_from(F.col("_sum"), F.col("_nv"), dtype, digits, rounding).alias("_avg"))
    if "min" in stats:
        cols.append(round_value(F.col("_min").cast("double"), digits, rounding).alias("_min"))
    if "max" in stats:
        cols.append(round_value(F.col("_max").cast("double"), digits, rounding).alias("_max"))
    for n in probs:
        q = F.col(n) if kind == "discrete" else round_value(F.col(n), digits, rounding)
        cols.append(q.cast("double").alias(f"_{n}"))
    return summ.select(*cols)


def _from_sketches(df: DataFrame, cohort: str, level: str, measure: str, dtype, probs, stats, digits: int,
                   rounding: str, salts: int, sketch_k: int) -> DataFrame:
    """Every statistic of each (cohort, level) from a two-level aggregate:
    fixed-size partials and a KLL sketch per (group, salt), then per group."""
    integral = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    agg_fn, merge_fn, get_fn = ((F.kll_sketch_agg_bigint, F.kll_merge_agg_bigint, F.kll_sketch_get_quantile_bigint)
                                if integral else
                                (F.kll_sketch_agg_double, F.kll_merge_agg_double, F.kll_sketch_get_quantile_double))
    x = F.col(measure)
    v = x.cast("long") if integral else x.cast("double")
    salt = F.pmod(F.xxhash64(x), F.lit(salts))
    part = df.groupBy(cohort, level, salt.alias("_salt")).agg(
        F.count(F.lit(1)).alias("_n"), F.count(x).alias("_nv"), F.sum(x).alias("_sum"),
        F.min(x).alias("_mn"), F.max(x).alias("_mx"), agg_fn(v, F.lit(sketch_k)).alias("_sk"))
    whole = part.groupBy(cohort, level).agg(
        F.sum("_n").alias("_n"), F.sum("_nv").alias("_nv"), F.sum("_sum").alias("_sum"),
        F.min("_mn").alias("_mn"), F.max("_mx").alias("_mx"), merge_fn("_sk", F.lit(sketch_k)).alias("_sk"))
    cols = [F.col(cohort), F.col(level), F.col("_n"), F.col("_nv").alias("_n_valid")]
    if "avg" in stats:
        cols.append(mean_from(F.col("_sum"), F.col("_nv"), dtype, digits, rounding).alias("_avg"))
    if "min" in stats:
        cols.append(round_value(F.col("_mn").cast("double"), digits, rounding).alias("_min"))
    if "max" in stats:
        cols.append(round_value(F.col("_mx").cast("double"), digits, rounding).alias("_max"))
    for n, p in probs.items():
        q = F.when(F.col("_nv") > 0, get_fn(F.col("_sk"), F.lit(float(p))))
        cols.append(q.cast("double").alias(f"_{n}"))
    return whole.select(*cols)


def share_within(n_col: str, partition: Sequence[str], digits: int = 2, rounding: str = "half_up") -> Column:
    """``n * 100 / SUM(n) OVER (PARTITION BY partition)`` over *aggregated*
    rows (the window sees groups, never raw rows)."""
    return rounded_ratio(n_col, F.sum(n_col).over(Window.partitionBy(*partition)), digits, factor=100,
                         rounding=rounding)


def cohort_rate(df: DataFrame, cohort: str, predicate: Column, *, cohort_labels: Mapping | None = None,
                cohort_name: str | None = None, numerator: str = "hits", denominator: str = "total",
                rate_name: str = "rate_pct", digits: int = 2) -> DataFrame:
    """Per cohort: rows satisfying ``predicate``, all rows, and the rate in %."""
    grouped = df.groupBy(cohort).agg(F.count_if(predicate).alias(numerator),
                                     F.count(F.lit(1)).alias(denominator))
    return (grouped.orderBy(F.asc_nulls_first(cohort))
            .select(_labelled(cohort, cohort_labels, cohort_name or cohort), numerator, denominator,
                    rounded_ratio(numerator, denominator, digits, factor=100).alias(rate_name)))


def rate_ratio(df: DataFrame, cohort: str, predicate: Column, a: object, b: object, *,
               names: tuple[str, str] = ("a", "b"), digits: int = 2) -> DataFrame:
    """One row: the rate of cohort ``a``, of cohort ``b`` and their ratio.

    Conditional counts in one pass; the ratio is computed exactly from the
    four counts, ``(hits_a * total_b) / (total_a * hits_b)``; NULL when a
    denominator is zero (no error under ANSI mode).
    """
    in_a, in_b = F.col(cohort) == F.lit(a), F.col(cohort) == F.lit(b)
    na, nb = names
    counts = df.agg(F.count_if(in_a & predicate).alias(f"hits_{na}"), F.count_if(in_a).alias(f"total_{na}"),
                    F.count_if(in_b & predicate).alias(f"hits_{nb}"), F.count_if(in_b).alias(f"total_{nb}"))
    ha, ta, hb, tb = (F.col(f"hits_{na}"), F.col(f"total_{na}"), F.col(f"hits_{nb}"), F.col(f"total_{nb}"))
    return counts.select(
        f"hits_{na}", f"total_{na}", f"hits_{nb}", f"total_{nb}",
        rounded_ratio(ha, ta, digits, factor=100).alias(f"rate_{na}_pct"),
        rounded_ratio(hb, tb, digits, factor=100).alias(f"rate_{nb}_pct"),
        rounded_ratio(ha.cast("decimal(38,0)") * tb, ta.cast("decimal(38,0)") * hb, digits).alias("rate_ratio"),
    )
