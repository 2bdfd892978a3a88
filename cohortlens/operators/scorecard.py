"""Tolerance scorecard: recompute every checked figure from the data in one
pass and compare it with an expected value.

A check is ``Check(label, kind, expected, tolerance, where, of)``:

* ``count``  -- rows satisfying ``where`` (all rows when ``where`` is None)
* ``share``  -- 100 * rows(where) / rows(of)
* ``mean``   -- mean of the measure over rows(where)
* ``median`` -- exact median of the measure over rows(where)

PASS when ``|actual - expected| <= tolerance``; a NULL actual is a FAIL.

All figures come from one scan: every row is exploded into the ids of the
filters it satisfies, and a (filter, value) histogram -- partial counts
shuffled by (filter, value) -- yields each filter's rows, sum and median
(``operators.quantiles.histogram_summary``).  No filter's rows are ever
merged in one task; the per-filter summary (one row per distinct filter,
a bound fixed by the check list) is folded into the checks by one
conditional aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.literals import Ref, inline_rows
from cohortlens.functions.stats import mean_from, rounded_ratio
from cohortlens.operators.quantiles import histogram, histogram_summary


@dataclass(frozen=True)
class Check:
    label: str
    kind: str
    expected: float | None   # None: the figure by observed values and coarser rounding
    tolerance: float
    where: Column | None = None
    of: Column | None = None


class FilterSet:
    """Distinct filter predicates, each with an integer id (predicates are
    identified by their expression text, so equal filters share an id)."""

    def __init__(self):
        self.preds: list[Column] = []
        self._ids: dict[str, int] = {}

    def id(self, pred: Column | None) -> int:
        pred = F.lit(True) if pred is None else pred
        key = str(pred)
        if key not in self._ids:
            self._ids[key] = len(self.preds)
            self.preds.append(pred)
        return self._ids[key]


Shared = tuple  # (FilterSet, summary DataFrame) computed once for several reports


def filter_summary(df: DataFrame, measure: str, preds: Sequence[Column], discrete: bool = False) -> DataFrame:
    """One row per filter id ``_k`` with rows satisfying it: ``_n``, ``_nv``,
    ``_sum``, the interpolated ``median`` and (``discrete``) the observed-value
    ``median_disc``.  Filters no row satisfies have no row."""
    ids = F.array_compact(F.array(*[F.when(p, F.lit(i)) for i, p in enumerate(preds)]))
    hist = histogram(df.select(F.explode(ids).alias("_k"), F.col(measure).alias("_m")), ["_k"], "_m")
    out = histogram_summary(hist, ["_k"], {"median": 0.5})
    if discrete:
        disc = histogram_summary(hist, ["_k"], {"median_disc": 0.5}, "discrete").select("_k", "median_disc")
        out = out.join(disc, "_k", "left")
    return out


def _figure(kind: str, where: int, of: int | None, pick, dtype: T.DataType, digits: int,
            observed: bool = False) -> list[Column]:
    """Aggregates over the per-filter summary giving one check's figure, and
    with ``observed`` its reference: the observed-value median, the share to 2
    digits, the mean to 1;
    ``pick(fid, col)`` is the value of ``col`` in filter ``fid``'s row."""
    w_n = F.coalesce(pick(where, "_n"), F.lit(0))
    if kind == "count":
        return [w_n.cast("double")] * (1 + observed)
    if kind == "share":
        return [rounded_ratio(w_n, F.coalesce(pick(of, "_n"), F.lit(0)), d, factor=100)
                for d in ([digits, 2] if observed else [digits])]
    if kind == "mean":
        return [mean_from(pick(where, "_sum"), pick(where, "_nv"), dtype, d)
                for d in ([digits, 1] if observed else [digits])]
    if kind == "median":
        return [pick(where, "median"), *([pick(where, "median_disc")] if observed else [])]
    if kind == "agreement":
        return [pick(where, "median"), pick(where, "median_disc")]
    raise ValueError(f"unknown check kind {kind!r}")


def _figures(df: DataFrame, measure: str, items: list[tuple[str, Column | None, Column | None]],
             digits: int, shared: Shared | None = None, observed: bool = False) -> DataFrame:
    """One row with columns ``f{i}_{j}``: figure j of item i (kind, where, of).

    The per-filter summary (one row per distinct filter) is folded into this
    row by a single conditional aggregate: no join, no driver round trip.
    ``shared`` is a ``(FilterSet, summary)`` pair already holding every
    filter of ``items`` (see ``shared_summary``), so several reports read one
    summary instead of scanning again.
    """
    filters = shared[0] if shared is not None else FilterSet()
    known = len(filters.preds)
    ids = [(kind, filters.id(where), filters.id(of) if kind == "share" else None) for kind, where, of in items]
    if shared is not None:
        if len(filters.preds) != known:
            raise ValueError("the shared summary lacks a filter of these items")
        summ = shared[1]
    else:
        summ = filter_summary(df, measure, filters.preds, discrete=observed or any(k == "agreement" for k, _, _ in items))
    dtype = df.schema[measure].dataType
    picks: dict[tuple[int, str], Column] = {}

    def pick(fid: int, col: str) -> Column:
        # max(CASE WHEN _k = fid THEN col END), built once per (filter, column)
        if (fid, col) not in picks:
            picks[(fid, col)] = F.max(F.when(F.col("_k") == F.lit(fid), F.col(col)))
        return picks[(fid, col)]

    cols = []
    for i, (kind, w, o) in enumerate(ids):
        cols += [e.cast("double").alias(f"f{i}_{j}") for j, e in enumerate(
            _figure(kind, w, o, pick, dtype, digits, observed))]
    return summ.agg(*cols)


def shared_summary(df: DataFrame, measure: str, preds: Sequence[Column | None], path: str) -> Shared:
    """One filter summary (with observed-value medians) for every predicate
    of several reports, computed in one scan and stored at ``path``."""
    filters = FilterSet()
    for p in preds:
        filters.id(p)
    filter_summary(df, measure, filters.preds, discrete=True).write.mode("error").parquet(path)
    return filters, df.sparkSession.read.parquet(path)


def scorecard(df: DataFrame, measure: str, checks: Sequence[Check], digits: int = 4,
              shared: Shared | None = None) -> DataFrame:
    """One row per check: (check_id, label, actual, expected, tolerance, status).

    A check without an expected value is held against the same figure by
    observed values and coarser rounding, from the same histogram."""
    wide = _figures(df, measure, [(c.kind, c.where, c.of) for c in checks], digits, shared,
                    observed=any(c.expected is None for c in checks))
    rows = inline_rows(["check_id", "label", "actual", "expected", "tolerance"],
                       [(i + 1, c.label, Ref(f"f{i}_0"), Ref(f"f{i}_1") if c.expected is None else float(c.expected),
                         float(c.tolerance))
                        for i, c in enumerate(checks)])
    ok = F.abs(F.col("actual") - F.col("expected")) <= F.col("tolerance")
    return (wide.select(rows)
            .withColumn("status", F.when(ok, F.lit("PASS")).otherwise(F.lit("FAIL"))).orderBy("check_id"))


def scorecard_summary(scored: DataFrame) -> DataFrame:
    """One row: passed, total, and the overall verdict."""
    out = scored.agg(F.count_if(F.col("status") == "PASS").alias("passed"),
                     F.count(F.lit(1)).alias("total"))
    return out.withColumn("verdict", F.when(F.col("passed") == F.col("total"), F.lit("ALL PASS"))
                          .otherwise(F.lit("REVIEW")))


def filtered_statistics(df: DataFrame, measure: str, specs: Sequence[tuple[str, str, Column]],
                        digits: int = 4, shared: Shared | None = None) -> DataFrame:
    """Many filtered scalar statistics in **one** pass.

    ``specs`` is ``[(label, 'median' | 'mean' | 'count', predicate), ...]``;
    result: one row per spec, ``(label, statistic, value)``.
    """
    for _, kind, _ in specs:
        if kind not in ("count", "mean", "median"):
            raise ValueError(f"unknown statistic {kind!r}")
    wide = _figures(df, measure, [(kind, pred, None) for _, kind, pred in specs], digits, shared)
    rows = inline_rows(["label", "statistic", "value"],
                       [(label, kind, Ref(f"f{i}_0")) for i, (label, kind, _) in enumerate(specs)])
    return wide.select(rows)


def method_agreement(df: DataFrame, measure: str, specs: Sequence[tuple[str, Column]],
                     tolerance: float = 1.0, shared: Shared | None = None) -> DataFrame:
    """Interpolated median (the pandas flavour) against the observed-value
    median at rank ceil(n/2) (the SQL flavour, what approximate quantiles
    return) for each filter, both from one histogram:
    (label, exact_median, approx_median, delta, tolerance, status).

    The study's cross-flavour reproducibility claim, checkable at any scale.
    """
    wide = _figures(df, measure, [("agreement", pred, None) for _, pred in specs], 4, shared)
    rows = inline_rows(["label", "exact_median", "approx_median"],
                       [(label, Ref(f"f{i}_0"), Ref(f"f{i}_1")) for i, (label, _) in enumerate(specs)])
    delta = F.abs(F.col("exact_median") - F.col("approx_median"))
    return (wide.select(rows)
            .select("label", "exact_median", "approx_median", delta.alias("delta"),
                    F.lit(float(tolerance)).alias("tolerance"),
                    F.when(delta <= F.lit(float(tolerance)), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status")))
