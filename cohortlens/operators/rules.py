"""Layered exclusion rules and the accounting of every excluded row.

A rule set is ``{column: [codes to exclude]}``.  Rules are per column, never
global: the same code (0, 99, -7) is a sentinel in one column and data in
another.  NULL follows SQL ``NOT IN``: the predicate is NULL and the row is
dropped.  All counts come from one pass (one aggregate with ``count_if``),
and the filter is a plain ``Not(In)`` that Parquet can push down when the
columns are stored ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.literals import sql_literal, sql_name
from cohortlens.functions.stats import rounded_ratio

Rules = Mapping[str, Sequence[int]]


def excluded(column: str, codes: Sequence[int]) -> Column:
    """Row is caught by this rule (NULL when the column is NULL)."""
    if not codes:
        return F.lit(False)
    return F.expr(f"{sql_name(column)} IN ({', '.join(sql_literal(c) for c in codes)})")


def keep_mask(rules: Rules) -> Column:
    """Conjunction of ``NOT IN`` over all rules."""
    mask = None
    for column, codes in rules.items():
        term = ~excluded(column, codes)
        mask = term if mask is None else (mask & term)
    return mask if mask is not None else F.lit(True)


def exclude_codes(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows passing every rule."""
    return df.filter(keep_mask(rules))


def waterfall(df: DataFrame, rules: Rules, survivor_name: str = "clean_universe",
              pct_name: str = "clean_pct_of_total") -> DataFrame:
    """One row: total, rows caught by each rule, rows caught by more than one
    rule, the overlap correction, rows dropped for a NULL alone, survivors and
    survivors as % of total.

    ``overlap_correction`` counts every catch of a row beyond its first and
    ``null_excluded`` the rows that no rule catches but a NULL in a ruled
    column drops, so for any number of rules
    ``total - sum(excluded_i) + overlap_correction - null_excluded = survivors``.
    """
    fails = [F.coalesce(excluded(c, codes).cast("int"), F.lit(0)) for c, codes in rules.items()]
    n_fail = fails[0]
    for f in fails[1:]:
        n_fail = n_fail + f
    aggs = [F.count(F.lit(1)).alias("total_records")]
    aggs += [F.count_if(excluded(c, codes)).alias(f"{c.lower()}_excluded") for c, codes in rules.items()]
    aggs += [F.count_if(n_fail >= 2).alias("multi_rule_excluded"),
             F.coalesce(F.sum(F.greatest(n_fail - 1, F.lit(0))), F.lit(0)).cast("long").alias("overlap_correction"),
             F.count_if((n_fail == 0) & keep_mask(rules).isNull()).alias("null_excluded"),
             F.count_if(keep_mask(rules)).alias(survivor_name)]
    out = df.agg(*aggs)
    return out.withColumn(pct_name, rounded_ratio(survivor_name, "total_records", 2, factor=100))


def final_universe(df: DataFrame, rules: Rules) -> DataFrame:
    """One row: surviving rows and % of the original, rows excluded and %.
    The denominator is counted, never a literal."""
    out = df.agg(F.count(F.lit(1)).alias("total_records"),
                 F.count_if(keep_mask(rules)).alias("clean_universe_final"))
    return out.select(
        "total_records",
        "clean_universe_final",
        rounded_ratio("clean_universe_final", "total_records", 2, factor=100).alias("pct_of_original"),
        (F.col("total_records") - F.col("clean_universe_final")).alias("total_excluded"),
        rounded_ratio(F.col("total_records") - F.col("clean_universe_final"), "total_records", 2,
                      factor=100).alias("total_excluded_pct"),
    )


def layer_accounting(df: DataFrame, layers: Sequence[tuple[str, Rules]]) -> DataFrame:
    """Sequential layers: rows remaining after each cumulative layer, rows
    removed by that layer and % of the original (one pass, then unpivot).

    ``layers`` is ``[(name, rules), ...]``; layer i applies the rules of
    layers 0..i.  A first row ``start`` carries the total.
    """
    aggs = [F.count(F.lit(1)).alias("s0")]
    cumulative: dict[str, list[int]] = {}
    for i, (_, rules) in enumerate(layers, start=1):
        for column, codes in rules.items():  # a later layer adds codes, never replaces them
            cumulative[column] = sorted(set(cumulative.get(column, [])) | set(codes))
        aggs.append(F.count_if(keep_mask(cumulative)).alias(f"s{i}"))
    return accounting_rows(df.agg(*aggs), ["start"] + [name for name, _ in layers])


def accounting_rows(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """One-row ``s0, s1, ...`` (rows remaining after each layer) to the
    layer-accounting rows (step, layer, rows_remaining, rows_removed, pct)."""
    entries = ", ".join(f"{i}, {sql_literal(n)}, s{i}, s{max(i - 1, 0)}" for i, n in enumerate(names))
    long = wide.select(F.expr(f"stack({len(names)}, {entries})")
                       .alias("step", "layer", "rows_remaining", "rows_before"), F.col("s0").alias("total"))
    return long.select(
        F.col("step").cast("int").alias("step"),
        "layer",
        F.col("rows_remaining").cast("long").alias("rows_remaining"),
        (F.col("rows_before") - F.col("rows_remaining")).cast("long").alias("rows_removed"),
        rounded_ratio("rows_remaining", "total", 2, factor=100).alias("pct_of_original"),
    )
