"""Column profiles: cardinality, frequency, top-k, sentinel hunt, range check.

Shares of a grand total use a *scalar subquery* for the total
(``DataFrame.scalar()``): one extra aggregate that yields exactly one value,
instead of ``SUM(..) OVER ()`` which would move every group row into a single
partition.  That keeps high-cardinality profiles (one row per distinct value)
fully distributed.  The total is summed over the *grouped* rows, so adaptive
execution reuses the grouping shuffle and the source is scanned once; it is
projected once as a column before the exact-rounding arithmetic uses it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.stats import rounded_ratio


def cardinality(df: DataFrame, columns: Sequence[str], approx: bool = False,
                total_name: str = "total_records", rsd: float = 0.01) -> DataFrame:
    """One row: ``COUNT(*)`` and ``COUNT(DISTINCT c)`` per column.

    Exact distinct counts are planned as Expand + two aggregation levels; the
    distinct values are shuffled by hash, so no task sees all of them.
    ``approx=True`` uses HyperLogLog++ (fixed-size state, one pass).
    """
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    return df.agg(F.count(F.lit(1)).alias(total_name),
                  *[fn(F.col(c)).alias(f"distinct_{c.lower()}") for c in columns])


def grand_total(df: DataFrame) -> Column:
    """Row count of ``df`` as a scalar-subquery Column."""
    return df.select(F.count(F.lit(1))).scalar()


def with_share(df: DataFrame, n_col: str, total: Column, name: str, digits: int = 2) -> DataFrame:
    """Add ``name = n * 100 / total`` (exact HALF_UP) for a scalar ``total``.
    The scalar is projected once, so its subquery is planned once."""
    return (df.withColumn("_total", total)
            .withColumn(name, rounded_ratio(n_col, "_total", digits, factor=100)).drop("_total"))


def frequency(df: DataFrame, column: str | Column, value_name: str = "value",
              pct_name: str = "pct_of_total", digits: int = 2,
              denominator: Column | None = None) -> DataFrame:
    """(value, n, pct) for every distinct value, NULL included as a group.

    ``pct`` is ``n`` over the rows of ``df`` (or over ``denominator``, a
    scalar Column, when given), rounded HALF_UP exactly.
    """
    col = F.col(column) if isinstance(column, str) else column
    grouped = df.groupBy(col.alias(value_name)).agg(F.count(F.lit(1)).alias("n"))
    total = denominator if denominator is not None else grouped.select(F.sum("n")).scalar()
    return with_share(grouped, "n", total, pct_name, digits)


def top_values(df: DataFrame, column: str | Column, k: int = 20, value_name: str = "value",
               pct_name: str = "pct_of_total", digits: int = 2) -> DataFrame:
    """The ``k`` most frequent values with their share of *all* rows.

    The share is computed before the cut (so it is of every row, not of the
    top-k).  Ties are broken by value so rank k is deterministic.  A limit
    comes before the ranking, so each partition keeps k rows and only k rows
    are numbered, whatever k is.
    """
    return top_of_profile(frequency(df, column, value_name, pct_name, digits), k, value_name)


def top_of_profile(freq: DataFrame, k: int, value_name: str = "value") -> DataFrame:
    """Top ``k`` rows of a frequency profile by ``n`` (ties by value), ranked."""
    order = [F.desc("n"), F.asc_nulls_last(value_name)]
    return freq.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def sentinel_hunt(df: DataFrame, column: str, codes: Sequence[int], value_name: str = "value",
                  digits: int = 2) -> DataFrame:
    """Profile restricted to suspect codes, with both denominators:
    share of the hunted rows and share of all rows."""
    hunted = df.filter(F.col(column).isin(list(codes)))
    grouped = hunted.groupBy(F.col(column).alias(value_name)).agg(F.count(F.lit(1)).alias("n"))
    out = with_share(grouped, "n", grouped.select(F.sum("n")).scalar(), "pct_of_hunted", digits)
    return with_share(out, "n", grand_total(df), "pct_of_total", digits)


def hunt_in_profile(freq: DataFrame, value_name: str, codes: Sequence[int], digits: int = 2) -> DataFrame:
    """The sentinel hunt read off an existing frequency profile (no new scan
    when the profile is computed anyway): suspect rows and their share of
    the hunted rows."""
    hunted = freq.filter(F.col(value_name).isin(list(codes))).select(value_name, "n")
    return with_share(hunted, "n", hunted.select(F.sum("n")).scalar(), "pct_of_hunted", digits)


def sentinel_summary(df: DataFrame, column: str, codes: Sequence[int], digits: int = 2) -> DataFrame:
    """One row: rows holding any suspect code, all rows, and the share."""
    out = df.agg(F.count_if(F.col(column).isin(list(codes))).alias("sentinel_rows"),
                 F.count(F.lit(1)).alias("total_records"))
    return out.withColumn("pct_of_total", rounded_ratio("sentinel_rows", "total_records", digits, factor=100))


def profile_subtotals(profile: DataFrame, value_name: str, excluded_codes: Sequence[int],
                      labels: tuple[str, str] = ("legitimate", "excluded"), digits: int = 2) -> DataFrame:
    """Collapse a frequency profile into kept / excluded subtotals.
    A NULL value counts as excluded: the exclusion filter drops it.  Shares
    are recomputed from counts, not summed from rounded shares."""
    keep_label, drop_label = labels
    dropped = F.col(value_name).isNull() | F.col(value_name).isin(list(excluded_codes))
    cat = F.when(dropped, F.lit(drop_label)).otherwise(F.lit(keep_label))
    sub = profile.groupBy(cat.alias("category")).agg(F.sum("n").cast("long").alias("n"))
    return with_share(sub, "n", sub.select(F.sum("n")).scalar(), "pct_of_total", digits)


def range_check(df: DataFrame, column: str) -> DataFrame:
    """One row: min, max, NULL count and row count of a column."""
    c = F.col(column)
    return df.agg(F.min(c).alias("min_value"), F.max(c).alias("max_value"),
                  F.count_if(c.isNull()).alias("null_count"), F.count(F.lit(1)).alias("n_rows"))


def stack_blocks(blocks: Sequence[DataFrame]) -> DataFrame:
    """``UNION ALL`` by column name (blocks must already share one shape)."""
    return reduce(lambda a, b: a.unionByName(b), blocks)
