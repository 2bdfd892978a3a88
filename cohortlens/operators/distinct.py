"""Exact distinct counts of integer codes from bitmaps that can be kept.

A column's codes are bits of 4 KB bitmaps, one per 32,768 neighbouring codes.
Every row is turned into its (column, code) pairs in one pass, equal pairs of a
part are combined on the executors before anything is shuffled, and what is
left is written into bitmaps.  Bitmaps of several parts (days, files) merge by
OR, so a count over any choice of parts needs no second look at the rows, as
COUNT(DISTINCT ...) does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_state(df: DataFrame, columns: Sequence[str], part: str | None = None) -> DataFrame:
    """``(column_name, part, bucket, bitmap, n_rows)``: per column and part the
    bitmaps of its codes.  Rows are counted under a NULL ``column_name``.

    Columns must be integers; NULL codes set no bit, NULL parts are a part.
    Best for codes, keys and days: widely scattered numbers make as many
    bitmaps as there are stretches of 32,768 with a code in them.
    """
    kinds = dict(df.dtypes)
    for c in columns:
        if kinds[c] not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"column {c} is {kinds[c]}: bitmaps are for integer codes")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("long").alias("code")) for c in columns],
                    F.struct(F.lit(None).cast("string").alias("column_name"), F.lit(0).cast("long").alias("code")))
    of = F.col(part) if part else F.lit(0)
    codes = (df.select(of.alias("part"), F.explode(pairs).alias("x")).select("part", "x.column_name", "x.code")
             .filter(F.col("code").isNotNull()).groupBy("column_name", "part", "code").agg(F.count(F.lit(1)).alias("n")))
    return codes.groupBy("column_name", "part", F.bitmap_bucket_number("code").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bitmap"), F.sum("n").alias("n_rows"))


def distinct_counts(state: DataFrame, columns: Sequence[str], total_name: str = "total_records") -> DataFrame:
    """One row off any union of states: rows, and the distinct codes of every
    column; as ``profile.cardinality``."""
    merged = state.groupBy("column_name", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), F.sum("n_rows").alias("n_rows"))
    return merged.agg(
        F.coalesce(F.sum(F.when(F.col("column_name").isNull(), F.col("n_rows"))), F.lit(0)).alias(total_name),
        *[F.coalesce(F.sum(F.when(F.col("column_name") == c, F.bitmap_count("bitmap"))), F.lit(0)).alias(f"distinct_{c.lower()}")
          for c in columns])
