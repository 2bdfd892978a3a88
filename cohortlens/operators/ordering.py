"""Row order at scale: positions and neighbours without one task for all rows.

A window without a partition key sorts everything in one task.  Here the rows
are dealt out by ranges of the order, so each part is one stretch of it, and
written once with the number of their part; a position is the place in the part
plus the sizes of the parts before, and the row before the first row of a part
is the last row of a part before.  What is known of the parts is one row per
part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import scratch_dir


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` stored in ranges of ``order``, the number of the range as ``_part``."""
    spark = df.sparkSession
    path = scratch_dir(spark, "ordering")
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged.write.mode("error").parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """``df`` with its 1-based position in ``order``.  Rows that are equal in
    ``order`` are numbered in some order among themselves."""
    rows = _ranged(df, order)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # one row per part: small enough for one window and a broadcast
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (rows.join(F.broadcast(offsets), F.col("_part") == F.col("_of"))
            .withColumn(name, (F.col("_offset") + place).cast("long")).drop("_part", "_of", "_offset"))


def with_previous(df: DataFrame, by: Sequence[str], columns: Sequence[str], prefix: str = "previous_") -> DataFrame:
    """``df`` with the ``columns`` of the row before in ascending order of the
    columns ``by``, NULLs first (NULL for the first row) as ``<prefix><column>``."""
    order = [F.asc_nulls_first(c) for c in by]
    rows = _ranged(df, order)
    kept = F.struct(*columns)
    inside = Window.partitionBy("_part").orderBy(*order)
    # the last row of every part, and for every part that of the part before
    back = rows.withColumn("_from_end", F.row_number().over(Window.partitionBy("_part").orderBy(*[F.desc_nulls_last(c) for c in by])))
    last = back.filter("_from_end = 1").select("_part", kept.alias("_last"))
    ends = last.select(F.col("_part").alias("_of"), F.lag("_last").over(Window.orderBy("_part")).alias("_carried"))
    out = (rows.withColumn("_row", F.row_number().over(inside)).withColumn("_before", F.lag(kept).over(inside))
           .join(F.broadcast(ends), F.col("_part") == F.col("_of"))
           .withColumn("_before", F.when(F.col("_row") > 1, F.col("_before")).otherwise(F.col("_carried"))))
    return out.select(*df.columns, *[F.col("_before")[c].alias(f"{prefix}{c}") for c in columns])
