"""Most frequent values with a proof, without grouping by value.

A frequency profile groups all rows by value to keep twenty of them: for a
column of nearly distinct values that is a shuffle of the whole column.  Here
the first pass only counts rows per hash bucket, a table of fixed size that
bounds every value from above: it can't occur more often than its bucket has
rows.  The fullest buckets are then counted value by value, which gives the
k-th largest count so far; buckets with fewer rows than that can't hold a value
of the answer, and only those with as many or more, if any, are counted too.
Skewed columns end after the second pass; where all values are rare, the third
is the full grouping, and the answer is exact either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.profile import with_share
from cohortlens.session import scratch_dir

#: Rows of the bucket table, at most; it is broadcast.
BUCKETS = 1 << 15


def _stored(df: DataFrame, spark) -> DataFrame:
    path = scratch_dir(spark, "heavy")
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def heavy_hitters(df: DataFrame, column: str, k: int = 20, value_name: str = "value",
                  pct_name: str = "pct_of_total", digits: int = 2, buckets: int = BUCKETS,
                  first_buckets: int | None = None) -> DataFrame:
    """``(value, n, pct_of_total, rank, others_at_most)``: the ``k`` most
    frequent values, ties by value, NULL a value of its own and last of a tie,
    as ``profile.top_values``.

    ``others_at_most`` is the proof: no value outside the buckets that were
    counted value by value occurs more often than that, and it is less than
    every ``n`` of a full answer.  ``first_buckets`` (default ``16 * k``) is how
    many buckets the second pass counts.
    """
    spark = df.sparkSession
    rows = df.select(F.col(column).alias(value_name)).withColumn("_b", F.pmod(F.xxhash64(value_name), F.lit(buckets)))
    table = _stored(rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_full")), spark)
    order = [F.desc("n"), F.asc_nulls_last(value_name)]

    def counted(some: DataFrame) -> DataFrame:
        found = (rows.join(F.broadcast(some.select(F.col("_b").alias("_w"))), F.col("_b") == F.col("_w"))
                 .groupBy(value_name).agg(F.count(F.lit(1)).alias("n")))
        return _stored(found.orderBy(*order).limit(k), spark)

    first = table.orderBy(F.desc("_full"), "_b").limit(first_buckets if first_buckets is not None else 16 * k)
    first = _stored(first, spark)
    top = counted(first)
    least = top.agg(F.when(F.count(F.lit(1)) >= k, F.min("n")).otherwise(0)).first()[0]
    rest = table.join(F.broadcast(first.select("_b")), "_b", "left_anti")
    others = rest.filter(F.col("_full") >= least)
    if not others.isEmpty():
        top = top.unionByName(counted(others)).orderBy(*order).limit(k)
    bound = rest.filter(F.col("_full") < least).agg(F.coalesce(F.max("_full"), F.lit(0)).alias("m")).first()["m"]
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))
    total = table.select(F.sum("_full")).scalar()
    return with_share(ranked, "n", total, pct_name, digits).select(
        value_name, "n", pct_name, "rank", F.lit(bound).cast("long").alias("others_at_most"))
