"""Counts and ranges from the statistics in Parquet footers.

Spark can answer COUNT, MIN and MAX from footers alone if a table is read
through its second data source interface with aggregate push-down.  Both are
session settings, and a library must not change its caller's: ``read`` opens
the table in a sibling session (same context, catalog and settings, plus the
two).  Whatever the statistics can't answer, such as an aggregate under a
filter on the data or the range of a string, Spark then reads as usual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types whose least and greatest value the footers are trusted with.
RANGED = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "boolean")
_V1, _PUSH = "spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown"


def statistics_session(spark: SparkSession) -> SparkSession:
    """A sibling of ``spark`` that pushes aggregates into Parquet."""
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            other.conf.set(key, value)
    sources = spark.conf.get(_V1).split(",")
    other.conf.set(_V1, ",".join(s for s in sources if s.strip() != "parquet"))
    other.conf.set(_PUSH, "true")
    return other


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, its counts and ranges answered from footers."""
    return statistics_session(spark).read.parquet(path)


def ranges(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, n_rows, n_values, null_count, min_value, max_value) of
    every named column, or of all: one aggregate, no row of data where ``df``
    comes from ``read``.

    Least and greatest values are doubles (a date's in days since 1970-01-01,
    a boolean's 0 or 1); those of other types are NULL, and a nested column
    has no count of values either, since footers count its leaves.  An empty
    table gives zeros and NULLs.
    """
    kinds = dict(df.dtypes)
    names = list(columns or df.columns)
    flat = [c for c in names if not kinds[c].startswith(("array", "map", "struct", "variant"))]
    ranged = [c for c in flat if kinds[c] in RANGED]
    q = {c: "`" + c.replace("`", "``") + "`" for c in names}
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count(q[c]).alias(f"v{names.index(c)}") for c in flat]
    for c in ranged:
        aggs += [F.min(q[c]).alias(f"a{names.index(c)}"), F.max(q[c]).alias(f"b{names.index(c)}")]
    one = df.agg(*aggs)

    def number(prefix: str, c: str):
        x = F.col(f"{prefix}{names.index(c)}")
        return F.unix_date(x).cast("double") if kinds[c] == "date" else x.cast("int").cast("double") if kinds[c] == "boolean" else x.cast("double")

    none = F.lit(None)
    rows = [F.struct(
        F.lit(c).alias("column_name"), F.col("n").alias("n_rows"),
        (F.col(f"v{names.index(c)}") if c in flat else none.cast("long")).alias("n_values"),
        (F.col("n") - F.col(f"v{names.index(c)}") if c in flat else none.cast("long")).alias("null_count"),
        (number("a", c) if c in ranged else none.cast("double")).alias("min_value"),
        (number("b", c) if c in ranged else none.cast("double")).alias("max_value")) for c in names]
    return one.select(F.inline(F.array(*rows)))
