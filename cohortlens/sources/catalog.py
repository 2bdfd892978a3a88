"""Schema catalog: column inventory, type validation, required columns, shape.

Spark has no INFORMATION_SCHEMA; the inventory is built from the DataFrame's
schema, which is metadata (one row per column, never per data row).  Only
``dataset_shape`` and ``head_sample`` touch data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.literals import inline_rows

def literal_rows(spark, rows: Sequence[tuple], schema: T.StructType):
    """A small DataFrame of literal rows, built JVM-side from one SQL
    expression: no Python worker, no RDD, rows kept in order."""
    gen = inline_rows([f.name for f in schema.fields], rows, [f.dataType for f in schema.fields])
    return spark.range(1).select(gen)


_INVENTORY_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("ordinal_position", T.IntegerType(), False),
])


def column_inventory(df: DataFrame) -> DataFrame:
    """(column_name, data_type, ordinal_position) ordered by ordinal, 1-based."""
    rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields, start=1)]
    # Rows are built in ordinal order; a local relation keeps that order.
    return literal_rows(df.sparkSession, rows, _INVENTORY_SCHEMA)


def validate_schema(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Inventory rows for the named columns with the expected type and a verdict.

    A column that is missing appears with ``data_type`` NULL and ``ok`` false.
    """
    inv = {f.name: (f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields, start=1)}
    rows = []
    for name, want in sorted(expected.items()):
        got, pos = inv.get(name, (None, None))
        rows.append((name, got, want, pos, got == want))
    schema = T.StructType([
        T.StructField("column_name", T.StringType(), False),
        T.StructField("data_type", T.StringType(), True),
        T.StructField("expected_type", T.StringType(), False),
        T.StructField("ordinal_position", T.IntegerType(), True),
        T.StructField("ok", T.BooleanType(), False),
    ])
    return literal_rows(df.sparkSession, rows, schema)


def required_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per required column: present or missing, and where it sits."""
    pos = {name: i for i, name in enumerate(df.columns, start=1)}
    rows = [(name, name in pos, pos.get(name)) for name in names]
    schema = T.StructType([
        T.StructField("column_name", T.StringType(), False),
        T.StructField("present", T.BooleanType(), False),
        T.StructField("ordinal_position", T.IntegerType(), True),
    ])
    return literal_rows(df.sparkSession, rows, schema)


def dataset_shape(df: DataFrame, n_names: int = 10) -> DataFrame:
    """rows x columns and the first ``n_names`` column names (one row).

    The row count is a distributed aggregate; the rest is schema metadata.
    """
    names = df.columns
    first = ", ".join(names[:n_names])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(names)).cast("int").alias("n_columns"),
        F.lit(first).alias("first_columns"),
    )


def head_sample(df: DataFrame, columns: Sequence[str], n: int = 3,
                order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows of a projection, ordered for determinism (ascending,
    NULLs first) -- ``TakeOrderedAndProject``: each task keeps n rows, one merge."""
    keys = list(order_by or columns)
    return df.select(*columns).orderBy(*[F.asc_nulls_first(k) for k in keys]).limit(n)
