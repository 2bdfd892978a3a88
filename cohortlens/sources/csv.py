"""CSV source for the visit table.

The study reads its raw table from a CSV file with a header row.  On Spark
the schema is given explicitly: ``inferSchema`` would cost a full extra pass
over the files and can guess differently per file.  Every file's header is
checked against the columns read, so a file with columns in another order is
an error, never a silent swap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import scratch_dir
from cohortlens.sources.bindings import VISIT_COLUMNS

_DOUBLES = {"PATWT", "EDWT"}

VISIT_SCHEMA = T.StructType([
    T.StructField(name, T.DoubleType() if name in _DOUBLES else T.IntegerType(), True)
    for name in VISIT_COLUMNS
])

#: Columns with exclusion rules: without one of them no row would be clean.
RULE_COLUMNS = ("ARREMS", "WAITTIME", "IMMEDR")


def _reader(spark: SparkSession):
    return spark.read.option("header", True).option("enforceSchema", False)


def read_visits_csv(spark: SparkSession, path: str, schema: T.StructType | None = VISIT_SCHEMA) -> DataFrame:
    """Header CSV scan (FAILFAST: a malformed row or another header is an error).

    With ``schema=None`` the types are inferred like the study's own CSV
    read; that costs one extra full pass over the files, so production reads
    pass the schema.
    """
    reader = _reader(spark).option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def csv_round_trip(spark: SparkSession, df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Write ``df`` as header CSV under the session's shared scratch folder and
    scan it back.  The write is one distributed job (one file per partition);
    the returned DataFrame is a fresh CSV scan with no lineage to ``df``."""
    path = scratch_dir(spark, "csv")
    df.write.mode("error").option("header", True).csv(path)
    return read_visits_csv(spark, path, schema or df.schema)


def _number(cell: Column, dtype: T.DataType) -> Column:
    """A text cell as a number: ``12`` and ``12.0`` are both the integer 12."""
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType)):
        as_double = cell.try_cast("double")
        whole = F.when(as_double == F.floor(as_double), as_double).try_cast(dtype)
        return F.coalesce(cell.try_cast(dtype), whole)
    return cell.try_cast(dtype)


def _failed(cell: Column, dtype: T.DataType) -> Column:
    return (F.trim(cell) != "") & _number(cell, dtype).isNull()


def read_visits_csv_by_name(spark: SparkSession, path: str, schema: T.StructType = VISIT_SCHEMA,
                            strict: bool = True, on_failed: str = "error",
                            required: Sequence[str] = RULE_COLUMNS) -> DataFrame:
    """Header CSV of any width (the study's raw file has 911 columns): the
    schema's columns are picked by header name and converted from text.  One
    pass, no type inference; the CSV reader only converts the selected columns.

    Blank cells become NULL.  A cell that is not blank and no number of its
    column's type is an error when it is read; ``on_failed="null"`` makes it
    NULL instead (``failed_cells`` counts them).  A missing column is an error
    when ``strict`` or when it is ``required``; otherwise it becomes a NULL
    column of its type (the study reports missing columns and goes on;
    ``catalog.required_columns`` on the raw table lists them).  All files must
    have the picked columns at the same places."""
    raw = _reader(spark).csv(path)
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    lacking = missing if strict else [c for c in missing if c in required]
    if lacking:
        raise ValueError(f"visit file lacks columns {lacking}")

    def pick(f: T.StructField) -> Column:
        if f.name in missing:
            return F.lit(None).cast(f.dataType)
        cell, value = raw[f.name], _number(raw[f.name], f.dataType)
        if on_failed == "null":
            return value
        text = F.concat(F.lit(f"column {f.name} holds no {f.dataType.simpleString()}: "), cell)
        return F.when(_failed(cell, f.dataType), F.raise_error(text)).otherwise(value)

    return raw.select(*[pick(f).alias(f.name) for f in schema.fields])


def failed_cells(spark: SparkSession, path: str, schema: T.StructType = VISIT_SCHEMA) -> DataFrame:
    """One row: per column of the schema that the file has, its cells that are
    not blank and can't be converted."""
    raw = _reader(spark).csv(path)
    return raw.agg(*[F.count_if(_failed(raw[f.name], f.dataType)).alias(f.name)
                     for f in schema.fields if f.name in raw.columns])
