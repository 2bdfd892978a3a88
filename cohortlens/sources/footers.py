"""Catalog of stored tables: what the footers of their Parquet files say.

Spark lists the files (``binaryFile`` without its content, so any store Spark
can list) and spreads them over the executors; each task opens the footers of
its files, some kilobytes from the end of each, and returns one row per file
and column.  No data page is read, and nothing but the result of a question
comes to the driver.  Types carry the names Spark gives them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOOTER = ("file string, bytes long, n_rows long, row_groups int, column_name string, ordinal_position int, "
           "data_type string, nullable boolean, null_count long, stored_bytes long, problem string")


def _read_footers():
    """The task's function; nested, so that executors need no package for it."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark.errors import PySparkException
        from pyspark.sql.pandas.types import from_arrow_type

        names = ["file", "bytes", "n_rows", "row_groups", "column_name", "ordinal_position", "data_type", "nullable",
                 "null_count", "stored_bytes", "problem"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_(),
                 pa.int64(), pa.int64(), pa.string()]

        def type_name(kind):
            try:
                return from_arrow_type(kind, prefer_timestamp_ntz=True).simpleString()
            except PySparkException:     # a type that Spark has no name for
                return str(kind)

        def of_file(path, size):
            store, at = fs.FileSystem.from_uri(path)
            try:
                with store.open_input_file(at) as f:
                    file = pq.ParquetFile(f)
                    meta, schema = file.metadata, file.schema_arrow
            except pa.ArrowInvalid as e:
                return [(path, size, *[None] * 8, str(e).split("\n")[0][:200])]
            if not len(schema):
                return [(path, size, meta.num_rows, meta.num_row_groups, *[None] * 6, "no columns")]
            stored, nulls = {}, {}
            for g in range(meta.num_row_groups):
                for c in range(meta.num_columns):
                    chunk = meta.row_group(g).column(c)
                    name = chunk.path_in_schema
                    top = name.split(".")[0]
                    stored[top] = stored.get(top, 0) + chunk.total_compressed_size
                    found = chunk.statistics if name == top else None     # a nested column's nulls aren't its leaves'
                    known = nulls.get(top, 0)
                    nulls[top] = (None if known is None or found is None or not found.has_null_count
                                  else known + found.null_count)
            return [(path, size, meta.num_rows, meta.num_row_groups, f.name, i, type_name(f.type), f.nullable,
                     nulls.get(f.name, 0), stored.get(f.name, 0), None) for i, f in enumerate(schema, start=1)]

        for batch in batches:
            rows = [r for path, size in zip(batch["path"].to_pylist(), batch["length"].to_pylist()) for r in of_file(path, size)]
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
    return run


def file_footers(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per file and column of the Parquet files at ``paths`` (files,
    folders or patterns; partition folders are followed).

    ``problem`` says why a file gave no columns (no Parquet file, an empty or
    a cut one); such a file keeps a row.  ``null_count`` is NULL where a writer
    kept no statistics and for nested columns.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
             .select("path", "length"))
    return files.mapInArrow(_read_footers(), _FOOTER)


def stored_inventory(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, data_type, ordinal_position, n_files, n_rows,
    null_count): the columns as stored, one row per type a column has in some
    file.  ``by`` names grouping columns added to ``file_footers`` (a table's name)."""
    return (found.filter(F.col("column_name").isNotNull()).groupBy(*by, "column_name", "data_type")
            .agg(F.min("ordinal_position").alias("ordinal_position"), F.count(F.lit(1)).alias("n_files"),
                 F.sum("n_rows").alias("n_rows"),
                 F.when(F.count("null_count") == F.count(F.lit(1)), F.sum("null_count")).alias("null_count")))


def schema_drift(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, data_type, n_files, all_files, n_rows, least_file)
    of every column that is not stored alike in all files: another type in
    some, or missing from some (``data_type`` NULL: files without it); and of
    files that are none (``column_name`` NULL, ``data_type`` the problem)."""
    keys = list(by)
    good = found.filter(F.col("problem").isNull())
    files = good.select(*keys, "file", "n_rows").distinct()
    all_files = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("all_files"))

    def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
        other = right.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in right.columns if c not in on])
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return left.join(other, cond, how).drop(*[f"_{c}" for c in on])

    kinds = good.groupBy(*keys, "column_name", "data_type").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), F.min("file").alias("least_file"))
    odd = join(kinds, all_files, keys, "inner").filter(F.col("n_files") < F.col("all_files"))
    # (column, file) pairs of columns that some file lacks
    holders = good.groupBy(*keys, "column_name").agg(F.count(F.lit(1)).alias("_held"))
    partly = join(holders, all_files, keys, "inner").filter(F.col("_held") < F.col("all_files")).drop("_held")
    pairs = join(files, partly, keys, "inner")
    without = join(pairs, good.select(*keys, "column_name", "file"), [*keys, "column_name", "file"], "left_anti")
    missing = without.groupBy(*keys, "column_name", "all_files").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), F.min("file").alias("least_file"))
    columns = [*keys, "column_name", "data_type", "n_files", "all_files", "n_rows", "least_file"]
    bad = found.filter(F.col("problem").isNotNull()).groupBy(*keys, F.col("problem").alias("data_type")).agg(
        F.count(F.lit(1)).alias("n_files"), F.min("file").alias("least_file"))
    return (odd.select(columns)
            .unionByName(missing.withColumn("data_type", F.lit(None).cast("string")).select(columns))
            .unionByName(bad.select(*keys, F.lit(None).cast("string").alias("column_name"), "data_type", "n_files",
                                    F.lit(None).cast("long").alias("all_files"), F.lit(None).cast("long").alias("n_rows"),
                                    "least_file")))


def validate_stored(found: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """(column_name, data_type, expected_type, ordinal_position, n_files, ok) of
    the named columns; ``ok`` if every file stores the column with that type.
    A column stored with several types has a row for each, none of them ok; a
    missing one a row without a type."""
    spark = found.sparkSession
    wanted = spark.createDataFrame(sorted(expected.items()), "_name string, expected_type string")
    n_files = found.filter(F.col("column_name").isNotNull()).select(F.count_distinct("file")).scalar()
    rows = stored_inventory(found)
    return (wanted.join(rows, F.col("_name") == F.col("column_name"), "left").withColumn("_files", n_files)
            .select(F.col("_name").alias("column_name"), "data_type", "expected_type", "ordinal_position",
                    F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"),
                    (F.col("data_type").eqNullSafe(F.col("expected_type")) & F.col("n_files").eqNullSafe(F.col("_files"))).alias("ok")))


def required_stored(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, present, n_files, missing_files) of the named columns:
    present if every file has it, with any type."""
    spark = found.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "_name string")
    held = found.filter(F.col("column_name").isNotNull())
    n_files = held.select(F.count_distinct("file")).scalar()
    rows = held.groupBy("column_name").agg(F.count(F.lit(1)).alias("_held"))
    held_in = F.coalesce("_held", F.lit(0)).cast("long")
    return (wanted.join(rows, F.col("_name") == F.col("column_name"), "left").withColumn("_files", n_files)
            .select(F.col("_name").alias("column_name"), ((held_in == F.col("_files")) & (held_in > 0)).alias("present"),
                    held_in.alias("n_files"), (F.col("_files") - held_in).alias("missing_files")))
