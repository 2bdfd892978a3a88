"""Helpers shared by the operators of this sub-package."""

from __future__ import annotations

import io
import os
import zipfile

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.session import scratch_dir

#: A word is a maximal run of anything but space and U+0009..U+000D.  On UTF-8
#: bytes that is what ``bytes.split()`` yields, and ``bytes.lower()`` changes
#: A-Z alone; the Python tasks use those two.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes, A-Z lower-cased; none for a null text."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it of a folder or file that Spark names."""
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def ship(spark: SparkSession) -> None:
    """Let the session's Python workers import this package, as ``--py-files``
    would: once per context, through the shared scratch folder.  To be called
    before a Python function is put into a plan."""
    sc = spark.sparkContext
    if getattr(sc, "_cohortlens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(root)))
    path = f"{scratch_dir(spark, 'llm', 'package')}/cohortlens.zip"
    store, at = store_of(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(at, compression=None) as f:
        f.write(out.getvalue())
    sc.addPyFile(path)
    sc._cohortlens_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the session's shared scratch folder and
    read back: cuts lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, "llm", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """Left join of ``right`` (one row per key) to ``left`` on ``key``, safe
    for hot keys: adds the columns of ``right`` other than key and weight.

    ``weight`` holds the number of rows of ``left`` with that key.  Keys with
    more than 1/``share`` of all rows, fewer than ``share`` by construction,
    join by broadcast; their rows then pass through the shuffle join of the
    other keys spread by a hash of the row.  ``right`` should be stored
    (``written``), since it is read three times.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * share > F.lit(total)
    heavy = right.filter(hot).select(F.col(key).alias("__hk"), F.struct(*values).alias("__hv"))
    rest = right.filter(~hot).select(
        F.col(key).alias("__rk"), F.struct(*values).alias("__rv"),
        F.xxhash64(key).alias("__rx"), F.lit(False).alias("__rh"))
    columns = left.columns
    out = left.join(F.broadcast(heavy), F.col(key) == F.col("__hk"), "left")
    out = out.withColumn("__lh", F.col("__hk").isNotNull())
    out = out.withColumn("__lx", F.when(F.col("__lh"), F.xxhash64(*columns)).otherwise(F.xxhash64(key)))
    out = out.join(rest, (F.col("__lx") == F.col("__rx")) & (F.col("__lh") == F.col("__rh"))
                   & (F.col(key) == F.col("__rk")), "left")
    return out.select(*columns, *[
        F.coalesce(F.col(f"__hv.{v}"), F.col(f"__rv.{v}")).alias(v) for v in values])


def numbered(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """``df`` with its 0-based position in the given order, without a global
    sort in one task: rows are dealt out by ranges of the order, stored,
    numbered in each part, and shifted by the size of the parts before (one
    row per part comes to the driver)."""
    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())
    offsets, at = [(-1, 0)], 0
    for part, n in sizes:
        offsets.append((part, at))
        at += n
    small = df.sparkSession.createDataFrame(offsets, "__part int, __offset long")
    w = Window.partitionBy("__part").orderBy(*order)
    return (ranged.join(F.broadcast(small), "__part")
            .withColumn(name, F.col("__offset") + F.row_number().over(w) - 1).drop("__part", "__offset"))
