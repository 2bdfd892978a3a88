"""Any combination of optional filters from one stored cube of histograms.

``build`` reads the rows once: they are counted per (all filter columns,
value), and that table, far smaller than the rows, is rolled up over every
subset of the filters and stored, one folder per subset.  A statistic under any
combination of equality filters then reads the folder of just those filters,
with the filters pushed into the scan, and no row of the source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlens.operators.quantiles import histogram, histogram_summary
from cohortlens.session import scratch_dir


class HistogramCube:
    """Histograms of ``measure`` per group of ``keys`` and every subset of the
    optional ``filters``, stored at ``path``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], filters: Sequence[str],
                 schema: StructType | None = None) -> None:
        self.spark, self.path, self.keys, self.filters, self.schema = spark, path, list(keys), list(filters), schema

    @classmethod
    def build(cls, df: DataFrame, keys: Sequence[str], filters: Sequence[str], measure: str,
              path: str | None = None) -> HistogramCube:
        """Read ``df`` once and store the cube (default: a fresh folder under
        the shared checkpoint folder).  NULLs are values of a key or filter."""
        spark, keys, filters = df.sparkSession, list(keys), list(filters)
        path = path or scratch_dir(spark, "histogram-cube")
        base = histogram(df, [*keys, *filters], measure)
        sets = [[f for i, f in enumerate(filters) if not (s >> (len(filters) - 1 - i)) & 1] for s in range(1 << len(filters))]
        rolled = (base.groupingSets([[*keys, *own, "_v"] for own in sets], *keys, *filters, "_v")
                  .agg(F.grouping_id().alias("_gid"), F.sum("_c").alias("_c")))
        # grouping_id has a bit per key, filter and value; keys and the value are always there
        stored = rolled.withColumn("_set", F.shiftright("_gid", 1).cast("int")).drop("_gid")
        stored.write.mode("error").partitionBy("_set").parquet(path)
        return cls(spark, path, keys, filters, stored.schema)

    def table(self) -> DataFrame:
        """Every subset's histograms: keys, filters (NULL where not grouped by),
        ``_v``, ``_c`` and the subset ``_set``, a bit per filter that is left out."""
        # of an empty table nothing is stored to tell the schema from
        read = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return read.parquet(self.path)

    def _set(self, used: Sequence[str]) -> int:
        unknown = set(used) - set(self.filters)
        if unknown:
            raise ValueError(f"no filter of this cube: {', '.join(sorted(unknown))}")
        return sum(1 << (len(self.filters) - 1 - i) for i, f in enumerate(self.filters) if f not in used)

    def slice(self, where: Mapping[str, object] | None = None, by: Sequence[str] = ()) -> DataFrame:
        """The histogram (keys, by, ``_v``, ``_c``) under equality filters
        ``where`` (None as a value means IS NULL), further grouped ``by``."""
        where = dict(where or {})
        out = self.table().filter(F.col("_set") == self._set([*where, *by]))
        for f, value in where.items():
            out = out.filter(F.col(f).isNull() if value is None else F.col(f) == F.lit(value))
        return out.select(*self.keys, *by, "_v", "_c")

    def statistics(self, where: Mapping[str, object] | None = None, by: Sequence[str] = (),
                   probs: Mapping[str, float] | None = None) -> DataFrame:
        """Per group of keys (and ``by``): ``n``, ``n_valid``, ``total``, ``min``,
        ``max`` and the interpolated quantiles ``probs`` (default the median)."""
        return _named(histogram_summary(self.slice(where, by), [*self.keys, *by], probs or {"median": 0.5}))

    def everything(self, probs: Mapping[str, float] | None = None) -> DataFrame:
        """``statistics`` of every subset of filters and every combination of
        their values; ``filter_set`` as in ``table``."""
        by = ["_set", *self.keys, *self.filters]
        return _named(histogram_summary(self.table(), by, probs or {"median": 0.5})).withColumnRenamed("_set", "filter_set")


def _named(summary: DataFrame) -> DataFrame:
    names: dict[str, Column] = {"_n": "n", "_nv": "n_valid", "_sum": "total", "_min": "min", "_max": "max"}
    return summary.select(*[F.col(c).alias(names.get(c, c)) for c in summary.columns])
