"""Statistics that follow a growing table: a stored state per input partition.

The state of a partition (a day's folder, a month) is the count of rows per
(dimension, cohort, level, value), small and additive: the statistics of the
whole table are those of the summed counts.  ``refresh`` lists the table's files,
reads only the partitions whose files have changed since the last time, and
drops the state of partitions that are gone.  A state belongs to the exact
files it was made of; the list of valid states is written last, so a run that
breaks off leaves the one before in force, and the next run takes up what was
already written.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.quantiles import histogram_summary

_MANIFEST = "version long, part string, fingerprint string"


class MaintainedStatistics:
    """States of the partitions of the table at ``source`` kept at ``path``.

    ``part`` is the name of the partition folders (``part=value``);
    ``dimensions`` maps a dimension's name to its level column;
    ``prepare`` turns source rows into rows with ``cohort``, the levels and
    ``measure`` (for instance the clean universe).
    """

    def __init__(self, spark: SparkSession, source: str, path: str, part: str, cohort: str,
                 dimensions: Mapping[str, str], measure: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        self.spark, self.source, self.path, self.part = spark, source.rstrip("/"), path.rstrip("/"), part
        self.cohort, self.dimensions, self.measure, self.prepare = cohort, dict(dimensions), measure, prepare

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _listed(self) -> DataFrame:
        """(part, fingerprint) of the partitions there are: a hash over the
        names, sizes and times of their files."""
        # recursive lookup: partition folders are names here, not columns
        files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.source)
                 .select("path", "length", "modificationTime"))
        value = F.regexp_extract("path", rf"/{self.part}=([^/]*)/", 1)
        each = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
        return (files.groupBy(value.alias("part"))
                .agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(each))), 256).alias("fingerprint")))

    def _manifest(self) -> DataFrame:
        """The valid states: the rows of the last version."""
        if not self._exists(f"{self.path}/manifest"):
            return self.spark.createDataFrame([], _MANIFEST)
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        last = rows.agg(F.max("version")).first()[0]
        return rows.filter(F.col("version") == F.lit(-1 if last is None else last))

    def _counts(self, rows: DataFrame) -> DataFrame:
        """One pass over the rows of a partition: counts per dimension."""
        ready = self.prepare(rows)
        levels = F.array(*[F.struct(F.lit(name).alias("dimension"), F.col(c).cast("string").alias("level"))
                           for name, c in self.dimensions.items()])
        return (ready.select(F.col(self.cohort).alias("cohort"), F.col(self.measure).alias("_v"), F.explode(levels).alias("_d"))
                .groupBy("_d.dimension", "cohort", "_d.level", "_v").agg(F.count(F.lit(1)).alias("_c")))

    def refresh(self) -> dict[str, list[str]]:
        """Bring the states up to date; returns which partitions were read
        (``read``), taken over (``kept``) and dropped (``dropped``).

        What is compared is one short row per partition, on the driver; the
        work on rows is one Spark job per changed partition.
        """
        now = {r["part"]: r["fingerprint"] for r in self._listed().collect()}
        old = self._manifest()
        known = {r["part"]: r["fingerprint"] for r in old.collect()}
        version = (old.agg(F.max("version")).first()[0] or 0) + 1
        read = []
        for part, fingerprint in sorted(now.items()):
            if known.get(part) == fingerprint or self._exists(f"{self._state(part, fingerprint)}/_SUCCESS"):
                continue
            rows = self.spark.read.option("basePath", self.source).parquet(f"{self.source}/{self.part}={part}")
            self._counts(rows).write.mode("overwrite").parquet(self._state(part, fingerprint))
            read.append(part)
        if now != known:
            rows = [(version, p, f) for p, f in sorted(now.items())] or [(version, None, None)]
            self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return {"read": read, "kept": sorted(set(now) - set(read)), "dropped": sorted(set(known) - set(now))}

    def _state(self, part: str, fingerprint: str) -> str:
        return f"{self.path}/states/{self.part}={part}/{fingerprint}"

    def counts(self) -> DataFrame | None:
        """(dimension, cohort, level, ``_v``, ``_c``) of all valid states, a row
        per state; None before there is any."""
        paths = [self._state(r["part"], r["fingerprint"]) for r in self._manifest().filter("part IS NOT NULL").collect()]
        return self.spark.read.parquet(*paths) if paths else None

    def statistics(self, dimension: str, probs: Mapping[str, float] | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """(cohort, level, n, n_valid, total, min, max, quantiles) of a
        dimension over the whole table, from the states alone; ``level`` is the
        level's code as text."""
        counts = self.counts()
        if counts is None:
            raise ValueError("no state yet: call refresh() on a table with rows")
        hist = counts.filter(F.col("dimension") == dimension).groupBy("cohort", "level", "_v").agg(F.sum("_c").alias("_c"))
        out = histogram_summary(hist, ["cohort", "level"], probs or {"median": 0.5})
        return out.withColumnsRenamed({"_n": "n", "_nv": "n_valid", "_sum": "total", "_min": "min", "_max": "max"})
