"""Incremental contrasts over visit files as they arrive.

The study's table is a yearly file, but visit extracts can land as a stream
of files.  Every statistic of a contrast is a mergeable aggregate
(count, sum, min, max, percentile maps, quantile sketches), so the same
``run_dimension`` plan runs unchanged on a streaming DataFrame: Spark keeps
one aggregation state per (cohort, level) in the state store and folds each
micro-batch into it.  State size is bounded by the number of groups (times
the distinct measure values for exact medians), never by rows.

Progress and state live under the shared ``spark.checkpoint.dir`` so a
restarted query (lost executor or driver) resumes from its last committed
batch.  A share of the cohort (the boarding dimension) is a window over the
aggregated rows, which Structured Streaming does not allow inside the
stream: the stream keeps the aggregate with the cohort *code*, and
``finish_batch`` adds the share and the labels to each micro-batch's
complete result inside ``foreachBatch``, where windows are allowed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cohortlens.functions.labels import decode_codes
from cohortlens.operators.contrasts import STAT_ORDER, contrast, share_within
from cohortlens.plans import study as S
from cohortlens.session import scratch_dir
from cohortlens.sources.csv import VISIT_SCHEMA

STREAMABLE_DIMENSIONS = list(S.DIMENSIONS)
_CODE = "_cohort_code"


def visit_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema=VISIT_SCHEMA,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of visit files (parquet or header CSV) with a fixed schema."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(fmt).load(path)


def incremental_contrast(stream: DataFrame, dimension: str = S.DEFAULT_DIMENSION,
                         method: str = "exact") -> DataFrame:
    """The dimension's contrast as a streaming aggregate (complete output).
    For a dimension with a share of the cohort, pair it with
    ``finish_batch(dimension)`` (see ``start``)."""
    if dimension not in STREAMABLE_DIMENSIONS:
        raise ValueError(f"unknown dimension {dimension!r}")
    if method not in ("exact", "approx"):
        raise ValueError("streaming contrasts use 'exact' or 'approx' quantiles")
    # Rank windows are not allowed on streams, so the exact flavour uses the
    # ``percentile`` aggregate here: its value->count map *is* the state the
    # state store folds each micro-batch into (one per group).
    q = "percentile" if method == "exact" else method
    d = S.DIMENSIONS[dimension]
    if "share" not in d.stats:
        return S.run_dimension(stream, dimension, q)
    stats = tuple(x for x in d.stats if x != "share")
    return contrast(S.clean_universe(stream), S.COHORT, d.level, S.MEASURE, stats=stats, method=q,
                    cohort_name=_CODE, level_labels=d.level_labels, level_name=d.level_name)


def finish_batch(dimension: str) -> Callable[[DataFrame], DataFrame] | None:
    """Per micro-batch completion of a dimension with a share of the cohort:
    the share window and the cohort labels, in the batch output's order.
    None for dimensions that need nothing."""
    d = S.DIMENSIONS[dimension]
    if "share" not in d.stats:
        return None
    names = {"n": "n", "share": "pct_of_arrival_method"}
    stat_cols = [names.get(x, f"{x}_wait_minutes") for x in STAT_ORDER if x in d.stats]

    def finish(batch: DataFrame) -> DataFrame:
        out = (batch.withColumn("pct_of_arrival_method", share_within("n", [_CODE]))
               .withColumn("arrival_method", decode_codes(_CODE, S.ARRIVAL_LABELS)))
        return out.orderBy(*(d.order_by or ())).select("arrival_method", d.level_name, *stat_cols)
    return finish


def start(result: DataFrame, name: str, sink_path: str | None = None, checkpoint: str | None = None,
          available_now: bool = True, processing_time: str | None = None,
          finish: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Start the streaming contrast.

    With ``sink_path`` every micro-batch overwrites a parquet table holding
    the complete current result (``foreachBatch``), after ``finish`` if
    given; without it the result goes to an in-memory table named ``name``
    (tests, notebooks).
    """
    spark = result.sparkSession
    checkpoint = checkpoint or scratch_dir(spark, "streaming", name)
    writer = result.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    if finish is not None and not sink_path:
        raise ValueError("a finishing step needs a sink_path (foreachBatch)")
    if sink_path:
        done = finish or (lambda batch: batch)
        writer = writer.foreachBatch(
            lambda batch, _epoch: done(batch).write.mode("overwrite").parquet(sink_path))
    else:
        writer = writer.format("memory").queryName(name)
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
