"""Exact quantiles at any skew.

``histogram_summary`` -- measures with a bounded set of values (codes,
minutes): every statistic of a group from its (value -> count) histogram.

``exact_quantiles`` -- measures with unbounded distinct values:

``percentile`` keeps a value->count map per group, and the final merge of
one group happens in one task; for a continuous measure and a hot group
(say a third of all rows) that map grows with the data.  ``exact_quantiles``
never holds a group in one task:

1. histogram ``(keys, value) -> c``: partial aggregation, then a hash
   shuffle on (keys, value), so a hot group spreads by value;
2. ``repartitionByRange`` on (keys, value): each partition holds one
   contiguous slice of the global (keys, value) order, and a hot group spans
   many partitions; the slices are written once as a table under
   ``spark.checkpoint.dir`` with their partition id as a column, so ids are
   stable and lineage is cut;
3. per (partition, group) row counts -> a small table (at most
   #partitions + #groups rows) -> prefix offsets per group; the table is
   broadcast only after its row count is checked;
4. running counts inside each (partition, group) slice give every distinct
   value its global rank interval; only the rows holding the wanted order
   statistics survive (at most 2 per quantile and group);
5. linear interpolation exactly as ``percentile`` does it:
   position = (n - 1) * p, result = (hi - pos) * v_lo + (pos - lo) * v_hi.

Every task's state is bounded by its partition size, whatever the skew.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.stats import round_value
from cohortlens.session import scratch_dir

# Offsets tables up to this many rows are broadcast (a few tens of MB);
# larger ones (very many groups) take a shuffle join instead.
BROADCAST_ROW_LIMIT = 500_000


def _null_safe_join_cond(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = left["_pid"] == right["_pid"]
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def value_slices(df: DataFrame, keys: Sequence[str], value: Column, n_parts: int) -> DataFrame:
    """Steps 1-2: the (keys, value) histogram cut into ``n_parts`` contiguous
    slices of the global (keys, value) order, as a stored table
    ``(keys..., _v, _c, _pid)``.

    The slices are written once under the shared checkpoint folder: ``_pid``
    becomes a stored column (stable under retries and re-reads) and the
    lineage is cut.  Only the column is relied upon later, never the
    physical partitioning of the re-read table.
    """
    spark = df.sparkSession
    hist = (df.select(*keys, value.alias("_v")).filter(F.col("_v").isNotNull())
            .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    path = scratch_dir(spark, "quantiles")
    (hist.repartitionByRange(n_parts, *keys, "_v")
     .withColumn("_pid", F.spark_partition_id())
     .write.mode("error").parquet(path))
    return spark.read.parquet(path)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                    partitions: int | None = None, digits: int | None = None,
                    rounding: str = "half_up") -> DataFrame:
    """Per group of ``keys``: one column per ``probs`` entry (name -> p),
    equal to ``percentile(value, p)``.  NULL values are ignored; a group
    with no non-NULL value does not appear."""
    spark = df.sparkSession
    keys = list(keys)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(value).cast("double")

    ranged = value_slices(df, keys, v, n_parts)

    part = ranged.groupBy("_pid", *keys).agg(F.sum("_c").alias("_pc"))
    by_group = Window.partitionBy(*keys)
    before = by_group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select("_pid", *keys,
                          F.coalesce(F.sum("_pc").over(before), F.lit(0)).alias("_off"),
                          F.sum("_pc").over(by_group).alias("_n"))

    # The offsets table has at most #partitions + #groups rows; count it
    # (a small job over the stored slices) before deciding to broadcast it.
    if part.count() <= BROADCAST_ROW_LIMIT:
        offsets = F.broadcast(offsets)

    running = Window.partitionBy("_pid", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.withColumn("_cum", F.sum("_c").over(running))
    joined = ranked.join(offsets, _null_safe_join_cond(ranked, offsets, keys)).select(
        *[ranked[k] for k in keys], ranked["_v"],
        (offsets["_off"] + ranked["_cum"] - ranked["_c"]).alias("_start"),
        (offsets["_off"] + ranked["_cum"] - 1).alias("_end"),
        offsets["_n"])

    names = list(probs)
    pos = {n: (F.col("_n") - 1).cast("double") * F.lit(float(probs[n])) for n in names}
    lo = {n: F.floor(pos[n]) for n in names}
    hi = {n: F.ceil(pos[n]) for n in names}

    def holds(rank: Column) -> Column:
        return rank.between(F.col("_start"), F.col("_end"))

    keep = None
    for n in names:
        term = holds(lo[n]) | holds(hi[n])
        keep = term if keep is None else (keep | term)
    picked = joined.filter(keep)

    aggs = [F.first("_n").alias("_n")]
    for n in names:
        aggs += [F.max(F.when(holds(lo[n]), F.col("_v"))).alias(f"_lo_{n}"),
                 F.max(F.when(holds(hi[n]), F.col("_v"))).alias(f"_hi_{n}")]
    grouped = picked.groupBy(*keys).agg(*aggs)

    out = []
    for n in names:
        p = (F.col("_n") - 1).cast("double") * F.lit(float(probs[n]))
        vlo, vhi = F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        interp = (F.ceil(p) - p) * vlo + (p - F.floor(p)) * vhi
        q = F.when((F.floor(p) == F.ceil(p)) | (vlo == vhi), vlo).otherwise(interp)
        out.append((round_value(q, digits, rounding) if digits is not None else q).cast("double").alias(n))
    return grouped.select(*keys, *out)


def histogram(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """``(keys..., _v, _c)``: rows per distinct value of each group, NULL
    values included as their own bucket.  Planned as a partial aggregate on
    the executors and one shuffle on (keys, value): a group holding a third
    of all rows is spread over the reducers by value, and each map task
    ships at most one count per (group, value)."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


def histogram_summary(hist: DataFrame, keys: Sequence[str], probs: Mapping[str, float],
                      kind: str = "interpolated") -> DataFrame:
    """Per group of ``keys`` from a ``histogram``:
    ``_n`` (rows), ``_nv`` (non-NULL values), ``_sum``, ``_min``, ``_max``
    and one column per ``probs`` entry.

    ``interpolated`` equals ``percentile`` over the raw rows: it *is*
    ``percentile`` with the histogram counts as frequencies, so each
    group's final merge combines one partial map per histogram partition
    (a few hundred), not one per map task of the scan.  ``discrete``
    returns the observed value at rank ceil(n*p) (what
    ``percentile_approx`` / ``quantile_disc`` give, here computed exactly)
    with a running count over the group's distinct values.  Both suit
    measures whose values come from a bounded set; use ``exact_quantiles``
    when they do not.
    """
    if kind not in ("interpolated", "discrete"):
        raise ValueError(f"unknown quantile kind {kind!r}")
    keys = list(keys)
    valid = F.col("_v").isNotNull()
    base = [F.sum("_c").alias("_n"), F.coalesce(F.sum(F.when(valid, F.col("_c"))), F.lit(0)).alias("_nv"),
            F.sum(F.when(valid, F.col("_v") * F.col("_c"))).alias("_sum"),
            F.min("_v").alias("_min"), F.max("_v").alias("_max")]
    names = list(probs)
    if kind == "interpolated":
        if not names:
            return hist.groupBy(*keys).agg(*base)
        arr = F.percentile(F.col("_v"), [float(probs[n]) for n in names], F.col("_c"))
        grouped = hist.groupBy(*keys).agg(*base, arr.alias("_q"))
        return grouped.select(*keys, "_n", "_nv", "_sum", "_min", "_max",
                              *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])

    cv = F.when(valid, F.col("_c"))
    by_group = Window.partitionBy(*keys)
    running = by_group.orderBy(F.asc_nulls_last("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.select(*keys, "_v", "_c", F.sum(cv).over(running).alias("_cum"),
                         F.sum(cv).over(by_group).alias("_nvw"))
    start, end = F.col("_cum") - F.col("_c"), F.col("_cum") - 1
    aggs = list(base)
    for name in names:
        rank = F.greatest(F.ceil(F.col("_nvw").cast("double") * F.lit(float(probs[name]))) - 1, F.lit(0))
        aggs.append(F.max(F.when(valid & rank.between(start, end), F.col("_v"))).cast("double").alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def rank_check(df: DataFrame, keys: Sequence[str], value: str, found: DataFrame, probs: Mapping[str, float],
               tolerance: float) -> DataFrame:
    """Per group of ``keys``: ``n`` rows with a value and, for every quantile
    column of ``found`` (keys and one column per ``probs`` entry), ``<name>_ok``:
    whether its rank lies within ``tolerance`` (a share of n) of the wanted one.
    A group whose values are all NULL stays, with ``n`` = 0: its quantiles
    hold when they are NULL (or ``found`` has no such group).

    Holds approximate quantiles against the data at any size: the counts come
    from the (keys, value) histogram, never from one task per group.
    """
    keys = list(keys)
    hist = histogram(df, keys, value)
    known = found.select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)],
                         *[F.col(c).alias(f"_q{i}") for i, c in enumerate(probs)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_f{i}"))
    rows = hist.join(known, same, "left")
    valid = F.col("_v").isNotNull()
    aggs = [F.coalesce(F.sum(F.when(valid, F.col("_c"))), F.lit(0)).alias("n")]
    for i in range(len(probs)):
        q = F.col(f"_q{i}")
        aggs += [F.max(q).alias(f"_at{i}"),
                 F.sum(F.when(F.col("_v") < q, F.col("_c")).otherwise(0)).alias(f"_below{i}"),
                 F.sum(F.when(F.col("_v") <= q, F.col("_c")).otherwise(0)).alias(f"_upto{i}")]
    out = rows.groupBy(*keys).agg(*aggs)
    return out.select(*keys, "n", *[
        F.when(F.col("n") == 0, F.col(f"_at{i}").isNull())
        .otherwise(F.col(f"_at{i}").isNotNull() & (F.col(f"_below{i}") <= (p + tolerance) * F.col("n"))
                   & (F.col(f"_upto{i}") >= (p - tolerance) * F.col("n")))
        .alias(f"{name}_ok") for i, (name, p) in enumerate(probs.items())])
