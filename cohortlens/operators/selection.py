"""Exact quantiles of unbounded measures by refining histograms.

Nothing but bins is shuffled: every round counts, for each group, the values of
the intervals in which a wanted order statistic still lies, in ``BINS`` bins of
the interval, with the least and greatest value of each bin.  The bin that
holds the wanted rank, narrowed to its own least and greatest value, is the
next round's interval.  A rank is settled when its bin holds one distinct
value, or the rank is the first or last of its bin.  Bins alternate between
equal widths and equal ratios, so neither a narrow peak nor a far outlier holds
the rounds up.

A round reads the group and value columns once and combines on the executors: a
task ships at most ``BINS`` rows per interval, however many distinct values
there are.  The intervals (two per quantile and group) are broadcast after
their number is checked; beyond the limit the caller should use
``quantiles.exact_quantiles``, which shuffles by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.stats import round_value
from cohortlens.operators.quantiles import BROADCAST_ROW_LIMIT, exact_quantiles
from cohortlens.session import scratch_dir

BINS = 2048


def _stored(df: DataFrame, spark) -> DataFrame:
    path = scratch_dir(spark, "selection")
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def _scaled(x: Column, ratio: bool) -> Column:
    """Halved against overflow of a difference, or on a logarithmic scale."""
    return F.signum(x) * F.log1p(F.abs(x)) if ratio else x * F.lit(0.5)


def _bin(v: Column, lo: Column, hi: Column, ratio: bool) -> Column:
    """Bin of a finite value in [lo, hi], never falling as the value rises;
    infinities and NaN, which sort last, lie in bins of their own."""
    at, a, b = _scaled(v, ratio), _scaled(lo, ratio), _scaled(hi, ratio)
    share = F.when(b > a, (at - a) / (b - a)).otherwise(0.0)
    inner = F.least(F.floor(share * F.lit(BINS)), F.lit(BINS - 1))
    # the ends of an interval are apart even where the scale can't tell them
    inner = F.when((v == hi) & (hi > lo), F.lit(BINS)).otherwise(F.when(v == lo, F.lit(-1)).otherwise(inner))
    return (F.when(F.isnan(v), F.lit(BINS + 2)).when(v == F.lit(float("inf")), F.lit(BINS + 1))
            .when(v == F.lit(float("-inf")), F.lit(-2)).otherwise(inner)).cast("int")


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                     max_groups: int | None = None) -> DataFrame | None:
    """``(keys..., _rank, _value, _n)``: the values at ranks floor and ceil of
    ``(n - 1) * p``, 0-based, for every ``p``; NULL values are ignored, groups
    without a value have no row.  None when there are more intervals than may
    be broadcast."""
    spark = df.sparkSession
    keys = list(keys)
    rows = (df.select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_v"))
            .filter(F.col("_v").isNotNull()))
    finite = F.when(F.abs("_v") < F.lit(float("inf")), F.col("_v"))
    groups = _stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_lo"),
                                             F.max(finite).alias("_hi")), spark)
    if groups.count() * 2 * len(probs) > (max_groups if max_groups is not None else BROADCAST_ROW_LIMIT):
        return None
    position = [(F.col("_n") - 1).cast("double") * F.lit(float(p)) for p in probs]
    ranks = groups.select(*keys, "_n", "_lo", "_hi", F.explode(F.array(*map(F.floor, position), *map(F.ceil, position)))
                          .alias("_rank"))
    open_ = ranks.distinct().select(
        *keys, "_n", "_rank", F.coalesce("_lo", F.lit(0.0)).alias("_lo"), F.coalesce("_hi", F.lit(0.0)).alias("_hi"),
        F.lit(0).cast("long").alias("_below"))
    settled, first, ratio = [], True, False
    while True:
        intervals = open_.select(*keys, "_lo", "_hi", "_below").distinct()
        held = F.broadcast(intervals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_lo", "_hi", "_below"))
        cond = F.lit(True) if first else F.col("_v").between(F.col("_lo"), F.col("_hi"))
        for i, k in enumerate(keys):
            cond = cond & rows[k].eqNullSafe(F.col(f"_k{i}"))
        by = [*keys, "_lo", "_hi", "_below"]
        bins = (rows.join(held, cond).groupBy(*by, _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), ratio).alias("_bin"))
                .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max")))
        upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("_end", F.col("_below") + F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
        asked = open_.select(*keys, "_n", "_rank", "_lo", "_hi")
        hit = asked.join(bins, _same(asked, bins, keys) & (asked["_lo"] == bins["_lo"]) & (asked["_hi"] == bins["_hi"])
                         & (asked["_rank"] >= bins["_start"]) & (asked["_rank"] < bins["_end"])).select(
            *[asked[k] for k in keys], asked["_n"], asked["_rank"],
            F.when((F.col("_min") == F.col("_max")) | (asked["_rank"] == F.col("_start")), F.col("_min"))
            .when(asked["_rank"] == F.col("_end") - 1, F.col("_max")).alias("_value"),
            F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.col("_start").alias("_below"))
        found = _stored(hit, spark)
        settled.append(found.filter(F.col("_value").isNotNull()).select(*keys, "_rank", "_value", "_n"))
        open_ = found.filter(F.col("_value").isNull()).drop("_value")
        if open_.isEmpty():
            break
        first, ratio = False, not ratio
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def refined_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                      digits: int | None = None, rounding: str = "half_up", max_groups: int | None = None) -> DataFrame:
    """Per group of ``keys`` one column per ``probs`` entry (name -> p), equal
    to ``percentile(value, p)``; as ``exact_quantiles``, without shuffling or
    storing values.  Groups without a value do not appear; with more groups
    than may be broadcast, ``exact_quantiles`` answers."""
    keys, names = list(keys), list(probs)
    found = order_statistics(df, keys, value, list(probs.values()), max_groups)
    if found is None:
        return exact_quantiles(df, keys, value, probs, digits=digits, rounding=rounding)
    position = {n: (F.col("_n") - 1).cast("double") * F.lit(float(probs[n])) for n in names}
    aggs = []
    for n in names:
        aggs += [F.max(F.when(F.col("_rank") == F.floor(position[n]), F.col("_value"))).alias(f"_lo_{n}"),
                 F.max(F.when(F.col("_rank") == F.ceil(position[n]), F.col("_value"))).alias(f"_hi_{n}")]
    grouped = found.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    out = []
    for n in names:
        low, high, p = F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), position[n]
        q = F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)
        out.append((round_value(q, digits, rounding) if digits is not None else q).alias(n))
    return grouped.select(*keys, *out)
