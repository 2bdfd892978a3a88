"""Quantile summaries with a rank promise: deterministic, mergeable, stored.

A summary of a group's values in one part of the data (a day, a file, a hash of
the value) keeps some of the values as points: the least, the greatest, and
every value at which the running count passes a multiple of the step
``epsilon * n``.  Fewer rows than a step lie between two neighbours, and how
many rows lie below and up to a point is known exactly.

Each point is stored as four increments, so that merging is addition.  With
the points of any number of parts sorted together, running sums bound, for
every point x:

* ``_up_lo``  <= rows up to x    <= ``_up_hi``
* ``_bel_lo`` <= rows below x    <= ``_bel_hi``

and the gaps of all parts add up to less than ``epsilon`` times all rows.  The
points depend on the values of a part alone, never on the order of its rows or
on how tasks split them, so a rerun gives the same summary to the last bit.

State rows are ``(keys..., part, _v, _d_lo, _d_hi, _at_hi, _at_lo, _rows)``;
a part's rows, with or without a value, are counted on one row whose ``_v``
is NULL, so a group whose values are all NULL stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces a summary is cut into when no part column is given: by a hash of the
#: value, so that the values of a hot group are summarised by many tasks.
VALUE_PIECES = 64
_STATE = ["_v", "_d_lo", "_d_hi", "_at_hi", "_at_lo", "_rows"]


def _points(bounded: DataFrame, by: Sequence[str], step: Column) -> DataFrame:
    """The points kept of rows ``(by..., _v, _up_lo, _up_hi, _bel_lo, _bel_hi,
    _n)``, sorted by ``_v`` in each ``by``, as increments."""
    order = Window.partitionBy(*by).orderBy("_v")
    before, after = F.lag("_up_lo").over(order), F.lead("_v").over(order)
    crossing = F.floor(F.col("_up_lo") / step) > F.floor(F.coalesce(before, F.lit(0)) / step)
    # the value before a crossing is kept too: what lies between two points is
    # less than a step even where one value's rows span many steps
    kept = (bounded.withColumn("_crossing", crossing).withColumn("_first", before.isNull())
            .withColumn("_last", after.isNull()).withColumn("_next", F.lead("_crossing").over(order))
            .filter("_crossing OR _first OR _last OR _next"))
    lower = F.coalesce(F.lag("_up_lo").over(order), F.lit(0))
    upper = F.coalesce(F.lead("_bel_hi").over(order), F.col("_n"))
    return kept.select(*by, "_v", (F.col("_up_lo") - lower).alias("_d_lo"), (upper - F.col("_bel_hi")).alias("_d_hi"),
                       (upper - F.col("_up_hi")).alias("_at_hi"), (F.col("_up_lo") - F.col("_bel_lo")).alias("_at_lo"),
                       F.lit(None).cast("long").alias("_rows"))


def summarise(df: DataFrame, keys: Sequence[str], value: str, epsilon: float = 0.005,
              part: str | None = None, pieces: int | None = None) -> DataFrame:
    """The state of ``value`` per group of ``keys`` and part.

    ``part`` names a column of ``df`` (say the day a row arrived); without one
    there is one part, 0.  A group's values of a part are summarised by one task
    or, by a hash of the value, in ``pieces`` (default 1, and ``VALUE_PIECES``
    without a part): the promise is the same, the points are more.  Counting comes first, combined on the
    executors, so a value that fills a third of the table is one row by the
    time it is sorted.  NULL values are in no point; NULL keys are a group,
    NULL parts a part.
    """
    keys = list(keys)
    v = F.col(value).cast("double") + F.lit(0.0)
    pieces = pieces or (1 if part else VALUE_PIECES)
    counted = df.groupBy(*keys, (F.col(part) if part else F.lit(0)).alias("part"), v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counted = counted.withColumn("_piece", F.pmod(F.xxhash64("_v"), F.lit(pieces)))
    by = [*keys, "part", "_piece"]
    order = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (counted.filter(F.col("_v").isNotNull())
              .withColumn("_up_lo", F.sum("_c").over(order)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
              .select(*by, "_v", "_up_lo", F.col("_up_lo").alias("_up_hi"),
                      (F.col("_up_lo") - F.col("_c")).alias("_bel_lo"), (F.col("_up_lo") - F.col("_c")).alias("_bel_hi"), "_n"))
    step = F.greatest(F.floor(F.lit(float(epsilon)) * F.col("_n")), F.lit(1))
    by = [*keys, "part"]
    rows = counted.groupBy(*by).agg(F.sum("_c").alias("_rows"))
    zero = [F.lit(None).cast("double").alias("_v"), *[F.lit(0).cast("long").alias(c) for c in _STATE[1:5]]]
    return _points(ranked, [*by, "_piece"], step).drop("_piece").unionByName(rows.select(*by, *zero, "_rows"))


def merged_bounds(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., _v, _up_lo, _up_hi, _bel_lo, _bel_hi, _n)``: the points of
    all parts of a group in one order, with bounds over all its rows."""
    keys = list(keys)
    at = (state.filter(F.col("_v").isNotNull()).groupBy(*keys, "_v")
          .agg(*[F.sum(c).alias(c) for c in _STATE[1:5]]))
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    low, high = F.sum("_d_lo").over(upto), F.sum("_d_hi").over(upto)
    return (at.withColumn("_low", low).withColumn("_high", high)
            .withColumn("_n", F.sum("_d_lo").over(Window.partitionBy(*keys)))
            .select(*keys, "_v", F.col("_low").alias("_up_lo"), (F.col("_high") - F.col("_at_hi")).alias("_up_hi"),
                    (F.col("_low") - F.col("_at_lo")).alias("_bel_lo"), (F.col("_high") - F.col("_d_hi")).alias("_bel_hi"), "_n"))


def compact(state: DataFrame, keys: Sequence[str], epsilon: float, into: Column | None = None) -> DataFrame:
    """Fewer, larger parts: those that share a value of ``into`` (all parts of
    a group without it) become one, thinned to a step of ``epsilon`` of its
    rows.  Errors add: a compacted state promises its own epsilon plus that of
    the states it was made of."""
    keys = list(keys)
    state = state.withColumn("part", into if into is not None else F.lit(0))
    by = [*keys, "part"]
    step = F.greatest(F.floor(F.lit(float(epsilon)) * F.col("_n")), F.lit(1))
    rows = state.groupBy(*by).agg(F.sum("_rows").alias("_rows"))
    zero = [F.lit(None).cast("double").alias("_v"), *[F.lit(0).cast("long").alias(c) for c in _STATE[1:5]]]
    return _points(merged_bounds(state, by), by, step).unionByName(rows.select(*by, *zero, "_rows"))


def boundaries(state: DataFrame, keys: Sequence[str], k: int = 4) -> DataFrame:
    """One row per group: ``n_rows``, ``n`` rows with a value, and arrays of
    ``k + 1`` entries, from the least value (0) to the greatest (k):

    * ``boundary``: an observed value for rank ``ceil(n * j / k)`` (1 at least);
    * ``rank_low``, ``rank_high``: the ranks it surely and at most covers,
      i.e. a row of rank between ``rank_low`` and ``rank_high`` holds it;
    * ``rank_error``: how far from the wanted rank it may lie at most.

    Of the points the one with the least possible error is taken, the smaller
    of equals.  A group without values keeps its row, with ``n`` 0 and arrays
    of NULLs.
    """
    keys = list(keys)
    wanted = F.explode(F.sequence(F.lit(0), F.lit(k))).alias("_j")
    rank = F.greatest(F.ceil(F.col("_n") * F.col("_j") / F.lit(k)), F.lit(1)).cast("long")
    first, last = F.col("_bel_hi") + 1, F.col("_up_lo")        # ranks that x covers for sure, if first <= last
    error = F.greatest(first - F.col("_r"), F.col("_r") - last, F.lit(0))
    best = (merged_bounds(state, keys).select("*", wanted).withColumn("_r", rank)
            .groupBy(*keys, "_j").agg(
                F.max("_n").alias("_n"),
                F.min(F.struct(error.alias("e"), F.col("_v").alias("v"), (F.col("_bel_lo") + 1).alias("lo"),
                               F.col("_up_hi").alias("hi"))).alias("_b")))
    lists = best.groupBy(*keys).agg(F.max("_n").alias("n"), F.sort_array(F.collect_list(F.struct("_j", "_b"))).alias("_a"))
    groups = state.groupBy(*keys).agg(F.sum("_rows").cast("long").alias("n_rows"))
    same = F.lit(True)
    for c in keys:
        same = same & groups[c].eqNullSafe(lists[c])
    out = groups.join(lists, same, "left").select(*[groups[c] for c in keys], "n_rows", "n", "_a")

    def array(field: str, kind: str) -> Column:
        found = F.transform(F.col("_a"), lambda x: x["_b"][field].cast(kind))
        return F.coalesce(found, F.array_repeat(F.lit(None).cast(kind), k + 1))
    return out.select(*keys, "n_rows", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                      array("v", "double").alias("boundary"), array("lo", "long").alias("rank_low"),
                      array("hi", "long").alias("rank_high"), array("e", "long").alias("rank_error"))
