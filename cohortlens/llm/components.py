"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import attach, written


def _nearest(pairs: DataFrame) -> DataFrame:
    """(u, m, n): least neighbour and number of neighbours of every u."""
    return written(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "star")


def _star(pairs: DataFrame) -> DataFrame:
    return attach(pairs, _nearest(pairs), "u", "n")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long), label being the
    least node of its component.

    Each round links every larger neighbour to the least one (large star),
    then every smaller one (small star), and stores the edge table; the number
    of rounds is logarithmic in the component size.  Neighbourhoods are never
    gathered: a partial minimum by node and a join that tolerates hot nodes.
    Self loops and repeated edges are allowed; an empty table gives none.
    """
    e = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = written(large.filter("u != v").distinct(), "edges")
        small = _star(large)
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v")))
        e = written(small.distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
