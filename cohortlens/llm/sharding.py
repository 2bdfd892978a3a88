"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) go, largest first, to the shard
with the least load, found through a heap.  The heap holds a bounded number of
items, about shards x ``grain``, whatever the number of groups:

* a group of more than 1/``grain`` of a shard is an item;
* smaller groups are sorted by size and dealt out, in that order, to the bundles
  of their size class (a quarter of an octave), so bundles of a class hold as
  many groups and, within a group's size, as many bytes.  A class has as many
  bundles as its share of all bytes asks for, one per shard at least.

Bundles of large groups are scheduled before those of small ones.  No item but a
large group exceeds 1/``grain`` of a mean shard by more than one of its groups,
so shards differ by no more than that, unless a single group is larger than a
shard.  The schedule is made on the driver and joined back by broadcast to the
groups, and from these to the documents' ids; texts take no part in it.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import attach, numbered, written

SHARDS = 40
GRAIN = 250
ROW_BYTES = 16
SLOT_ROWS = 5000
#: Size classes per doubling of the size.
CLASSES = 4


def schedule(items: list[tuple], shards: int) -> dict:
    """item -> shard: items (item, size) by size, largest first (ties by item),
    each to the shard of least load (ties to the lowest shard)."""
    heap = [(0, s) for s in range(shards)]
    return _deal(sorted(items, key=lambda x: (-x[1], x[0])), heap)


def _deal(items: list[tuple], heap: list[tuple[int, int]]) -> dict:
    out = {}
    for item, size in items:
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def group_shards(groups: DataFrame, shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """``groups`` (grp long, bytes long, ...; one row each) with ``shard``."""
    spark = groups.sparkSession
    groups = written(groups, "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    most = shards * grain
    large = F.col("bytes") * most > F.lit(total)
    single = groups.filter(large).select("grp", "bytes").collect()           # at most shards x grain of them
    small = numbered(groups.filter(~large).withColumn("class", F.floor(F.log2("bytes") * CLASSES).cast("int")),
                     F.desc("bytes"), F.asc("grp"), name="place")
    classes = small.groupBy("class").agg(F.sum("bytes").alias("all")).collect()
    counts = [(r["class"], max(shards, -(-r["all"] * most // max(total, 1)))) for r in classes]
    small = small.join(F.broadcast(spark.createDataFrame(counts, "class int, bundles long")), "class").withColumn(
        "bundle", F.col("place") % F.col("bundles"))
    bundles = small.groupBy("class", "bundle").agg(F.sum("bytes").alias("bytes")).collect()
    heap = [(0, s) for s in range(shards)]
    of_group = _deal(sorted(((r["grp"], r["bytes"]) for r in single), key=lambda x: (-x[1], x[0])), heap)
    of_bundle = _deal([((r["class"], r["bundle"]), r["bytes"]) for r in
                       sorted(bundles, key=lambda r: (-r["class"], -r["bytes"], r["bundle"]))], heap)
    of_bundle = spark.createDataFrame([(*k, s) for k, s in of_bundle.items()], "class int, bundle long, shard int")
    of_group = spark.createDataFrame(list(of_group.items()), "grp long, shard int")
    small = small.join(F.broadcast(of_bundle), ["class", "bundle"]).select(*groups.columns, "shard")
    return small.unionByName(groups.join(F.broadcast(of_group), "grp").select(*groups.columns, "shard"))


def _size(text):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def assign(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32,
    text_hash, shard, slot.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16, and a shard's
    bytes come near the mean unless one group alone is larger.  Equal texts
    share a shard; null texts form one group, empty ones another.  ``slot``
    numbers a shard's rows from 0 without gaps, in an order that is the same
    in every run; equal rows are interchangeable and stand side by side.  An
    empty table gives none.
    """
    text = F.col("text")
    rows = written(docs.select(
        "doc_id", _size("text").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64("text", F.lit(1))).alias("grp")), "rows")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    placed = written(group_shards(groups, shards, grain).select("grp", "n", "shard"), "placed")
    rows = written(attach(rows, placed, "grp", "n").drop("grp"), "shards")
    pieces = max(1, -(-rows.count() // (shards * slot_rows)))
    rows = rows.withColumn("__piece", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(pieces)))
    sizes = rows.groupBy("shard", "__piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "__piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy("shard", "__piece").orderBy("doc_id", "text_hash")
    return (rows.join(sizes, ["shard", "__piece"])
            .withColumn("slot", (F.col("__ahead") + F.row_number().over(inside) - 1).cast("long"))
            .select("doc_id", "size", "text_crc32", "text_hash", "shard", "slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Whole rows of ``docs`` with size, shard and slot in place of any columns
    of those names; rows as ``assign`` places them, nulls, repeated rows and
    empty tables included.

    A row finds its place by id and text hash, one shuffle of whole rows; rows
    of equal id and text have slots side by side and share them out."""
    docs = docs.drop("shard", "slot", "size")
    plan = assign(docs, shards, grain, slot_rows).groupBy(F.struct("doc_id", "text_hash").alias("__plan")).agg(
        F.min("size").alias("size"), F.min("shard").alias("shard"), F.min("slot").alias("__first"))
    rows = docs.withColumn("__key", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    rows = rows.join(written(plan, "plan"), F.col("__key") == F.col("__plan"))
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    return (rows.withColumn("slot", (F.col("__first") + nth - 1).cast("long"))
            .select(*[F.col(f"`{c}`") for c in docs.columns], "size", "shard", "slot"))
