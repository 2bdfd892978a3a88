"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a token budget: its weight's share of all tokens, capped at
``max_epochs`` times its size with the excess reshared by weight.  A budget
takes complete epochs of the source first; what is left goes to documents in
the order of their keys, exponential variables divided by the document's
quality weight, until the running sum of tokens fills it.  The document at the
line gives the words that are left, so a source's taken words equal its budget.

A source is never gathered: rows are dealt out by ranges of (source, key), cut
where the keys themselves lie, so a part holds about as many rows as any other
whatever the qualities are; the parts' sums are accumulated, and documents are
ordered inside a part only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD, attach, numbered, written

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 20
#: Sums of (source, part), about as many as parts and sources, are broadcast up to this many.
BROADCAST_ROWS = 200_000


def budgets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (weight, source_size, ...; one row each) with ``target``:
    weighted shares of the total size, none above ``max_epochs`` times the
    source's size.  What a full source can't take is shared by weight among
    the others until none is above; a round is one aggregate over the sources.
    """
    s = written(sources.withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double")), "sources")
    total, weights = s.agg(F.sum("source_size"), F.sum("weight")).first()
    full, level = -1, (total or 0) / (weights or 1)
    while True:   # level: tokens per weight of the sources that are not full
        is_full = F.col("cap") <= F.col("weight") * F.lit(float(level))
        n, spent, free = s.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("cap"))),
                               F.sum(F.when(~is_full, F.col("weight")))).first()
        if n == full or not free:
            break
        full, level = n, ((total or 0) - (spent or 0.0)) / free
    return s.withColumn("target", F.least("cap", F.col("weight") * F.lit(float(level)))).drop("cap")


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weights(docs: DataFrame, labels: DataFrame, low: float = 0.25) -> DataFrame:
    """``docs`` with ``quality``: 1 for good, ``low`` for bad labelled documents
    (the mean of several labels), and the labels' overall mean for the others."""
    scale = lambda q: F.lit(low) + F.lit(1 - low) * q
    of = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("__id"))
          .agg(scale(F.avg("quality")).alias("quality")))
    mean = of.agg(F.avg("quality")).first()[0]
    out = docs.drop("quality").join(of, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    return out.withColumn("quality", F.coalesce("quality", F.lit(1.0 if mean is None else mean)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        labels: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text, quality): doc_id,
    size, source, source_size, target, taken, copies, text_hash.

    With ``labels`` the qualities are those of ``quality_weights``, joined to
    the measured rows, so no text is shuffled for them.

    ``size`` is the number of words (null text: 0).  Sources weigh by
    ``weights``, repeating, in code point order, the null source last.
    ``taken`` counts the words the mix takes of the document, repeats
    included; ``copies`` is the same in whole documents, the one at the budget
    line counting if at least half of it is taken.  A document without words
    has taken 0 and is copied as its place in the order says.  Keys come from
    a hash of id and text, so reruns agree; equal rows are interchangeable.  A
    quality that is null, not positive or missing counts as 1.  ``parts`` is the
    number of key ranges (default: as Spark shuffles); it changes no result.
    An empty table gives no row.
    """
    given = F.col("quality") if "quality" in docs.columns and labels is None else F.lit(1.0)
    rows = docs.select(
        "doc_id", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")).alias("skey"),
        word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"),
        F.when(given > 0, given.cast("double")).otherwise(1.0).alias("quality"),
        F.monotonically_increasing_id().alias("row"))      # tells equal rows apart; stored with them
    rows = written(rows if labels is None else quality_weights(rows, labels), "sizes")
    by = F.when(F.col("skey") != "-", F.col("skey"))
    sources = numbered(rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")),
                       by.isNull(), by)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    sources = budgets(sources.withColumn("weight", pick).drop("position"), max_epochs)
    size = F.greatest("source_size", F.lit(1))
    sources = sources.withColumn("budget", F.floor(F.col("target") + 0.5)).select(
        "skey", "n", "source_size", "target", F.floor(F.col("budget") / size).cast("long").alias("epochs"), (F.col("budget") % size).alias("rest"))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 11) + 0.5) / float(1 << 53)
    keyed = attach(rows, written(sources, "sources"), "skey", "n").withColumn("key", -F.log(unit) / F.col("quality"))
    # equal rows stand side by side; their numbers let a range end between them
    order = ["skey", "key", "doc_id", "text_hash", "row"]
    keyed = keyed.drop("quality")
    ranged = keyed.repartitionByRange(parts, *order) if parts else keyed.repartitionByRange(*order)
    keyed = written(ranged.withColumn("bucket", F.spark_partition_id()), "keys")
    sums = keyed.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("skey").alias("s"), F.col("bucket").alias("b"),
                       F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    inside = (Window.partitionBy("bucket", "skey").orderBy("key", "doc_id", "text_hash", "row")
              .rowsBetween(Window.unboundedPreceding, -1))
    out = keyed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = (out.join(F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums,
                    (F.col("skey") == F.col("s")) & (F.col("bucket") == F.col("b")))
           .withColumn("ahead", F.col("ahead") + F.col("before")))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("ahead")))
    extra = (F.col("ahead") < F.col("rest")) & (2 * part >= F.col("size"))
    return out.select(
        "doc_id", "size", F.when(F.col("skey") != "-", F.substring("skey", 2, 1 << 30)).alias("source"), "source_size",
        "target", (F.col("epochs") * F.col("size") + part).alias("taken"),
        (F.col("epochs") + extra.cast("long")).alias("copies"), "text_hash")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: whole rows of ``docs``, each as often as ``mix`` takes it.

    Null texts, ids and sources are kept as ``mix`` counts them; rows of equal
    id, text and source share their copies evenly; extra columns stay; an empty
    table gives none."""
    # one struct as key of join and window: nulls in it are equal, and the text is shuffled once
    plan = mix(docs, **options).filter("copies > 0").groupBy(
        F.struct("doc_id", "text_hash", "source").alias("__plan")).agg(
        F.sum("copies").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash"), "source")
    rows = docs.withColumn("__key", key).join(plan, F.col("__key") == F.col("__plan"))
    # rows of equal id, text and source share their copies out evenly
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    copies = F.floor(F.col("__sum") / F.col("__n")) + (F.col("__nth") <= F.col("__sum") % F.col("__n")).cast("int")
    rows = rows.withColumn("__nth", nth).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
