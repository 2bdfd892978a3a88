"""Bands as data: ranges of integers looked up in a table of any size.

``functions.labels.band_ranges`` writes a CASE branch per band, right for a
handful.  A band table of thousands is joined instead, and joined by equality:
every band is cut into stretches of power-of-two length that start at a
multiple of their length (at most two per length, so a few dozen per band), and
a value looks for the stretch it lies in once per length that occurs.  Values
are looked up once each, not once per row, and no plan compares every value
with every band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ordering import with_previous
from cohortlens.session import scratch_dir

#: Tables up to this many stretches are broadcast; larger ones are shuffled.
BROADCAST_ROW_LIMIT = 200_000
#: Stretches are up to 2^61 long, for bands within +-2^60.
_LEVELS = 62


def check_bands(bands: DataFrame, low: str = "low", high: str = "high", label: str = "label") -> DataFrame:
    """(problem, low, high, label, previous_low, previous_high, previous_label):
    bands that end before they begin (``empty``), begin before an earlier one
    has ended (``overlap``), or leave integers out between them and the one
    before (``gap``).  Bounds are inclusive; NULL bounds are ``open``, and not
    allowed.  No row: every integer from the least to the greatest bound has
    one label."""
    b = bands.select(F.col(low).cast("long").alias("low"), F.col(high).cast("long").alias("high"), F.col(label).alias("label"))
    ok = b.filter("low <= high")
    seen = with_previous(ok, ["low", "high"], ["low", "high", "label"])
    found = seen.withColumn("problem", F.when(F.col("low") <= F.col("previous_high"), "overlap")
                            .when(F.col("low") > F.col("previous_high") + 1, "gap")).filter("problem IS NOT NULL")
    none = F.lit(None)
    bad = b.filter("low IS NULL OR high IS NULL OR low > high").select(
        "*", none.cast("long").alias("previous_low"), none.cast("long").alias("previous_high"),
        none.cast(b.schema["label"].dataType).alias("previous_label"),
        F.when(F.col("low") > F.col("high"), "empty").otherwise("open").alias("problem"))
    columns = ["problem", "low", "high", "label", "previous_low", "previous_high", "previous_label"]
    return found.select(columns).unionByName(bad.select(columns))


def _stretches(bands: DataFrame) -> DataFrame:
    """(_level, _start, label): the aligned stretches of every band, longest
    possible ones.  From the low end stretches grow while they are aligned and
    fit, towards the high end they shrink again."""
    def grow(state: Column, level: Column) -> Column:
        # one stretch of 2^level at the low end, where that makes it aligned to the next length
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        take = ((state["at"].bitwiseAND(size)) != 0) & (state["at"] + size - 1 <= state["high"])
        return F.struct(F.when(take, state["at"] + size).otherwise(state["at"]).alias("at"), state["high"].alias("high"),
                        F.when(take, F.concat(state["out"], F.array(F.struct(level.alias("level"), state["at"].alias("start")))))
                        .otherwise(state["out"]).alias("out"))

    def shrink(state: Column, level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        take = (state["at"] <= state["high"]) & (state["at"] + size - 1 <= state["high"])
        return F.struct(F.when(take, state["at"] + size).otherwise(state["at"]).alias("at"), state["high"].alias("high"),
                        F.when(take, F.concat(state["out"], F.array(F.struct(level.alias("level"), state["at"].alias("start")))))
                        .otherwise(state["out"]).alias("out"))

    first = F.struct(F.col("low").alias("at"), F.col("high").alias("high"),
                     F.expr("CAST(array() AS array<struct<level:int,start:bigint>>)").alias("out"))
    up = F.sequence(F.lit(0), F.lit(_LEVELS - 1))
    down = F.sequence(F.lit(_LEVELS - 1), F.lit(0), F.lit(-1))
    cut = F.aggregate(down, F.aggregate(up, first, grow), shrink, lambda s: s["out"])
    return (bands.select("label", F.explode(cut).alias("_s"))
            .select(F.col("_s.level").alias("_level"), F.col("_s.start").alias("_start"), "label"))


def band_lookup(values: DataFrame, column: str, bands: DataFrame, name: str, low: str = "low", high: str = "high",
                label: str = "label", check: bool = True) -> DataFrame:
    """``values`` with the label of the band its integer ``column`` lies in, as
    ``name``; NULL for a NULL value and for one in no band.

    ``bands`` has inclusive integer bounds within +-2^60.  With ``check``, empty,
    open and overlapping bands are refused (gaps are allowed); an unchecked
    overlap would give a row per band.  Only distinct values are looked up, and
    joined back by equality.
    """
    spark = values.sparkSession
    b = bands.select(F.col(low).cast("long").alias("low"), F.col(high).cast("long").alias("high"), F.col(label).alias("label"))
    if check:
        wrong = check_bands(b).filter("problem <> 'gap'").orderBy("low").limit(3).collect()
        if wrong:
            raise ValueError("bands can't be used: " + "; ".join(f"{r.problem} at {r.low}..{r.high} ({r.label})" for r in wrong))
    path = scratch_dir(spark, "bands")
    _stretches(b).write.mode("error").parquet(path)
    cut = spark.read.parquet(path)
    levels = sorted(r["_level"] for r in cut.select("_level").distinct().collect())     # 62 at most
    code = F.col(column).cast("long")
    distinct = values.select(code.alias("_code")).filter("_code IS NOT NULL").distinct()
    of = lambda level: F.struct(F.lit(level).alias("level"), F.shiftleft(F.shiftright("_code", level), level).alias("start"))
    probes = distinct.select("_code", F.explode(F.array(*[of(level) for level in levels])).alias("_p")) if levels else None
    if probes is None:
        return values.withColumn(name, F.lit(None).cast(b.schema["label"].dataType))
    small = cut.count() <= BROADCAST_ROW_LIMIT
    found = probes.join(F.broadcast(cut) if small else cut,
                        (F.col("_p.level") == F.col("_level")) & (F.col("_p.start") == F.col("_start")))
    found = found.select(F.col("_code").alias("_known"), F.col("label").alias(f"_{name}"))
    return (values.join(found, code == F.col("_known"), "left")
            .select(*[values[c] for c in values.columns if c != name], F.col(f"_{name}").alias(name)))
