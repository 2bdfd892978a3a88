"""Bindings from the driver's tables to the shapes the operators expect.

The study's own table (one row per emergency-department visit, coded
integer columns) is not shipped, so ``coded_visits`` derives a visit-shaped
relation from ``orders`` with deterministic integer expressions.  Every
column is a plain Catalyst expression over one scan of ``orders``: no UDF,
no shuffle, and the scan reads only the four columns used.

``lineitem_measures`` and ``event_measures`` bind the same operators to real
columns without any coding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column order of the visit table (codebook order of the study's core columns).
VISIT_COLUMNS = [
    "VMONTH", "VDAYR", "ARRTIME", "WAITTIME", "LOV", "AGE", "ARREMS", "IMMEDR",
    "PAINSCALE", "TOTCHRON", "ADMIT", "REGION", "PATWT", "EDWT", "BOARDED",
]


#: Columns of ``coded_visits`` as SQL over ``orders``; the first matching
#: branch of a CASE wins.  All are integers but the two weights.
_CODED = {
    "VMONTH": "month(o_orderdate)",
    "VDAYR": "dayofweek(o_orderdate)",
    "ARRTIME": "CASE WHEN o_orderkey % 997 = 0 THEN 575 WHEN o_orderkey % 991 = 0 THEN -9"
               " ELSE ((o_orderkey * 7) % 24) * 100 + (o_orderkey * 13) % 60 END",
    "WAITTIME": "CASE WHEN o_orderkey % 7 = 0 THEN -9 WHEN o_orderkey % 41 = 0 THEN -7"
                " ELSE (o_orderkey * 7919 + o_custkey * 31) % 181 + CASE WHEN o_orderkey % 100 < 19 THEN 0 ELSE 5 END END",
    "LOV": "(o_orderkey * 37) % 1400",
    "AGE": "o_custkey % 95",
    "ARREMS": "CASE WHEN o_orderkey % 100 = 0 THEN -9 WHEN o_orderkey % 100 IN (1, 2) THEN -8"
              " WHEN o_orderkey % 100 < 19 THEN 1 ELSE 2 END",
    "IMMEDR": "CASE WHEN o_orderkey % 53 = 0 THEN -9 WHEN o_orderkey % 11 IN (0, 5) THEN -8"
              " WHEN o_orderkey % 29 = 0 THEN 0 WHEN o_orderkey % 31 = 0 THEN 7"
              " ELSE CAST(substring(o_orderpriority, 1, 1) AS int) END",
    "PAINSCALE": "CASE WHEN o_orderkey % 61 = 0 THEN -9 WHEN o_orderkey % 5 = 0 THEN -8 ELSE (o_orderkey * 3) % 11 END",
    "TOTCHRON": "o_custkey % 7",
    "ADMIT": "o_orderkey % 2",
    "REGION": "o_custkey % 4 + 1",
    "PATWT": "o_totalprice",
    "EDWT": "o_totalprice / 100",
    "BOARDED": "CASE WHEN o_orderkey % 1009 = 0 THEN -8 WHEN o_orderkey % 17 = 0 THEN -9 WHEN o_orderkey % 23 = 0 THEN 0"
               " WHEN o_orderkey % 19 = 0 THEN o_orderkey % 300 + 1 ELSE -7 END",
}
_REAL = ("PATWT", "EDWT")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan of one driver table; ``columns`` prunes the read schema."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def coded_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visit-shaped relation over ``orders`` (15 coded columns, codebook order).

    Sentinel codes (-9, -8, -7, 99, 0, 7,
    unmapped -8 in BOARDED, 575 in the HHMM gap) are planted at fixed key
    residues so every exclusion and labelling rule is exercised.
    """
    o = read_table(spark, sf_dir, "orders")
    return o.selectExpr(*[f"CAST({sql} AS {'double' if name in _REAL else 'int'}) AS {name}" for name, sql in _CODED.items()])


def read_visits(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored visit table (any number of extra columns).  Operators select
    what they use, so the scan reads only those columns, and the exclusion
    rules reach the reader as pushed ``Not(In(...))`` filters."""
    return spark.read.format(fmt).load(path)


def lineitem_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real columns of ``lineitem``: cohort = linestatus, level = linenumber,
    measure = quantity (whole units, held as int so sums are exact), share
    and rate over returnflag, weekday of shipdate."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_linestatus", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"])
    return li.withColumn("quantity", F.col("l_quantity").cast("int"))


def event_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with an HHMM clock and the value in integer cents."""
    e = read_table(spark, sf_dir, "events", ["event_type", "ts", "value"])
    return e.select(
        "event_type",
        (F.hour("ts") * 100 + F.minute("ts")).cast("int").alias("hhmm"),
        F.round(F.col("value") * 100).cast("long").alias("amount_cents"),
    )
