"""Queries over tables as they are stored, and over states that are kept.

Catalogs and ranges from Parquet footers, quantile summaries with a rank
promise, quantiles by refinement, bitmaps of codes, proven top-k.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import bands as BD
from cohortlens.operators import contrasts as C
from cohortlens.operators import distinct as D
from cohortlens.operators import heavy as H
from cohortlens.operators import rank_summary as RS
from cohortlens.operators.cube import HistogramCube
from cohortlens.operators.maintained import MaintainedStatistics
from cohortlens.operators.ordering import numbered
from cohortlens.functions.stats import rounded_ratio
from cohortlens.plans import study as S
from cohortlens.plans import steps as T
from cohortlens.plans.oracle import avg1, with_visits
from cohortlens.plans.registry import N, ORACLE, PCT_ALL, query, visits
from cohortlens.session import scratch_dir
from cohortlens.sources import bindings as B
from cohortlens.sources import footers as FT
from cohortlens.sources import statistics as ST

#: The given tables.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


# ---- catalog of stored data (S3-S6) ----------------------------------------------

def _footers(spark, sf_dir, *tables):
    found = FT.file_footers(spark, *[f"{sf_dir.rstrip('/')}/{t}.parquet" for t in tables])
    return found.withColumn("table_name", F.regexp_extract("file", r"([^/]+)\.parquet(/[^/]*)?$", 1))


_KIND_SQL = ("CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
             "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' "
             "ELSE column_type END")


def _described(table: str) -> str:
    return (f"SELECT '{table}' AS table_name, column_name, {_KIND_SQL} AS data_type, "
            f"CAST(row_number() OVER () AS INTEGER) AS ordinal_position, (SELECT {N} FROM {table}) AS n_rows "
            f"FROM (DESCRIBE {table})")


@query("stored_column_inventory", " UNION ALL ".join(_described(t) for t in TABLES))
def stored_column_inventory(spark, sf_dir):
    """Every column of every given table as its files store it."""
    return FT.stored_inventory(_footers(spark, sf_dir, *TABLES), ["table_name"]).drop("n_files", "null_count")


#: What the visit binding expects of ``orders``, and what other builds of the table also have.
_EXPECTED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
             "o_totalprice": "decimal(15,2)", "o_shippriority": "int"}
_EXPECTED_SQL = ", ".join(f"('{c}', '{t}')" for c, t in _EXPECTED.items())


@query("stored_schema_validation",
       f"WITH d AS ({_described('orders')}) SELECT e.column_name, d.data_type, e.expected_type, d.ordinal_position, "
       "coalesce(d.data_type = e.expected_type, false) AS ok "
       f"FROM (VALUES {_EXPECTED_SQL}) AS e(column_name, expected_type) LEFT JOIN d USING (column_name)")
def stored_schema_validation(spark, sf_dir):
    return FT.validate_stored(_footers(spark, sf_dir, "orders"), _EXPECTED).drop("n_files")


@query("stored_required_columns",
       f"WITH d AS ({_described('orders')}) SELECT e.column_name, d.column_name IS NOT NULL AS present "
       f"FROM (VALUES {_EXPECTED_SQL}) AS e(column_name, expected_type) LEFT JOIN d USING (column_name)")
def stored_required_columns(spark, sf_dir):
    return FT.required_stored(_footers(spark, sf_dir, "orders"), list(_EXPECTED)).select("column_name", "present")


@query("stored_key_types",
       "SELECT column_name, data_type, CAST(count(*) AS BIGINT) AS n_tables, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM ("
       + " UNION ALL ".join(_described(t) for t in ("documents", "labels")) + ") GROUP BY column_name, data_type HAVING count(*) < 2")
def stored_key_types(spark, sf_dir):
    """``documents`` and ``labels`` taken as one folder: what drifts between
    their files, column by column, with the files that store it so."""
    found = _footers(spark, sf_dir, "documents", "labels").withColumn("file", F.col("table_name"))
    found = found.groupBy("file", "column_name", "data_type").agg(F.sum("n_rows").alias("n_rows"), F.max("problem").alias("problem"))
    drift = FT.schema_drift(found)
    return drift.filter("data_type IS NOT NULL").select("column_name", "data_type", F.col("n_files").alias("n_tables"), "n_rows")


# ---- counts and ranges from footers (S7, A1, A20) --------------------------------

_RANGED = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
           "orders": ["o_orderkey", "o_custkey", "o_totalprice"], "labels": ["doc_id", "quality", "toxic"]}


@query("stored_ranges", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {N} AS n_rows, CAST(count({c}) AS BIGINT) AS n_values, "
    f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, CAST(min({c}) AS DOUBLE) AS min_value, "
    f"CAST(max({c}) AS DOUBLE) AS max_value FROM {t}" for t, cs in _RANGED.items() for c in cs))
def stored_ranges(spark, sf_dir):
    """Rows, NULLs, least and greatest values of stored columns, from footers."""
    out = None
    for t, columns in _RANGED.items():
        found = ST.ranges(ST.read(spark, f"{sf_dir}/{t}.parquet"), columns).select(F.lit(t).alias("table_name"), "*")
        out = found if out is None else out.unionByName(found)
    return out


# ---- quantile summaries with a rank promise (A18, X5) ----------------------------

_EPSILON = 0.01


def _boundaries_sql(keys: list[str], part: str, value: str, table: str, k: int = 4) -> str:
    """The summary's definition again: points per (keys, part), increments,
    running bounds over all parts, the point of least possible error."""
    g = ", ".join(keys)
    on = " AND ".join(f"a.{c} IS NOT DISTINCT FROM w.{c}" for c in keys)
    return f"""
WITH h AS (SELECT {g}, {part} AS part, {value} + 0.0 AS v, count(*) AS c FROM {table} GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY {g}, part ORDER BY v) AS up, sum(c) OVER (PARTITION BY {g}, part) AS n
  FROM h WHERE v IS NOT NULL),
s AS (SELECT *, greatest(floor(CAST({_EPSILON} AS DOUBLE) * n), 1) AS step,
  lag(up) OVER (PARTITION BY {g}, part ORDER BY v) AS prev FROM r),
t AS (SELECT *, floor(up / step) > floor(coalesce(prev, 0) / step) AS crossing FROM s),
u AS (SELECT *, lead(crossing) OVER (PARTITION BY {g}, part ORDER BY v) AS nxt FROM t),
k AS (SELECT * FROM u WHERE crossing OR prev IS NULL OR nxt IS NULL OR nxt),
p AS (SELECT {g}, v, up - coalesce(lag(up) OVER o, 0) AS d_lo, coalesce(lead(up - c) OVER o, n) - (up - c) AS d_hi,
  coalesce(lead(up - c) OVER o, n) - up AS at_hi, c AS at_lo FROM k WINDOW o AS (PARTITION BY {g}, part ORDER BY v)),
m AS (SELECT {g}, v, sum(d_lo) AS d_lo, sum(d_hi) AS d_hi, sum(at_hi) AS at_hi, sum(at_lo) AS at_lo FROM p GROUP BY {g}, v),
b AS (SELECT {g}, v, sum(d_lo) OVER o AS up_lo, sum(d_hi) OVER o - at_hi AS up_hi, sum(d_lo) OVER o - at_lo AS bel_lo,
  sum(d_hi) OVER o - d_hi AS bel_hi, sum(d_lo) OVER (PARTITION BY {g}) AS n FROM m WINDOW o AS (PARTITION BY {g} ORDER BY v)),
j AS (SELECT *, greatest(ceil(CAST(n AS DOUBLE) * j / {k}), 1) AS want FROM b, range(0, {k + 1}) AS x(j)),
e AS (SELECT *, greatest(bel_hi + 1 - want, want - up_lo, 0) AS err FROM j),
w AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY {g}, j ORDER BY err, v) = 1),
a AS (SELECT {g}, sum(c) AS n_rows FROM h GROUP BY {g})
SELECT {", ".join(f"a.{c}" for c in keys)}, CAST(n_rows AS BIGINT) AS n_rows, CAST(coalesce(w.n, 0) AS BIGINT) AS n, CAST(x.j AS INTEGER) AS boundary_number,
  CAST(v AS DOUBLE) AS boundary, CAST(bel_lo + 1 AS BIGINT) AS rank_low, CAST(up_hi AS BIGINT) AS rank_high, CAST(err AS BIGINT) AS rank_error
FROM a CROSS JOIN range(0, {k + 1}) AS x(j) LEFT JOIN w ON {on} AND w.j = x.j"""


def _exploded(found, keys):
    each = F.posexplode(F.arrays_zip("boundary", "rank_low", "rank_high", "rank_error")).alias("boundary_number", "_x")
    return found.select(*keys, "n_rows", "n", each).select(*keys, "n_rows", "n", "boundary_number", "_x.*")


@query("orders_price_boundaries", _boundaries_sql(
    ["o_orderstatus", "o_orderpriority"], "year(o_orderdate)", "o_totalprice", "orders"))
def orders_price_boundaries(spark, sf_dir):
    """The whole boundary array of order totals with rank bounds, merged from a
    summary per (status, priority, year)."""
    o = (B.read_table(spark, sf_dir, "orders", ["o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice"])
         .withColumn("year", F.year("o_orderdate")))
    keys = ["o_orderstatus", "o_orderpriority"]
    return _exploded(RS.boundaries(RS.summarise(o, keys, "o_totalprice", _EPSILON, "year"), keys), keys)


@query("wait_boundaries", with_visits(", visit AS (SELECT * FROM clean), " + _boundaries_sql(
    ["ARREMS", "IMMEDR"], "VDAYR", "WAITTIME", "visit").strip()[len("WITH "):]))
def wait_boundaries(spark, sf_dir):
    """Boundaries of the waiting time per arrival method and triage level,
    merged from a summary per weekday."""
    keys = ["ARREMS", "IMMEDR"]
    clean = S.clean_universe(visits(spark, sf_dir))
    return _exploded(RS.boundaries(RS.summarise(clean, keys, "WAITTIME", _EPSILON, "VDAYR"), keys), keys)


# ---- exact quantiles by refinement (A19) -----------------------------------------

@query("lineitem_price_quartiles",
       f"SELECT l_returnflag, l_linestatus, {N} AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price, "
       "round(quantile_cont(l_extendedprice, 0.25), 4) AS p25_price, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75_price "
       "FROM lineitem GROUP BY l_returnflag, l_linestatus")
def lineitem_price_quartiles(spark, sf_dir):
    """Exact quartiles of a measure of nearly distinct values; only bins are shuffled."""
    li = B.read_table(spark, sf_dir, "lineitem", ["l_returnflag", "l_linestatus", "l_extendedprice"])
    return C.contrast(li, "l_returnflag", "l_linestatus", "l_extendedprice", stats=("n", "median", "p25", "p75"),
                      method="exact_refined", digits=4, suffix="price")


# ---- exact distinct counts from bitmaps (A2) -------------------------------------

@query("cardinality_from_bitmaps", with_visits(
    f"SELECT {N} AS total_records, " + ", ".join(
        f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_{c.lower()}" for c in (*S.CARDINALITY_COLUMNS, "AGE", "ARRTIME"))
    + " FROM visits", clean=False))
def cardinality_from_bitmaps(spark, sf_dir):
    """Bitmaps per month of the visit, merged."""
    columns = [*S.CARDINALITY_COLUMNS, "AGE", "ARRTIME"]
    return D.distinct_counts(D.distinct_state(visits(spark, sf_dir), columns, "VMONTH"), columns)


# ---- proven top-k (O5, W3, W4) ---------------------------------------------------

def _top_sql(column: str, table: str, k: int) -> str:
    return (f"SELECT value, n, pct_of_total, rank FROM (SELECT {column} AS value, {N} AS n, {PCT_ALL} AS pct_of_total, "
            f"CAST(row_number() OVER (ORDER BY count(*) DESC, {column} ASC NULLS LAST) AS INTEGER) AS rank "
            f"FROM {table} GROUP BY {column}) WHERE rank <= {k}")


@query("lineitem_top_prices", _top_sql("l_extendedprice", "lineitem", 20))
def lineitem_top_prices(spark, sf_dir):
    """A column of nearly distinct values: the proof fails, all buckets are counted."""
    return H.heavy_hitters(B.read_table(spark, sf_dir, "lineitem", ["l_extendedprice"]), "l_extendedprice", 20).drop("others_at_most")


@query("events_top_users", _top_sql("user_id", "events", 20))
def events_top_users(spark, sf_dir):
    return H.heavy_hitters(B.read_table(spark, sf_dir, "events", ["user_id"]), "user_id", 20).drop("others_at_most")


@query("documents_top_sources", _top_sql("source", "documents", 5))
def documents_top_sources(spark, sf_dir):
    """A column with a hot value: settled by the second pass."""
    return H.heavy_hitters(B.read_table(spark, sf_dir, "documents", ["source"]), "source", 5).drop("others_at_most")


# ---- any filter combination from one cube (P12, A15) -----------------------------

_FILTERS = ["IMMEDR", "PAINSCALE", "REGION", "VDAYR", "time_of_day"]


@query("filter_cube_statistics", with_visits(
    f"SELECT CAST(grouping_id({', '.join(_FILTERS)}) AS INTEGER) AS filter_set, ARREMS, {', '.join(_FILTERS)}, {N} AS n, "
    f"{avg1('WAITTIME')} AS avg_wait_minutes, CAST(quantile_cont(WAITTIME, 0.5) AS DOUBLE) AS median_wait_minutes "
    f"FROM clean GROUP BY ARREMS, CUBE ({', '.join(_FILTERS)})"))
def filter_cube_statistics(spark, sf_dir):
    """Every combination of the five optional filters, off the stored cube."""
    cube = HistogramCube.build(S.clean_universe(visits(spark, sf_dir)), ["ARREMS"], _FILTERS, "WAITTIME")
    found = cube.everything({"median_wait_minutes": 0.5})
    return found.select("filter_set", "ARREMS", *_FILTERS, "n", rounded_ratio("total", "n_valid", 1).alias("avg_wait_minutes"),
                        "median_wait_minutes")


@query("filter_cube_lookups", with_visits(
    "SELECT 'triage 3, Monday' AS slice, ARREMS, CAST(NULL AS INTEGER) AS REGION, " + N + " AS n, "
    "CAST(quantile_cont(WAITTIME, 0.5) AS DOUBLE) AS median FROM clean WHERE IMMEDR = 3 AND VDAYR = 2 GROUP BY ARREMS "
    "UNION ALL SELECT 'pain 10 by region', ARREMS, REGION, " + N + ", CAST(quantile_cont(WAITTIME, 0.5) AS DOUBLE) "
    "FROM clean WHERE PAINSCALE = 10 GROUP BY ARREMS, REGION "
    "UNION ALL SELECT 'no band', ARREMS, NULL, " + N + ", CAST(quantile_cont(WAITTIME, 0.5) AS DOUBLE) "
    "FROM clean WHERE time_of_day IS NULL GROUP BY ARREMS"))
def filter_cube_lookups(spark, sf_dir):
    """Three questions to one cube; each reads one folder of it."""
    cube = HistogramCube.build(S.clean_universe(visits(spark, sf_dir)), ["ARREMS"], _FILTERS, "WAITTIME")
    none = F.lit(None).cast("int").alias("REGION")
    one = cube.statistics({"IMMEDR": 3, "VDAYR": 2}).select(F.lit("triage 3, Monday").alias("slice"), "ARREMS", none, "n", "median")
    two = cube.statistics({"PAINSCALE": 10}, ["REGION"]).select(F.lit("pain 10 by region").alias("slice"), "ARREMS", "REGION", "n", "median")
    three = cube.statistics({"time_of_day": None}).select(F.lit("no band").alias("slice"), "ARREMS", none, "n", "median")
    return one.unionByName(two).unionByName(three)


# ---- statistics that follow a growing table (V4, A14) ----------------------------

_LEVELS = {"triage": "IMMEDR", "pain": "PAINSCALE", "boarding": "boarding_status", "region": "REGION"}


@query("maintained_contrasts", with_visits(
    "\nSELECT dimension, cohort, level, n, avg_wait_minutes, median_wait_minutes FROM (" + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, ARREMS AS cohort, CAST({c} AS VARCHAR) AS level, {N} AS n, "
        f"{avg1('WAITTIME')} AS avg_wait_minutes, CAST(quantile_cont(WAITTIME, 0.5) AS DOUBLE) AS median_wait_minutes "
        f"FROM (SELECT * FROM clean WHERE VDAYR <> 7) GROUP BY ARREMS, {c}" for d, c in _LEVELS.items()) + ")"))
def maintained_contrasts(spark, sf_dir):
    """Contrasts off the states of a table that grew day by day: days 1 to 3
    arrive, then 4 to 7 while day 2, which was first stored without its
    ambulances, is rewritten, then day 7 is deleted."""
    # a day of the week as the partition; its folder names differ from the column
    rows = visits(spark, sf_dir).filter("VDAYR IS NOT NULL").withColumn("day", F.col("VDAYR"))
    source = scratch_dir(spark, "maintained-source")
    state = MaintainedStatistics(spark, source, scratch_dir(spark, "maintained-state"), "day", "ARREMS", _LEVELS, "WAITTIME",
                                 S.clean_universe)

    def put(some):
        (some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(source))

    put(rows.filter("day <= 3 AND NOT (day = 2 AND ARREMS = 1)"))
    state.refresh()
    put(rows.filter("day >= 4 OR day = 2"))
    state.refresh()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{source}/day=7")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    state.refresh()
    out = None
    for d in _LEVELS:
        found = state.statistics(d, {"median_wait_minutes": 0.5}).select(
            F.lit(d).alias("dimension"), "cohort", "level", "n",
            rounded_ratio("total", "n_valid", 1).alias("avg_wait_minutes"), "median_wait_minutes")
        out = found if out is None else out.unionByName(found)
    return out


# ---- bands as data (P18, P19) ----------------------------------------------------

_HALF_HOURS = [(h * 100 + m, h * 100 + m + 29, f"{h:02d}:{m:02d}") for h in range(24) for m in (0, 30)]


@query("half_hour_profile", with_visits(
    "\nSELECT CASE WHEN ARRTIME BETWEEN 0 AND 2359 AND ARRTIME % 100 < 60 THEN printf('%02d:%02d', ARRTIME // 100, "
    f"(ARRTIME % 100) // 30 * 30) END AS half_hour, {N} AS n, {PCT_ALL} AS pct_of_total FROM clean GROUP BY 1"))
def half_hour_profile(spark, sf_dir):
    """Arrivals per half hour, the bands a table; times in its gaps have none."""
    bands = spark.createDataFrame(_HALF_HOURS, "low long, high long, label string")
    clean = BD.band_lookup(S.clean_universe(visits(spark, sf_dir)).select("ARRTIME"), "ARRTIME", bands, "half_hour")
    return T.P.frequency(clean, "half_hour", value_name="half_hour")


_BAND_WIDTH = 250


@query("orders_key_bands",
       f"SELECT ((o_orderkey - k) // {_BAND_WIDTH}) * {_BAND_WIDTH} + k AS first_key, {N} AS n, "
       "CAST(sum(o_totalprice) AS DECIMAL(20, 0)) > 0 AS any_price FROM orders, (SELECT min(o_orderkey) AS k FROM orders) "
       "WHERE o_orderkey IS NOT NULL GROUP BY 1")
def orders_key_bands(spark, sf_dir):
    """A band table that grows with the data: a band per 250 order keys."""
    o = B.read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"])
    ends = o.agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    bands = (ends.filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.lit(_BAND_WIDTH).cast("long"))).alias("low"))
             .select("low", (F.col("low") + _BAND_WIDTH - 1).alias("high"), F.col("low").alias("label")))
    found = BD.band_lookup(o.filter("o_orderkey IS NOT NULL"), "o_orderkey", bands, "first_key")
    return found.groupBy("first_key").agg(F.count(F.lit(1)).alias("n"),
                                          (F.sum("o_totalprice").cast("decimal(20,0)") > 0).alias("any_price"))


# ---- order over a union, numbered (O4, O6) ---------------------------------------

@query("stacked_profile_order", with_visits(
    ", stacked AS (" + ORACLE["stacked_profile"].split("\n)\n")[-1].strip() + ") SELECT block, column_name, value, n, "
    "CAST(row_number() OVER (ORDER BY block, n DESC, value ASC NULLS FIRST) AS BIGINT) AS position FROM stacked", clean=False))
def stacked_profile_order(spark, sf_dir):
    """The stacked profile's rows with their position: by block, then from the
    most to the least frequent, ties by value."""
    order = [F.asc("block"), F.desc("n"), F.asc_nulls_first("value")]
    return numbered(T.stacked_profile(visits(spark, sf_dir), None), order).select("block", "column_name", "value", "n", "position")


@query("price_frequency_order",
       f"SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value ASC NULLS FIRST) AS BIGINT) AS position FROM ("
       f"SELECT l_extendedprice AS value, {N} AS n FROM lineitem GROUP BY 1)")
def price_frequency_order(spark, sf_dir):
    """A frequency profile of nearly distinct values with every row's position."""
    li = B.read_table(spark, sf_dir, "lineitem", ["l_extendedprice"])
    return numbered(T.P.frequency(li, "l_extendedprice").select("value", "n"), [F.desc("n"), F.asc_nulls_first("value")])
