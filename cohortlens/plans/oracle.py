"""DuckDB SQL twins of the registered queries (the independent oracle).

Each string runs on DuckDB with the driver's tables registered as views.
``VISITS_CTE`` re-derives the visit-shaped relation from ``orders`` with
the same integer expressions as ``sources.bindings.coded_visits`` (only
``dayofweek`` differs: DuckDB counts Sunday as 0).
"""

VISITS_CTE = """
visits AS (
  SELECT
    CAST(month(o_orderdate) AS INTEGER) AS VMONTH,
    CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS VDAYR,
    CAST(CASE WHEN k % 997 = 0 THEN 575 WHEN k % 991 = 0 THEN -9
              ELSE ((k * 7) % 24) * 100 + (k * 13) % 60 END AS INTEGER) AS ARRTIME,
    CAST(CASE WHEN k % 7 = 0 THEN -9 WHEN k % 41 = 0 THEN -7
              ELSE (k * 7919 + c * 31) % 181 + CASE WHEN k % 100 < 19 THEN 0 ELSE 5 END END AS INTEGER) AS WAITTIME,
    CAST((k * 37) % 1400 AS INTEGER) AS LOV,
    CAST(c % 95 AS INTEGER) AS AGE,
    CAST(CASE WHEN k % 100 = 0 THEN -9 WHEN k % 100 IN (1, 2) THEN -8
              WHEN k % 100 < 19 THEN 1 ELSE 2 END AS INTEGER) AS ARREMS,
    CAST(CASE WHEN k % 53 = 0 THEN -9 WHEN k % 11 IN (0, 5) THEN -8 WHEN k % 29 = 0 THEN 0
              WHEN k % 31 = 0 THEN 7 ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS INTEGER) AS IMMEDR,
    CAST(CASE WHEN k % 61 = 0 THEN -9 WHEN k % 5 = 0 THEN -8 ELSE (k * 3) % 11 END AS INTEGER) AS PAINSCALE,
    CAST(c % 7 AS INTEGER) AS TOTCHRON,
    CAST(k % 2 AS INTEGER) AS ADMIT,
    CAST(c % 4 + 1 AS INTEGER) AS REGION,
    CAST(o_totalprice AS DOUBLE) AS PATWT,
    CAST(o_totalprice / 100 AS DOUBLE) AS EDWT,
    CAST(CASE WHEN k % 1009 = 0 THEN -8 WHEN k % 17 = 0 THEN -9 WHEN k % 23 = 0 THEN 0
              WHEN k % 19 = 0 THEN k % 300 + 1 ELSE -7 END AS INTEGER) AS BOARDED
  FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate, o_orderpriority, o_totalprice FROM orders)
)"""

def _lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


def case_sql(col: str, mapping) -> str:
    """``CASE col WHEN code THEN 'label' ... END`` from a codebook mapping."""
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN {_lit(v)}" for k, v in mapping.items()) + " END"


def bands_sql(col: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {col} BETWEEN {lo} AND {hi} THEN '{lab}'" for lo, hi, lab in bands) + " END"


_OPS = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}


def classify_sql(col: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {col} {_OPS[op]} {v} THEN '{lab}'" for op, v, lab in rules) + " END"


def keep_sql(rules) -> str:
    """Conjunction of ``NOT IN`` over a rule set."""
    return " AND ".join(f"{c} NOT IN ({', '.join(str(x) for x in codes)})" for c, codes in rules.items())


def label_sql() -> dict[str, str]:
    """The study's label columns as DuckDB expressions (same fixed values)."""
    from cohortlens.plans import study as S
    return {
        "arrival_method": case_sql("ARREMS", S.ARRIVAL_LABELS),
        "triage_level": case_sql("IMMEDR", S.TRIAGE_LABELS),
        "time_of_day": bands_sql("ARRTIME", S.TIME_BANDS),
        "day_of_week": case_sql("VDAYR", S.WEEKDAY_LABELS),
        "boarding_status": classify_sql("BOARDED", S.BOARDING_RULES),
        "census_region": case_sql("REGION", S.REGION_LABELS),
    }


def _clean_cte() -> str:
    from cohortlens.plans import study as S
    labels = ",\n    ".join(f"{expr} AS {name}" for name, expr in label_sql().items())
    return (f"\nclean AS (\n  SELECT {', '.join(S.BASE_COLUMNS)},\n    {labels}\n"
            f"  FROM visits\n  WHERE {keep_sql(S.CLEAN_RULES)}\n)")


def r(num: str, den: str, digits: int, factor: int = 1) -> str:
    """Exact HALF_UP rounding of factor*num/den (integers), as DuckDB SQL."""
    m = factor * 10 ** digits
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    q = f"((2 * {m} * abs({n}) + abs({d})) // (2 * abs({d})))"
    signed = f"(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -{q} ELSE {q} END)"
    return f"(CASE WHEN {d} <> 0 THEN CAST({signed} AS DOUBLE) / {float(10 ** digits)} END)"


def r_even(num: str, den: str, digits: int, factor: int = 1) -> str:
    """Exact HALF_EVEN rounding of factor*num/den (integers), as DuckDB SQL."""
    m = factor * 10 ** digits
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    scaled = f"({m} * abs({n}))"
    q = f"({scaled} // abs({d}))"
    twice = f"(2 * ({scaled} - {q} * abs({d})))"
    up = f"(CASE WHEN {twice} > abs({d}) OR ({twice} = abs({d}) AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    signed = f"(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -({q} + {up}) ELSE {q} + {up} END)"
    return f"(CASE WHEN {d} <> 0 THEN CAST({signed} AS DOUBLE) / {float(10 ** digits)} END)"


def avg1(x: str) -> str:
    return r(f"sum({x})", f"count({x})", 1)


def with_visits(body: str, clean: bool = True) -> str:
    ctes = VISITS_CTE + ("," + _clean_cte() if clean else "")
    return f"WITH {ctes}\n{body}"
