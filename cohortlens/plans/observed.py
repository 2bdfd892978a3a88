"""A stored base relation that carries its own expected figures.

The labelled visits are written once.  While they pass by, an ``Observation``
counts them: the exclusion accounting and every figure of the scorecard, by
running aggregates (counts, sums, approximate medians) over the rows as read.
The scorecard then works its figures out again from the stored copy, through
the histogram path, and holds them against what was observed: two paths over
the data, and a copy that lost, doubled or changed rows fails.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cohortlens.plans import checks as K
from cohortlens.plans import study as S
from cohortlens.session import scratch_dir

MEASURE = "WAITTIME"
#: Rank error of the observed medians, as a share of the rows: 1 / ACCURACY.
ACCURACY = 10_000


@dataclass(frozen=True)
class Observed:
    """The stored copy, the expected figure of every check, and the exclusion
    accounting of the two-layer rules."""
    stored: DataFrame
    expected: dict[str, float | None]
    waterfall: dict[str, int]


def _ratio(num: int | None, den: int | None, digits: int, factor: int = 1) -> float | None:
    if num is None or not den:
        return None
    return float((Decimal(factor * num) / Decimal(den)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def _metrics(figures: list[tuple[str, str, str | None, str | None]]) -> list[Column]:
    """Running aggregates, from the filters' SQL text: the figures as ``n`` and
    ``d`` by number, and the accounting, no number derived from another."""
    out = []
    for i, (_, kind, where, of) in enumerate(figures):
        rows = where or "true"
        value = f"CASE WHEN {rows} THEN {MEASURE} END"
        out += {"count": [f"count_if({rows}) AS n{i}"],
                "share": [f"count_if({rows}) AS n{i}", f"count_if({of or 'true'}) AS d{i}"],
                "mean": [f"sum({value}) AS n{i}", f"count({value}) AS d{i}"],
                "median": [f"percentile_approx({value}, 0.5, {ACCURACY}) AS n{i}"]}[kind]
    caught = {c: f"coalesce({c} IN ({', '.join(map(str, codes))}), false)" for c, codes in S.TWO_LAYER_RULES.items()}
    keep = " AND ".join(f"{c} NOT IN ({', '.join(map(str, codes))})" for c, codes in S.TWO_LAYER_RULES.items())
    catches = " + ".join(f"CAST({hit} AS int)" for hit in caught.values())
    out += ["count(*) AS total_records", *[f"count_if({hit}) AS {c.lower()}_excluded" for c, hit in caught.items()],
            f"count_if({catches} > 1) AS multi_rule_excluded", f"count_if({catches} = 0 AND ({keep}) IS NULL) AS null_excluded",
            f"count_if(coalesce({keep}, false)) AS clean_universe"]
    return [F.expr(x) for x in out]


def observed_store(visits: DataFrame, path: str | None = None) -> Observed:
    """Store the labelled visits (default: under the shared checkpoint folder)
    and return them with what was observed on the way; ``visits`` is read once.

    Expected figures come rounded as the study publishes them: shares to two
    digits, means to one, medians as observed values; None where no row counts.
    """
    spark = visits.sparkSession
    path = path or scratch_dir(spark, "observed-visits")
    seen, figures = Observation("base"), K.figures_sql()
    labelled = S.labelled_visits(visits)
    labelled.observe(seen, *_metrics(figures)).write.mode("error").parquet(path)
    found = seen.get
    expected = {}
    for i, (label, kind, _, _) in enumerate(figures):
        n, d = found[f"n{i}"], found.get(f"d{i}")
        expected[label] = (_ratio(n, d, 2, 100) if kind == "share" else _ratio(n, d, 1) if kind == "mean"
                           else None if n is None else float(n))
    names = [k for k in found if k.endswith("_excluded") or k in ("total_records", "clean_universe")]
    return Observed(spark.read.schema(labelled.schema).parquet(path), expected, {k: found[k] for k in names})
