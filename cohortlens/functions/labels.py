"""Code -> label builders.

All of them return a ``Column`` made of CASE WHEN branches, so they stay
inside whole-stage codegen.  Unmatched input gives NULL (never a silent
default), which keeps codes outside a codebook visible as a NULL group.
Apply them to group keys after an aggregation when possible: the CASE then
runs once per group instead of once per row.  Each is parsed by the JVM from
one SQL expression, so building a plan costs one round trip per label column
and not one per branch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.literals import sql_literal, sql_name


def _case(branches: Sequence[tuple[str, str]]) -> Column:
    """Searched CASE over (SQL condition, label); no branch -> NULL."""
    if not branches:
        return F.lit(None).cast("string")
    return F.expr("CASE " + " ".join(f"WHEN {cond} THEN {sql_literal(label)}" for cond, label in branches) + " END")


def decode_codes(c: str, mapping: Mapping[object, str]) -> Column:
    """``CASE WHEN c = k1 THEN v1 ... END`` (NULL when unmapped)."""
    return _case([(f"{sql_name(c)} = {sql_literal(code)}", label) for code, label in mapping.items()])


def band_ranges(c: str, bands: Sequence[tuple[int, int, str]]) -> Column:
    """Closed ranges ``lo <= c <= hi``; values in gaps between bands give NULL."""
    return _case([(f"{sql_name(c)} BETWEEN {sql_literal(lo)} AND {sql_literal(hi)}", label) for lo, hi, label in bands])


def band_cuts(c: str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-open, right-closed intervals ``(edges[i], edges[i+1]]`` without gaps;
    outside the outer edges gives NULL."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need len(edges) == len(labels) + 1")
    name = sql_name(c)
    return _case([(f"{name} > {sql_literal(lo)} AND {name} <= {sql_literal(hi)}", label)
                  for lo, hi, label in zip(edges[:-1], edges[1:], labels)])


_OPS = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}


def classify(c: str, rules: Sequence[tuple[str, object, str]]) -> Column:
    """Searched CASE over ``(op, value, label)`` rules tried in order
    (``op`` in eq/ne/gt/ge/lt/le/in).  No rule matched -> NULL."""
    def cond(op: str, value: object) -> str:
        if op == "in":
            return f"{sql_name(c)} IN ({', '.join(sql_literal(v) for v in value)})"
        return f"{sql_name(c)} {_OPS[op]} {sql_literal(value)}"
    return _case([(cond(op, value), label) for op, value, label in rules])
