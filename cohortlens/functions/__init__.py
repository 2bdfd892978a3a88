"""Pure Column builders (no actions, no UDFs)."""

from cohortlens.functions.labels import band_cuts, band_ranges, classify, decode_codes
from cohortlens.functions.stats import (
    QUANTILE_PROBS, mean_expr, quantile_exprs, rounded_ratio, weekday_of,
)

__all__ = [
    "band_cuts", "band_ranges", "classify", "decode_codes", "QUANTILE_PROBS", "mean_expr",
    "quantile_exprs", "rounded_ratio", "weekday_of",
]
