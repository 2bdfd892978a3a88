"""DataFrame -> DataFrame operators."""

from cohortlens.operators.bands import band_lookup, check_bands
from cohortlens.operators.contrasts import cohort_rate, contrast, rate_ratio, share_within
from cohortlens.operators.cube import HistogramCube
from cohortlens.operators.decode import decode_with_table
from cohortlens.operators.distinct import distinct_counts, distinct_state
from cohortlens.operators.gaps import gap_extremes, gap_table, gap_verdict, mean_median_divergence
from cohortlens.operators.heavy import heavy_hitters
from cohortlens.operators.maintained import MaintainedStatistics
from cohortlens.operators.ordering import numbered, with_previous
from cohortlens.operators.profile import (
    cardinality, frequency, profile_subtotals, range_check, sentinel_hunt, sentinel_summary,
    stack_blocks, top_values,
)
from cohortlens.operators.rank_summary import boundaries, compact, summarise
from cohortlens.operators.rules import (
    exclude_codes, final_universe, keep_mask, layer_accounting, waterfall,
)
from cohortlens.operators.scorecard import (
    Check, filtered_statistics, method_agreement, scorecard, scorecard_summary,
)
from cohortlens.operators.selection import refined_quantiles

__all__ = [
    "band_lookup", "check_bands", "HistogramCube", "distinct_counts", "distinct_state", "heavy_hitters",
    "MaintainedStatistics", "numbered", "with_previous", "boundaries", "compact", "summarise", "refined_quantiles",
    "cohort_rate", "contrast", "filtered_statistics", "rate_ratio", "share_within",
    "decode_with_table", "gap_extremes", "gap_table", "gap_verdict", "mean_median_divergence",
    "cardinality", "frequency", "profile_subtotals", "range_check", "sentinel_hunt",
    "sentinel_summary", "stack_blocks", "top_values",
    "exclude_codes", "final_universe", "keep_mask", "layer_accounting", "waterfall",
    "Check", "filtered_statistics", "method_agreement", "scorecard", "scorecard_summary",
]
