"""cohortlens: two-cohort contrast analytics as Spark DataFrame operators.

Sub-packages
------------
sources    -- table scans, the visit-shaped binding, CSV round trip, schema catalog
functions  -- pure ``Column`` builders: code decoding, banding, exact rounding, quantiles
operators  -- exclusion rules, profiles, contrasts, gap tables, scorecards
plans      -- the study specification, its dimensions, and the registered queries
streaming  -- the contrast operators run incrementally under Structured Streaming
"""

from cohortlens.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
