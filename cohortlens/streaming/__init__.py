"""The contrast operators run incrementally under Structured Streaming."""

from cohortlens.streaming.incremental import (
    STREAMABLE_DIMENSIONS, finish_batch, incremental_contrast, start, visit_stream,
)

__all__ = ["STREAMABLE_DIMENSIONS", "finish_batch", "incremental_contrast", "start", "visit_stream"]
