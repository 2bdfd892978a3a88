"""Scans, bindings and schema catalog."""

from cohortlens.sources.bindings import (
    VISIT_COLUMNS, coded_visits, event_measures, lineitem_measures, read_table,
)
from cohortlens.sources.catalog import (
    column_inventory, dataset_shape, head_sample, required_columns, validate_schema,
)
from cohortlens.sources.csv import VISIT_SCHEMA, csv_round_trip, read_visits_csv
from cohortlens.sources.footers import file_footers, required_stored, schema_drift, stored_inventory, validate_stored
from cohortlens.sources.statistics import ranges, statistics_session

__all__ = [
    "file_footers", "required_stored", "schema_drift", "stored_inventory", "validate_stored", "ranges", "statistics_session",
    "VISIT_COLUMNS", "VISIT_SCHEMA", "coded_visits", "event_measures", "lineitem_measures",
    "read_table", "column_inventory", "dataset_shape", "head_sample", "required_columns",
    "validate_schema", "csv_round_trip", "read_visits_csv",
]
