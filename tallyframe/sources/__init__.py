"""Reading and storing datasets, writing reports."""

from tallyframe.sources.datasets import (
    malformed_counts,
    malformed_rows,
    nan_to_null,
    preview,
    read_dataset,
)
from tallyframe.sources.reports import read_report, write_report
from tallyframe.sources.store import read_store, replace_months, write_store

__all__ = [
    "malformed_counts",
    "malformed_rows",
    "nan_to_null",
    "preview",
    "read_dataset",
    "read_report",
    "read_store",
    "replace_months",
    "write_report",
    "write_store",
]
