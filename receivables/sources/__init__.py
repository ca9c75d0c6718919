"""Typed scans, named relations and stored reports."""

from receivables.sources.reports import csv_path, read_csv_report, read_report
from receivables.sources.tables import read_inputs, read_table
from receivables.sources.views import register_views

__all__ = [
    "csv_path",
    "read_csv_report",
    "read_inputs",
    "read_report",
    "read_table",
    "register_views",
]
