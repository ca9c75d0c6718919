"""Whole reports, put together from the operators."""

from receivables.plans.report import (
    ageing_report,
    ageing_report_from_views,
    observed_report,
    publish_ageing_report,
)

__all__ = [
    "ageing_report",
    "ageing_report_from_views",
    "observed_report",
    "publish_ageing_report",
]
