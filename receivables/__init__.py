"""Accounts-receivable ageing on Spark."""

from receivables.plans import (
    ageing_report,
    ageing_report_from_views,
    publish_ageing_report,
)

__all__ = ["ageing_report", "ageing_report_from_views", "publish_ageing_report"]
