"""Functions from DataFrames to DataFrames; lazy, except ``enforce``."""

from receivables.layout import report_columns
from receivables.operators.balances import (
    join_payments,
    outstanding,
    outstanding_documents,
    payment_totals,
    with_payments,
)
from receivables.operators.buckets import (
    age_documents,
    bucketize,
    sort_report,
    to_report,
    with_days,
)
from receivables.operators.documents import (
    credit_note_documents,
    document_types,
    invoice_documents,
    unify_documents,
)
from receivables.operators.quality import (
    Finding,
    check_table,
    enforce,
    null_profile,
    observe_checks,
    rejected_lines,
    require_columns,
    type_findings,
    validate_inputs,
    validate_report,
)
from receivables.operators.reduction import key_filter, payments_for

__all__ = [
    "Finding",
    "age_documents",
    "bucketize",
    "check_table",
    "credit_note_documents",
    "document_types",
    "enforce",
    "invoice_documents",
    "join_payments",
    "key_filter",
    "null_profile",
    "observe_checks",
    "outstanding",
    "outstanding_documents",
    "payment_totals",
    "payments_for",
    "rejected_lines",
    "report_columns",
    "require_columns",
    "sort_report",
    "to_report",
    "type_findings",
    "unify_documents",
    "validate_inputs",
    "validate_report",
    "with_days",
    "with_payments",
]
