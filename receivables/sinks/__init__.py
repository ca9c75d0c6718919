"""Writing reports. All writing is done by the executors."""

from receivables.sinks.reports import clustered, write_csv, write_partitioned

__all__ = ["clustered", "write_csv", "write_partitioned"]
