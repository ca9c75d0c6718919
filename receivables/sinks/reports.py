"""Report sinks."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from receivables.functions import plain_number
from receivables.sources.reports import CSV_TEXT, MANIFEST, csv_files, csv_path, file_name

#: About 100 MB of a report, which one task reads.
ROWS_PER_FILE = 1_000_000
CLUSTERED_BY = ("centre_id", "class_id")


def write_partitioned(report: DataFrame, path: str) -> None:
    """Writes Parquet partitioned by ``as_at_date``.

    Only the dates that occur in ``report`` are replaced; an empty report
    replaces nothing. The rows are not gathered by date before the write: a
    report has one date, so that would send all of it to one task.
    """
    (
        report.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("as_at_date")
        .parquet(path)
    )


def clustered(report: DataFrame, by: Sequence[str] = CLUSTERED_BY) -> DataFrame:
    """``report`` ordered for writing so that rows alike in ``by`` share files, and a reader of some
    of them skips the other files by their footers.

    Ranges are cut by a hash of the document after ``by``, so a centre with most rows is spread
    over as many tasks as its size asks for; adaptive execution joins small ranges.
    """
    last = F.xxhash64("document_id", "document_type")
    return report.repartitionByRange(*by, last).sortWithinPartitions(*by, last)


def write_csv(
    report: DataFrame, base: str, as_at_date: datetime.date, rows_per_file: int = ROWS_PER_FILE
) -> None:
    """Writes CSV with a header to ``{base}_YYYY-MM-DD.csv``, no file with more than
    ``rows_per_file`` rows, and a manifest of the files in the folder's ``_manifest``.

    Amounts are written in plain digits, text exactly as it is: a field with a comma, a
    quote or a line break is quoted, and a quote within it doubled. The manifest has for each
    file its rows, bytes and SHA-256, which executors read from the files once written.
    """
    path = csv_path(base, as_at_date)
    (
        report.select(
            *(
                plain_number(F.col(field.name)).alias(field.name)
                if isinstance(field.dataType, DoubleType)
                else field.name
                for field in report.schema.fields
            )
        )
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .options(**CSV_TEXT)
        .csv(path)
    )
    spark = report.sparkSession
    texts = spark.read.options(**CSV_TEXT, multiLine=True).schema(report.schema).csv(path)
    rows = texts.groupBy(file_name(F.input_file_name()).alias("file")).agg(F.count("*").alias("rows"))
    files = csv_files(spark, path).select("file", "bytes", F.sha2("content", 256).alias("sha256"))
    manifest = files.join(rows, "file", "left").fillna(0, ["rows"])
    manifest.select("file", "rows", "bytes", "sha256").coalesce(1).write.json(f"{path}/{MANIFEST}")
