"""A report store whose dates are replaced as a whole, old versions kept.

A version of a date is a folder of Parquet files that is written once and never changed:
``versions/as_at_date=D/version=ID``. What makes it the date's report is a commit: one small
file in ``commits/as_at_date=D``, a row for each file of the version with its number of rows.
Spark puts a file in its place only when it is complete, so a reader sees the old version or
the new one, before, during and after a write, and after a write that fails. The commit with
the greatest number counts; of two written at the same time with one number, that with the
greater version id, for every reader.

Reading takes the files a commit names. One that is gone is an error, not a shorter report.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from receivables.functions import AGE_BUCKETS, AgeBucket
from receivables.functions.ageing import as_date_text
from receivables.layout import report_schema
from receivables.scratch import remove

# A row for each file of a committed version.
COMMIT = (
    "number LONG, version STRING, columns ARRAY<STRING>, file STRING, rows LONG, "
    "committed_at TIMESTAMP, as_at_date DATE"
)


def _folder(store: str, as_at_date: datetime.date, version: str) -> str:
    return f"{store}/versions/as_at_date={as_date_text(as_at_date)}/version={version}"


def stage_version(report: DataFrame, store: str, as_at_date: datetime.date) -> str:
    """Writes ``report``, which has this date alone, as a version that nobody reads yet; gives
    its id. What a failed write leaves is removed."""
    version = uuid.uuid4().hex
    folder = _folder(store, as_at_date, version)
    try:
        report.drop("as_at_date").write.parquet(folder)
    except BaseException:
        drop_version(report.sparkSession, store, as_at_date, version)
        raise
    return version


def drop_version(spark: SparkSession, store: str, as_at_date: datetime.date, version: str) -> None:
    """Removes a version that was not committed, and folders above it that it leaves empty."""
    remove(spark, _folder(store, as_at_date, version), empty_above=3)


def commit_version(spark: SparkSession, store: str, as_at_date: datetime.date, version: str) -> int:
    """Makes a staged version the date's report; gives its number, one more than the last.

    Row counts come from the files' footers. ``ValueError`` if the version has no rows.
    """
    folder = _folder(store, as_at_date, version)
    staged = spark.read.parquet(folder)
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    files = staged.groupBy(file.alias("file")).agg(F.count("*").alias("rows"))
    last = _commits(spark, store, as_at_date)
    number = 1 + (last.agg(F.max("number")).first()[0] or 0 if last is not None else 0)
    commit = files.select(
        F.lit(number).cast("long").alias("number"),
        F.lit(version).alias("version"),
        F.array(*map(F.lit, staged.columns)).alias("columns"),
        "file",
        "rows",
        F.current_timestamp().alias("committed_at"),
    )
    path = f"{store}/commits/as_at_date={as_date_text(as_at_date)}"
    # A row for each file of the report, so that one file takes the commit.
    commit.coalesce(1).write.mode("append").json(path, ignoreNullFields=False)
    if not spark.read.schema(COMMIT).json(path).filter(F.col("version") == version).head(1):
        raise ValueError(f"the version of {as_at_date} is empty")
    return number


def _commits(spark: SparkSession, store: str, as_at_date: datetime.date | None = None) -> DataFrame | None:
    """The commits of a date or of all; None if there are none."""
    reader, path = spark.read.schema(COMMIT).option("basePath", f"{store}/commits"), f"{store}/commits"
    if as_at_date is not None:
        path = f"{path}/as_at_date={as_date_text(as_at_date)}"
    try:
        return reader.json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def list_versions(spark: SparkSession, store: str) -> DataFrame:
    """``as_at_date``, ``number``, ``version``, ``files``, ``rows`` and ``committed_at``."""
    commits = _commits(spark, store)
    if commits is None:
        commits = spark.createDataFrame([], COMMIT)
    return commits.groupBy("as_at_date", "number", "version").agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.max("committed_at").alias("committed_at")
    )


def read_version(
    spark: SparkSession,
    store: str,
    as_at_date: datetime.date | None = None,
    buckets: Sequence[AgeBucket] = AGE_BUCKETS,
    number: int | None = None,
) -> DataFrame | None:
    """The report of a date, or of all dates, as last committed or in the version ``number``.

    None if the store has no commits (for that date). ``ValueError`` if its buckets are others
    or there is no such number. The names of the files come to the driver, not their rows.
    """
    commits = _commits(spark, store, as_at_date)
    if commits is None:
        return None
    if number is not None:
        commits = commits.filter(F.col("number") == number)
    latest = Window.partitionBy("as_at_date").orderBy(F.desc("number"), F.desc("version"))
    wanted = commits.withColumn("place", F.dense_rank().over(latest)).filter("place = 1").collect()
    if not wanted:
        raise ValueError(f"{store} has no version {number} of {as_at_date or 'any date'}")
    schema = report_schema(buckets)
    for row in wanted:
        if sorted([*row.columns, "as_at_date"]) != sorted(schema.names):
            raise ValueError(
                f"the report of {row.as_at_date} in {store} has columns {', '.join(row.columns)}; "
                f"these buckets ask for {', '.join(schema.names)}"
            )
    files = [f"{_folder(store, row.as_at_date, row.version)}/{row.file}" for row in wanted]
    reader = spark.read.schema(schema).option("basePath", f"{store}/versions")
    return reader.parquet(*files).select(*schema.names)
