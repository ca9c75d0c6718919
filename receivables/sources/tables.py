"""Typed scans of the input tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DecimalType, StringType, StructField, StructType

from receivables.schemas import MONEY, REJECTED, input_schemas


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: StructType,
    quote: str = '"',
    escape: str = "\\",
    multi_line: bool = False,
    rejected: bool = False,
) -> DataFrame:
    """Scans ``path`` with a declared schema; nothing is inferred.

    ``csv`` takes columns by position and skips the header line. A value that
    does not parse, and a field that is missing, become NULL; further fields are
    dropped. ``quote`` and ``escape`` are its quoting; with ``multi_line`` a quoted text may
    hold line breaks, but then a file is not split among tasks. With ``rejected`` a column
    ``REJECTED`` holds the line as it stands where a value did not parse or the number of
    fields is another, else NULL; a value that a query does not read is not parsed, so use it
    with all columns, as ``rejected_lines`` and the checks do. ``parquet`` takes columns by
    name and must hold the declared types.
    """
    if fmt == "csv" and rejected:
        schema = StructType([*schema.fields, StructField(REJECTED, StringType())])
    reader = spark.read.schema(schema)
    if fmt == "csv":
        if rejected:
            reader = reader.options(columnNameOfCorruptRecord=REJECTED, columnPruning=False)
        return reader.options(
            header=True, quote=quote, escape=escape, multiLine=multi_line
        ).csv(path)
    if fmt == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported input format: {fmt}")


def read_inputs(
    spark: SparkSession,
    paths: Mapping[str, str],
    fmt: str = "csv",
    money: DecimalType = MONEY,
    **csv: object,
) -> dict[str, DataFrame]:
    """The three input tables by name; ``paths`` gives the path of each, ``csv`` the options
    of ``read_table``."""
    return {
        name: read_table(spark, paths[name], fmt, schema, **csv)
        for name, schema in input_schemas(money).items()
    }
