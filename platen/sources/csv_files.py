"""CSV files as tables.

The reader covers RFC 4180 files. Text held in a column, with quotes in the
middle of fields or mixed row ends, is parsed by ``functions.tabular`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUOTING = {"quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """Values stay strings unless a schema is given; quoted fields may span lines."""
    reader = spark.read.options(header=header, multiLine=True, **QUOTING)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Quote only where needed, CRLF after every row."""
    df.write.mode("overwrite").options(
        header=header, lineSep="\r\n", emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, **QUOTING
    ).csv(path)
