"""CSV files a spreadsheet opens directly: UTF-8 with a byte-order mark and semicolons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTE_ORDER_MARK = "﻿"

# Fixed values of the format.
CSV_OPTIONS = {
    "sep": ";",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the rows as CSV parts, in parallel, which joined as bytes by name make up one file.

    Mark and header stand in the first part only. A line feed inside a cell stays as it is.
    """
    names = df.sparkSession.createDataFrame([tuple(df.columns)], ", ".join(f"c{i} string" for i in range(len(df.columns))))
    header = csv_rows(names.coalesce(1)).select(F.concat(F.lit(BYTE_ORDER_MARK), "linha").alias("linha"))
    # A union keeps the order of its parts, so the header is the first part.
    header.union(csv_rows(df)).write.mode(mode).option("lineSep", "\r\n").text(path)


def csv_rows(df: DataFrame) -> DataFrame:
    """One CSV line per row as ``linha``, without header."""
    cells = F.struct(*[F.col(f"`{name}`") for name in df.columns])
    return df.select(F.to_csv(cells, CSV_OPTIONS).alias("linha"))
