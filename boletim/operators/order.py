"""Row order: missing values last, binary or language-aware comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def order_key(df: DataFrame, name: str, descending: bool = False, collation: str | None = None) -> Column:
    """Sort expression for one column; ``collation`` applies to text columns."""
    column = F.col(f"`{name}`")
    if collation and isinstance(df.schema[name].dataType, T.StringType):
        column = F.collate(column, collation)
    return column.desc_nulls_last() if descending else column.asc_nulls_last()


def sorted_by(df: DataFrame, columns: Sequence[str], collation: str | None = None) -> DataFrame:
    """Ascending by the columns in turn."""
    return df.orderBy(*[order_key(df, name, collation=collation) for name in columns])
